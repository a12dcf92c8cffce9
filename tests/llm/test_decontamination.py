from checker import compare

from plotgrid.llm import decontamination as d
from plotgrid.llm.registry import CHECKS, QUERIES


def test_query_matches_sql(spark, duck, sf_dir):
    assert compare(QUERIES["op5_benchmark_decontamination"](spark, sf_dir), duck, CHECKS["op5_benchmark_decontamination"]) is None


def test_no_item_is_missed_at_the_threshold(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (1, 4, 5, 6, 9, 10, 14, 20, 37, 64, 130)]
    docs = []
    for n, text in items:
        words = text.split()
        for cut in range(0, max(1, n // 3)):  # shingles are lost at the front
            docs.append((len(docs), n, "before it " * 40 + " ".join(words[cut:]) + " and after" if n >= 5 else text))
    found = d.contained_items(
        spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    want = set()
    for i, n, text in docs:
        all_shingles = max(1, n - 4)
        held = sum(" ".join(f"i{n}w{j}" for j in range(a, min(n, a + 5))) in text for a in range(all_shingles))
        if held * 5 >= all_shingles * 4:
            want.add((i, n))
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 15


def test_case_and_punctuation_do_not_hide_an_item(spark):
    docs = spark.createDataFrame([(1, "x y ONE, two; THREE four-five six seven z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "One two three four five six seven."), (2, "???"), (None, "one two three four five")], "item_id bigint, text string")
    assert {r.item_id for r in d.contained_items(docs, items).collect()} == {1, None}


def test_shuffled_instead_of_broadcast(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, d.contained_items(docs, items).collect()))
    monkeypatch.setattr(d, "broadcast_if_small", lambda df: df.hint("merge"))
    assert sorted(map(tuple, d.contained_items(docs, items).collect())) == want and want


def test_odd_rows(odd, empty):
    items = odd.withColumnRenamed("doc_id", "item_id").drop("n")
    rows = d.contained_items(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(3, 3), (7, 8), (8, 7), (None, None)}
    assert not [r for r in rows if r.item_id in (0, 1, 2)]
    assert d.contained_items(empty, items).count() == 0
    assert d.contained_items(odd, empty.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert {r.doc_id for r in d.drop_contaminated(odd, items).collect()} == {0, 1, 2, 5}
