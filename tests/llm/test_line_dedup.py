import hashlib

from checker import compare

from plotgrid.llm import line_dedup
from plotgrid.llm.registry import CHECKS, QUERIES


def test_query_matches_sql(spark, duck, sf_dir):
    assert compare(QUERIES["op2_line_dedup"](spark, sf_dir), duck, CHECKS["op2_line_dedup"]) is None


def test_kept_in_largest_id_and_rest_in_order(spark):
    shared = "this line is shared by many documents of the corpus"
    docs = spark.createDataFrame(
        [(i, f"head {i}\n  {shared.upper() if i % 2 else shared}\t\nshort\n{shared}\ntail") for i in range(6)], "doc_id bigint, text string"
    )
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i].n_dropped for i in range(6)] == [2, 2, 2, 2, 2, 0]
    assert got[0].text == "head 0\nshort\ntail" and got[0].n_lines == 5


def test_below_the_count_or_the_length_nothing_goes(spark):
    line = "x" * 40
    docs = spark.createDataFrame([(i, line if i < 4 else "y" * 39) for i in range(20)], "doc_id bigint, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {0}


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "z" * 40)] * 7 + [(None, "z" * 40)] * 3, "doc_id bigint, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs, min_documents=3).collect()} == {0}
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(docs, min_documents=2).collect()) == [0] * 7 + [1] * 3


def test_odd_rows(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    null = next(r for r in rows if r.doc_id == 0)
    assert (null.text, null.n_lines, null.n_dropped) == ("", 1, 0) and null.key == "clash"
    assert hashlib.sha256(null.text.encode()).hexdigest().startswith("e3b0")
    assert line_dedup.dedup_lines(empty).count() == 0
