import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plotgrid.llm import order_minhash as om
from plotgrid.llm.registry import QUERIES



def plain_signature(hash_of, words, k=3):
    """The docstring's definition, step by step; ``hash_of`` is Spark's hash of given values."""
    kmers, seen = [], {}
    for place in range(max(1, len(words) - k + 1)):
        kmer = tuple(words[place : place + k])
        h = hash_of(*kmer) & ~om.PLACE
        n = seen[h] = seen.get(h, -1) + 1
        kmers.append(((hash_of(h, n) if n else h) & ~om.PLACE, place))
    out = {}
    for h, place in sorted(kmers):
        out.setdefault((h >> 58) & 63, []).append((h, place))
    entries = []
    for b, least in out.items():
        chosen = [h for h, _ in sorted(least[:2], key=lambda x: x[1])]
        entries.append(b << 16 | hash_of(*chosen) & 65535)
    return sorted(entries)


def test_signature_against_plain_steps(spark):
    texts = ["a b c d e f g h", "x y x y x y x y x y x y", "", "one", "two words", " ".join(f"w{i % 37}" for i in range(400))]
    made = {r.text: r.s for r in om.with_signature(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s").collect()}

    asked = {}

    def hash_of(*values):
        if values not in asked:
            asked[values] = spark.range(1).select(F.xxhash64(*[F.lit(v) if isinstance(v, str) else F.lit(v).cast("bigint" if abs(v) > 1 << 31 else "int") for v in values])).first()[0]
        return asked[values]

    for text in texts[:5]:
        assert sorted(made[text]) == plain_signature(hash_of, text.split() or [""]), text
    assert len(made[texts[5]]) > 10


def test_order_and_repeats_matter(spark):
    a = [f"w{i}" for i in range(600)]
    rows = {"same": a, "moved": a[300:] + a[:300], "edited": a[:590] + ["x"] * 10, "doubled": a + a, "other": [f"v{i}" for i in range(600)]}
    df = spark.createDataFrame([(n, " ".join(a), " ".join(w)) for n, w in rows.items()], "name string, a string, b string")
    df = om.with_signature(om.with_signature(df, "a", "sa"), "b", "sb").select("name", om.likeness("sa", "sb").alias("x"))
    x = {r.name: r.x for r in df.collect()}
    assert x["same"] == 1 and x["edited"] > 0.85 and x["other"] < 0.1
    assert x["moved"] < x["edited"] and x["doubled"] < 0.7


def test_query_against_plain_edits(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op4_order_minhash"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, (doc_id, text) in enumerate(docs):
        after_id, after = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (r.fingerprint == got[after_id].fingerprint)
    assert sum(r.near_edited for r in got.values()) > 20 * sum(r.near_next for r in got.values())


def test_odd_rows(spark, odd, empty):
    rows = om.edit_likeness(odd).collect()
    assert len(rows) == odd.count()
    assert next(r for r in rows if r.doc_id == 0).n_chars == 0
    assert om.edit_likeness(empty).count() == 0
    alone = om.edit_likeness(spark.createDataFrame([(4, "a b c d")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1 and alone.n_chars == 7
    links = {r.key: r.next_key for r in om.neighbours(odd.select("doc_id", "text")).collect()}
    assert links["0"] == "" and links[""] == "12" and links["12"] == "11" and len(links) == 14


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints and longs, signed."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8 if abs(v) > 1 << 31 else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_every_bin_is_filled_by_plain_steps(spark):
    texts = ["a b c d e f g h", "", "one two three four", " ".join(f"w{i}" for i in range(150))]
    df = om.with_signature(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s", filled=True)
    made = {r.text: r.s for r in df.collect()}
    for text in texts:
        words = text.split() or [""]
        kmers = [(spark_hash(*words[i : i + 3]) & ~om.PLACE, i) for i in range(max(1, len(words) - 2))]
        expected = []
        for b in range(64):
            own = sorted(x for x in kmers if (x[0] >> 58) & 63 == b)
            rest = sorted((spark_hash(h, b) & ~om.PLACE, i) for h, i in kmers if (h >> 58) & 63 != b)
            two = sorted((own + rest)[:2], key=lambda x: x[1])
            expected.append(b << 16 | spark_hash(*[h for h, _ in two]) & 65535)
        assert made[text] == expected, text


def real_orders(a, b, rng):
    """Likeness by the two least k-mers of 64 real random orders, in text order."""
    kmers = [[tuple(t[i : i + 3]) for i in range(len(t) - 2)] for t in (a, b)]
    named = {x: i for i, x in enumerate(sorted({*kmers[0], *kmers[1]}))}
    ids, equal = [np.array([named[x] for x in t]) for t in kmers], 0
    for _ in range(64):
        order = rng.permutation(len(named))
        pair = [tuple(t[np.sort(np.argsort(order[t])[:2])]) for t in ids]
        equal += pair[0] == pair[1]
    return equal / 64


def test_moved_halves_of_short_texts(spark):
    rng, shuffled = np.random.default_rng(3), random.Random(5)
    rows, real = [], {20: [], 40: [], 100: []}
    for n in real:
        for _ in range(80):
            words = [f"w{shuffled.randrange(10**9)}" for _ in range(n)]
            moved = words[n // 2 :] + words[: n // 2]
            rows.append((n, " ".join(words), " ".join(moved)))
            real[n].append(real_orders(words, moved, rng))
    df = spark.createDataFrame(rows, "n int, text string, edited string")
    df = om.with_signature(om.with_signature(df, "text", "sa", filled=True), "edited", "sb", filled=True)
    got = {r.n: r.x for r in df.groupBy("n").agg(F.avg(om.likeness("sa", "sb")).alias("x")).collect()}
    for n, plain in real.items():
        assert abs(got[n] - np.mean(plain)) < 0.04, (n, got[n], np.mean(plain))


def test_query_orders_short_texts(spark):
    words = [f"w{i}" for i in range(60)]
    # documents 2 and 1 are the halves of one text, either way round
    texts = [(2, " ".join(words)), (1, " ".join(words[30:] + words[:30]))]
    found = om.edit_likeness(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert all(len(r.signature) == 64 for r in found)
    assert all(r.near_next < 0.6 for r in found)
