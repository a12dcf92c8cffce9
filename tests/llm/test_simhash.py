import random
import re
from itertools import combinations

import xxhash

from plotgrid.llm import components, simhash
from plotgrid.llm.registry import QUERIES


def plain_fingerprint(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(fps, 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in fps}


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    parts = plain_components(fps, 2)
    got = QUERIES["op3_simhash_near_dedup"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == parts


def test_links_of_dense_groups_against_brute_force(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(80)}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    for bits in (0, 1, 2, 3):
        got = simhash.hamming_links(frame, bits).collect()
        pairs = {frozenset((r.fp % (1 << 64), r.other % (1 << 64))) for r in got}
        assert len(pairs) == len(got)
        assert pairs == {frozenset(p) for p in combinations(fps, 2) if bin(p[0] ^ p[1]).count("1") <= bits}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001), (7, 7), (None, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.components(links.where("a < 0"), "a", "b").count() == 0


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].fp == by_id[1].fp == by_id[2].fp == 0 and by_id[2].component_id == by_id[1].component_id == 0
    assert by_id[8].component_id == 7
    assert simhash.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in simhash.keep_one(odd).collect()}
    assert 7 in kept and 8 not in kept and 2 not in kept and None in kept
