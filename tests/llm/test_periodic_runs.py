import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from plotgrid.llm import periodic_runs as pr
from plotgrid.llm.registry import QUERIES


def plain_runs(words, min_length=24, repeats=3):
    """Every maximal run by comparing all lags at all places, kept where the lag is the smallest period."""
    n, runs = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, repeats * q) and smallest_period(words[i : j + q]) == q:
                runs.append((i, j - i + q, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def found(words, min_length, repeats):
    (n, runs, collapsed), = pr.runs_of([" ".join(words).encode()], min_length, repeats)
    assert n == len(words)
    return runs


@pytest.mark.parametrize("letters,repeats", [("ab", 3), ("abc", 4), ("abcdefgh", 3), ("a", 3)])
def test_runs_against_brute_force(letters, repeats):
    rng = random.Random(len(letters))
    for _ in range(400):
        words = []
        while len(words) < rng.randint(0, 120):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            words += part * rng.choice([1, 1, 2, 3, 4, 7])
        runs = found(words, rng_min := rng.choice([1, 6, 24]), repeats)
        assert runs == plain_runs(words, rng_min, repeats)
        assert all(smallest_period(words[s : s + m]) == q for s, m, q in runs)


def test_nested_and_overlapping_runs():
    inner = ["x"] * 30
    words = (inner + ["y", "z"]) * 4 + ["q"]
    assert found(words, 24, 3) == plain_runs(words) and len(plain_runs(words)) == 5
    cube = "a b a".split() * 10 + "b a b".split() * 10
    assert found(cube, 24, 3) == plain_runs(cube)


def test_many_lags_are_scanned_in_groups(monkeypatch):
    monkeypatch.setattr(pr, "PAIRS_AT_ONCE", 50)
    words = [f"w{i % 37}" for i in range(200)] + [f"w{i % 5}" for i in range(100)] + ["w1"] * 40
    assert found(words, 24, 3) == plain_runs(words)


def test_long_text_of_one_period():
    words = [f"w{i % 3000}" for i in range(30_000)] + ["tail"] * 5000
    assert found(words, 24, 3) == [(0, 30_000, 3000), (30_000, 5000, 1)]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    # plain steps are quadratic, so the longest texts are left to the other tests
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) <= 1500}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert {r for r in got if r[0] in short} == {plain_row(i, t) for i, t in short.items()}
    assert any(r[1] for r in got)


def test_odd_rows(odd, empty):
    rows = pr.with_runs(odd).collect()
    assert len(rows) == odd.count() and rows[0].n_lines == "clash"
    by_text = {r.text: r for r in rows}
    assert all(by_text[t].n_words == 0 and by_text[t].runs == [] and by_text[t].collapsed_text == "" for t in (None, "", " \t\n ", "\n\n\n"))
    assert by_text["two words"].collapsed_text == "two words"
    assert all(r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert pr.with_runs(empty).count() == 0
    assert pr.digests(pr.with_runs(pr.with_planted_repeats(odd))).count() == odd.count()
    clash = odd.selectExpr("*", "1 as runs", "2 as collapsed_text", "3 as n_words")
    assert [f.name for f in pr.with_runs(clash).schema][-3:] == ["n_words", "runs", "collapsed_text"]
    assert pr.with_runs(clash).where("size(runs) = 0").count() == odd.count()
