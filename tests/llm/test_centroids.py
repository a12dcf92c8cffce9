import hashlib
import math
import random

import numpy as np
import pytest

from plotgrid.llm import centroids as ce
from plotgrid.llm.registry import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, clusters, rounds, components):
    """Whole-number k-means step by step: rows of the contract, sorted."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == components and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(64 * float(c)) for c in x]))
    marked = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in marked[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for i in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == i]
            if own:
                centres[i] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    per = {}
    for d, c in found:
        per[c] = per.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        ((i, c, d, per[c], sum(per.values()), digest[c]) for (i, _), (d, c) in zip(kept, found)),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1:]),
    )


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def run(spark, rows, clusters, rounds, components, parts=3):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return got(ce.with_totals(*ce.cluster_vectors(frame, clusters, rounds, components)))


def test_query_against_plain_steps(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(QUERIES["op13_centroid_clustering"](spark, sf_dir)) == plain(rows, 16, 3, 64)


@pytest.mark.parametrize("spread,rounds", [(0.02, 3), (0.3, 5), (2.0, 4)])
def test_groups_of_any_spread(spark, spread, rounds):
    rng = random.Random(rounds)
    middles = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(700)]
    assert run(spark, rows, 6, rounds, 3) == plain(rows, 6, rounds, 3)


def test_ties_copies_and_rows_that_are_left_out(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) / 32, rng.choice([0.0, 1.0]) / 64]) for i in range(200)]
    rows += [(3, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [-5.0, 2.0]), (None, [0.25, 0.25]), (None, [0.5, 0.5])]
    assert run(spark, rows + [(900, None), (901, [1.0]), (902, [1.0, None]), (903, [1.0, math.nan]), (904, [math.inf, 0.0]), (905, [])], 5, 3, 2) == plain(rows, 5, 3, 2)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, -0.51]), (2, [0.25, 3.0])]
    assert run(spark, rows, 16, 3, 2) == plain(rows, 16, 3, 2)
    assert run(spark, rows[:1], 16, 3, 2) == plain(rows[:1], 16, 3, 2)
    assert run(spark, [], 16, 3, 2) == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e300, 0.0])], 2, 1, 2)


def test_only_expired_vectors_are_measured_again(spark, monkeypatch):
    rng = random.Random(4)
    middles = [[rng.uniform(-8, 8) for _ in range(4)] for _ in range(8)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)]) for i in range(2000)]
    made = []
    push = ce._push
    monkeypatch.setattr(ce, "_push", lambda rows, heaps: (push(rows, heaps), made.append(heaps.runs[-1])))
    assert run(spark, rows, 8, 6, 4) == plain(rows, 8, 6, 4)
    sizes = [spark.read.parquet(p).count() for p in made]
    assert sizes[0] == 2000 and sum(sizes[1:]) < 3 * 2000 and sizes[-1] < 200
    # the queue's range reaches the parquet scan
    heaps = ce.Heaps(np.zeros((2, 4)), None, None, np.array([1.0, 2.0]), np.array([0.0, 1.0]), made[:1])
    plan = ce._entries(spark, heaps).where(ce._between(heaps.popped, heaps.drift))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(" in plan and "expires" in plan.split("PushedFilters")[1]
