import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgrid.llm import language, quality, toxicity
from plotgrid.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def of(name):
        rows = QUERIES[name](spark, SF).join(labels, "doc_id").collect()
        assert all(0 <= r.score <= 1 for r in rows)
        return rows

    return of


def test_held_out_quality(judged):
    held = [r for r in judged("op1_quality_classifier") if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(r.predicted == (r.score >= 0.3) for r in held)


def test_held_out_toxicity(judged):
    held = [r for r in judged("op10_toxicity") if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.93


def test_held_out_language(spark):
    rows = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.1


def test_scores_rise_with_the_difference():
    rng = random.Random(1)
    x = [rng.gauss(i % 2, 1) for i in range(500)]
    points, scores = quality.rising_curve(x, [i % 2 for i in range(500)])
    assert all(a <= b for a, b in zip(scores, scores[1:])) and 0 < scores[0] < 0.3 < 0.7 < scores[-1] < 1
    assert quality.rising_curve([], [])[1] == (0.5,) and quality.rising_curve([1.0, 2.0], [1, 1])[1] == (0.75,)


def plain_segments(scores):
    """All maximal scoring segments by repeatedly taking the best, the shortest of equals, and looking left and right of it."""
    best = max(((sum(scores[i : j + 1]), -(j - i), -i) for i in range(len(scores)) for j in range(i, len(scores))), default=None)
    if best is None or best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    left = [(s, a, b) for s, a, b in plain_segments(scores[:i])]
    right = [(s, a + j + 1, b + j + 1) for s, a, b in plain_segments(scores[j + 1 :])]
    return left + [(best[0], i, j)] + right


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-1, -1, -2, 1, 2, 3, None]) for _ in range(rng.randint(0, 14))]
        found = [(i, s * 1.0, i, i) for i, s in enumerate(scores) if s is not None]
        got = [(round(s, 9), a, b) for s, a, b in toxicity.maximal_segments(found, drift=0.5)]
        assert got == [(round(s, 9), a, b) for s, a, b in plain_segments([-0.5 if s is None else float(s) for s in scores])]


def test_every_passage_is_found():
    words = {"bad": 6.0, "worse": 5.0}
    text = "clean " * 300 + "bad and worse " + "clean " * 300 + "bad " + "clean " * 50
    found, n = toxicity.hits(text, words, {})
    spans = toxicity.maximal_segments(found)
    assert n == 654 and [text[a:b] for _, a, b in spans] == ["bad and worse", "bad"]
    assert [s for s, _, _ in spans] == [11.0 - toxicity.DRIFT, 6.0]


def test_odd_rows(odd, empty, labels, spark):
    blank = quality.QualityModel(b"", b"", (0.0,), (0.5,))
    for model in (blank, quality.fit(odd, labels)):
        rows = quality.with_quality(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.keep_good(odd, blank).columns == odd.columns
    model = toxicity.fit(odd, labels)
    rows = toxicity.with_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.toxic_score <= 1 and not r.toxic_spans for r in rows)
    model = language.fit(odd)
    rows = language.with_language(odd, model, reject=False).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id == 7} == {"en"}
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality.with_quality(empty, quality.fit(empty, some)).count() == 0
    assert toxicity.with_toxicity(empty, toxicity.fit(empty, some)).count() == 0
    assert language.with_language(empty, language.fit(empty)).count() == 0
    assert quality.fit(odd, some).scores and toxicity.fit(odd, some).curve


def test_no_letter_is_undetermined(spark):
    texts = spark.createDataFrame([("12 34",), ("--",), ("x",), ("中文",)], "text string")
    model = language.LanguageModel(("en",), np.zeros((language.BUCKETS, 1), dtype=np.float32), 1.0, 0.0)
    assert [r.lang_pred for r in language.with_language(texts, model).collect()] == ["und", "und", "en", "en"]


def test_blocks_do_not_change_the_average(monkeypatch):
    codes = language.code_points("Some words, 12 of them — in several blocks. " * 400)
    weights = np.random.default_rng(0).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    whole = weights[language.subword_buckets(codes)].mean(axis=0)
    assert np.allclose(language.averaged(codes, weights), whole, atol=1e-4)


def test_rare_language_is_learned(spark):
    rng = random.Random(8)

    def text(letters):
        return " ".join("".join(rng.choices(letters, k=5)) for _ in range(60))

    rows = [(i, text("abcdefgh"), "common") for i in range(4000)] + [(i, text("qrstuvwx"), "other") for i in range(4000, 6000)]
    rows += [(i, text("жзийклмн"), "rare") for i in range(6000, 6012)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    known = docs.where(~language.held_out(F.col("doc_id")))
    chosen, counts = language.language_sample(known, 300)
    per = {r.chosen_lang: r["count"] for r in chosen.groupBy("chosen_lang").count().collect()}
    rare = known.where("lang = 'rare'").count()
    assert rare > 2 and per["rare"] == rare == counts["rare"] and sum(per.values()) <= 300
    assert abs(per["common"] - per["other"]) <= 1
    model = language.fit(docs, 300)
    got = language.with_language(docs, model, reject=False).groupBy("lang", "lang_pred").count().collect()
    assert model.names == ("common", "other", "rare")
    assert {(r.lang, r.lang_pred) for r in got} == {(x, x) for x in model.names}


def test_quota_and_weighted_level():
    assert language.equal_quota([3, 100, 100], 23) == 10 and language.equal_quota([3, 4], 100) == 4
    assert language.equal_quota([], 5) == 0
    p, w = np.array([0.9, 0.1, 0.5, 0.7]), np.array([97.0, 1.0, 1.0, 1.0])
    assert language.lowest_share(p, w, 0.0) == 0.1 and language.lowest_share(p, w, 0.02) == 0.7


def test_level_holds_for_whole_texts(spark):
    rng = random.Random(2)

    def text(own, share, n):
        return " ".join("".join(rng.choices(own if rng.random() < share else "mnop", k=5)) for _ in range(n))

    # long texts whose windows are far less sure than the whole
    rows = [(i, text("abcd" if i % 2 else "wxyz", 0.06, 1500), "a" if i % 2 else "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs, 400)
    judged = language.with_language(docs.where(~language.held_out(F.col("doc_id"))), model, reject=False)
    sample, _ = language.language_sample(docs.where(~language.held_out(F.col("doc_id"))), 400)
    held = sample.where(language.calibration_fold(F.col("chosen")) & (F.col("rank") > 1))
    scores = sorted(r.lang_score for r in judged.join(held, F.col("doc_id") == F.col("chosen")).collect())
    below = sum(s < model.level for s in scores)
    # the level is the score of one of the whole texts that set it
    assert below <= 0.01 * len(scores) and min(abs(s - model.level) for s in scores) < 1e-6


def test_no_text_reaches_the_driver(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    collect = type(docs).collect

    def watched(frame):
        seen.append({f.name: f.dataType.simpleString() for f in frame.schema})
        return collect(frame)

    monkeypatch.setattr(type(docs), "collect", watched)
    monkeypatch.setattr(type(docs), "toPandas", lambda frame: 1 / 0)
    model = language.fit(docs)
    assert seen and not any("text" in columns for columns in seen)
    strings = {name for columns in seen for name, kind in columns.items() if "string" in kind}
    assert strings == {"lang"}
    # the optimum lies inside the range that is searched, and scores do not all round to 1
    assert language.TEMPERATURES[0] < model.temperature < language.TEMPERATURES[-1]
    assert 0.5 < model.level < 1


def test_temperature_is_finite_for_separable_rows():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 300)
    logits = rng.normal(size=(300, 3)) * 0.1
    logits[np.arange(300), truth] += 5
    t = language.best_temperature(logits, truth, np.ones(300), np.zeros(3))
    assert language.TEMPERATURES[0] < t < language.TEMPERATURES[-1]
    p = language._probabilities(logits, t).max(axis=1)
    assert 0.999 < p.mean() < 1 - language.MISLABELLED / 2


def test_pieces_cover_the_whole_text():
    for n in (0, 1, 64, 65, 320, 5000):
        codes = np.arange(n)
        parts = list(language.pieces(codes))
        assert sum(map(len, parts)) == n and all(len(a) < len(b) for a, b in zip(parts, parts[1:-1]))
        assert np.array_equal(np.concatenate([*parts, codes[:0]]), codes)


def plain_prediction(text, model):
    """Language and score of a text by plain dictionaries: every subword's row, averaged."""
    codes = language.code_points(text).tolist()
    total, n = [0.0] * len(model.names), 0
    for size in language.GRAMS:
        for i in range(len(codes) - size + 1):
            gram = codes[i : i + size]
            if 32 in gram[1:-1] or gram == [32]:
                continue
            h = 2166136261 + size
            for c in gram:
                h = (h ^ c) * 16777619 % 2**32
            row = model.weights[(h ^ h >> 15) % language.BUCKETS]
            total, n = [t + float(w) for t, w in zip(total, row)], n + 1
    shift = model.shift if isinstance(model.shift, tuple) else (model.shift,) * len(total)
    z = [t / n / model.temperature + s for t, s in zip(total, shift)]
    e = [np.exp(v - max(z)) for v in z]
    return model.names[e.index(max(e))], max(e) / sum(e)


def test_predictions_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"), 300)
    for r in language.with_language(docs, model, reject=False).collect():
        if len(r.text or "") > 3000 or r.lang_pred == "und":
            continue
        name, score = plain_prediction(r.text, model)
        assert name == r.lang_pred and abs(score - r.lang_score) < 1e-4


def test_token_log_odds_against_counts(spark):
    rng = random.Random(6)
    pool = [f"{rng.choice(['alpha', 'beta', 'gam'])}{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(pool, k=12)), int(i % 4 == 0)) for i in range(80)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    counts, totals = {}, [0, 0]
    for _, text, label in rows:
        tokens = {(w, 0) for w in text.split()}
        totals[label] += len(tokens)
        for token in tokens | {(w[:n], n) for w, _ in tokens for n in toxicity.STEMS if len(w) > n}:
            counts.setdefault(token, [0, 0])[label] += 1
    part = toxicity.PRIOR * totals[1] / sum(totals)
    want = {
        t: np.log((y[1] + part) * totals[0] / ((y[0] + toxicity.PRIOR - part) * totals[1]))
        for t, y in counts.items() if sum(y) >= toxicity.WITNESSES
    }
    got = {(r.token, r.stem): r.score for r in toxicity.token_log_odds(sample).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert min(want.values()) < 0 < max(want.values())


def test_toxic_score_and_passages_against_plain_steps(spark):
    rng = random.Random(7)
    words = {w: s for w, s in zip("abcdefg", (2.5, 1.5, -0.5, -2.0, 0.0, 4.0, -1.0))}
    model = toxicity.ToxicModel(words, {"long": 3.0, "longe": -3.0}, 1.2, 0.05, (1.5, -1.0))
    texts = [" ".join(rng.choices([*words, "zz", "longs", "longest", "Long"], k=rng.randint(0, 25))) for _ in range(120)]
    judged = toxicity.with_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    passages = 0
    for r in judged:
        tokens = r.text.split()
        scores = [words.get(t.lower(), 3.0 if t == "longs" else -3.0 if t == "longest" else -toxicity.DRIFT) for t in tokens]
        starts = [len(" ".join(tokens[:i])) + (i > 0) for i in range(len(tokens))]
        segments, expected = plain_segments(scores), 0.05 * max(len(tokens), 1)
        values = [1.2 * s - np.log(expected) for s, _, _ in segments]
        x = max([sum(v for v in values if v > 0), max(values)]) if values else -np.log(expected + 1)
        score = 1 / (1 + np.exp(-1.5 * np.sign(x) * np.log1p(abs(x)) + 1.0))
        assert abs(score - r.toxic_score) < 1e-9
        limit = 1.0 if score >= toxicity.ACCEPT else toxicity.SIGNIFICANCE
        want = [(starts[i], starts[j] + len(tokens[j])) for (_, i, j), v in zip(segments, values) if np.exp(-v) <= limit]
        assert [(s.start, s.end) for s in r.toxic_spans] == want
        passages += len(want)
    assert passages > 50


def test_tail_law_recovers_its_own_parameters():
    rng = np.random.default_rng(5)
    n = rng.integers(50, 500, 20_000)
    best = np.maximum(0.0, (np.log(0.1 * n) - np.log(-np.log(rng.random(n.size)))) / 1.5)
    decay, scale = toxicity.tail_law(best.tolist(), n.tolist())
    # the trimmed tail makes the fall a little steeper
    assert 1.4 < decay < 1.9 and 0.07 < scale < 0.25
    assert all(v > 0 for v in toxicity.tail_law([], [])) and all(v > 0 for v in toxicity.tail_law([0.0] * 9, [0] * 9))


def test_quality_score_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    good, bad = quality._compressor(model.good), quality._compressor(model.bad)
    for r in quality.with_quality(docs, model).collect():
        data = (r.text or "").encode()
        parts = [data[i : i + 1000] for i in range(0, len(data), 1000)]
        saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / max(len(data), 1)
        assert abs(np.interp(saved, model.points, model.scores) - r.quality_score) < 1e-9
