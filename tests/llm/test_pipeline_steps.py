"""Every pipeline stage against a plain version, each fed with what the stage before kept."""

import hashlib
import re

import numpy as np
import regex
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from plotgrid.llm import quality
from plotgrid.session import cut_lineage

BLANK = " \t\n\v\f\r"


def plain_quality(texts, model):
    """Texts whose difference of compressed sizes has a calibrated score of at least 0.3."""
    good, bad = quality._compressor(model.good), quality._compressor(model.bad)
    kept = {}
    for i, text in texts.items():
        data = (text or "").encode()
        parts = [data[a : a + 1000] for a in range(0, len(data), 1000)]
        saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / max(len(data), 1)
        if np.interp(saved, model.points, model.scores) >= 0.3:
            kept[i] = text
    return kept


def plain_lines(texts):
    """Texts without the lines of 40 or more code points that 5 or more of them hold, but for the largest id."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(BLANK))

    holders = {}
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return {i: "\n".join(x for x in (t or "").split("\n") if keeper.get(key(x), i) == i) for i, t in texts.items()}


def plain_benchmark(texts, items):
    """Texts that hold less than four fifths of every item's distinct shingles of five words."""
    def shingles(text):
        words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    wanted = [s for s in map(shingles, items) if s]
    kept = {}
    for i, text in texts.items():
        own = shingles(text)
        if not any(5 * len(own & s) >= 4 * len(s) for s in wanted):
            kept[i] = text
    return kept


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_stages_against_plain_versions(spark, sf_dir, word_bpe):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = quality.fit(docs, labels)

    def one_of_each(texts):
        root = plain_components({i: plain_fingerprint(t) for i, t in texts.items()}, 2)
        return {i: t for i, t in texts.items() if root[i] == i}

    plain = {
        "quality_classifier": lambda t: plain_quality(t, model), "line_dedup": plain_lines,
        "simhash_near_dedup": one_of_each, "benchmark_decontamination": lambda t: plain_benchmark(t, items),
    }
    for name, version in plain.items():
        before = {r.doc_id: r for r in docs.collect()}
        docs = cut_lineage(stages[name](spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        want = version({i: r.text for i, r in before.items()})
        assert {i: r.text for i, r in after.items()} == want, name
        assert want != {i: r.text for i, r in before.items()}, name  # the stage has something to do
        for i, r in after.items():
            assert (r.lang, r.source) == (before[i].lang, before[i].source)
            assert r.n_chars == (len(r.text) if name == "line_dedup" else before[i].n_chars)

    library = Tokenizer.from_file(word_bpe)
    library.no_truncation()
    library.no_padding()
    want = set()
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.add((r.doc_id, tuple(ids), len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = {
        (r.doc_id, tuple(r.token_ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()
    }
    assert got == want
