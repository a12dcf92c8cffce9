import codecs
import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer

from plotgrid.llm import bpe
from plotgrid.llm.registry import QUERIES

PARTS = ["th", "e", "an", " in", "s", "'s", "'", " ", "\n", "aa", "!", "?!", "1", "é", "É", "Σ", "ß", "中", "<|endoftext|>", "İ", "é", "\x1c", "\xa0", "ll", "..."]


@pytest.fixture(scope="module")
def library(word_bpe):
    return Tokenizer.from_file(word_bpe)


@pytest.fixture(scope="module")
def merges(word_bpe):
    with open(word_bpe, "rb") as f:
        return bpe.MergeList(f.read())


def encoded(merges, text):
    out = array("i")
    bpe.Encoder(merges).encode(text, out)
    return list(out)


def test_texts_as_the_library(merges, library):
    rng = random.Random(5)
    encoder = bpe.Encoder(merges)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        out = array("i")
        encoder.encode(text, out)
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(out) == ids
        assert bpe.TokenText(merges).feed(out) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [1, 40, 700])
def test_long_words_stream_with_the_lookahead(merges, library, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    rng = random.Random(block)
    for alphabet in (["th", "e", "an", "in", "s", "a", "aa", "re", "er", "tion", "q", "zz"], ["a"], ["é", "a"]):
        word = "".join(rng.choice(alphabet) for _ in range(2500))
        data = word.encode()
        transducer = bpe.WordTransducer(merges, block)
        got, held = [], 0
        for at in range(0, len(data) - 1, 37):
            got += transducer.feed(data[at : min(at + 37, len(data) - 1)])
            held = max(held, len(transducer.held))
        assert got + transducer.finish(data[-1]) == library.encode(word, add_special_tokens=False).ids
        assert held <= 2 * block + merges.lookahead + 64


def test_sufficient_lookahead():
    # (c, d) before (b, c) before (a, b): whether a and b merge is known two symbols on
    assert bpe.sufficient_lookahead([(3, 4, 10), (2, 3, 11), (1, 2, 12)]) == 3
    assert bpe.sufficient_lookahead([(1, 2, 10), (2, 3, 11), (3, 4, 12)]) == 1
    assert bpe.sufficient_lookahead([(1, 2, 10), (3, 4, 10)]) is None
    assert bpe.sufficient_lookahead([]) == 0


def test_readable_text_in_parts(merges):
    ids = encoded(merges, "Naïve 🙂 中文, don't")
    decoder = bpe.ByteText(merges)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "naïve 🙂 中文 , don 't "
    broken = bpe.ByteText(merges)
    text = "".join(broken.feed([merges.inner[b]]) for b in b"\xf0\x9f\x99") + broken.finish()
    assert text == codecs.decode(b"\xf0\x9f\x99", "utf-8", "replace")


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op9_bpe_codec"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty, word_bpe, library):
    rows = bpe.with_tokens(odd, word_bpe).collect()
    assert len(rows) == odd.count() and rows[0].signature == "clash"
    for r in rows:
        assert list(r.token_ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded_text == library.decode(list(r.token_ids), skip_special_tokens=False)
    assert bpe.with_tokens(empty, word_bpe).count() == 0
