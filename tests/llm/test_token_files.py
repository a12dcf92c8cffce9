import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plotgrid.llm import token_files
from plotgrid.llm.registry import QUERIES
from plotgrid.session import scratch_folder


@pytest.fixture(scope="module")
def library(byte_bpe):
    return Tokenizer.from_file(byte_bpe)


def expected(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op7_token_files"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == expected(library, docs)


def test_parts_as_whole_texts(byte_bpe, library):
    rng = random.Random(2)
    parts = ["the", " ", "  ", "\n", "a", "'s", "12", "é", "<|endoftext|>", "!", "\t", "中", "　", "\x1c", " word", ".", "\x85", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + [None, "x" * 5000]
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    for text, data in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_marks_and_control_characters(byte_bpe, library):
    texts = [". a", "a .", "a . , ! | .", "a .\0 b.\0", "\0 \0. x|", "end. end, end! end| é. É! ÿ, ×. ÷. ж. 中.", "a.. b.,", "", ".", " .", "it's. 12. a1."]
    texts += [" ".join(texts), "word " * 3000 + "word."]
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    for _ in range(2):  # learned, then known
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_breaks_and_marks(byte_bpe, library):
    """A newline is cut off only where the library begins a piece at it, marks only behind letters."""
    breaks = ["\n", "\n\n", "\n\n\n", " \n", "\n ", "\t\n", "\n\t", "\n\t\n", "\r\n", "\x85\n", "\u3000\n "]
    words = ["Word", "é", "end.", "it's", "x'", "a?!", "b)];", "''", "...", "12.", "c'll.", "ж!", "d\\", "e`~", "f-g-"]
    texts = [a + x + b + x + a for x in breaks for a in words for b in words] + breaks + [x + "end" for x in breaks] + ["end" + x for x in breaks]
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    for _ in range(2):  # learned, then known
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_known_words_go_to_the_library_once(byte_bpe, library):
    """Words known behind a space, words known behind a newline and marks may meet anew without the library."""
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    encoder.encode(["Some words?! behind spaces\nOther... begin lines\nOf texts).\n\nOver", "Blank\n\n\nlines"])

    def called(words):
        raise AssertionError(words)

    encoder._learn = encoder._library = called
    for text in ["Other words...\nOver spaces?!\n\nOf words\nSome behind).", "Of begin?!\nOver", "Over... lines).\n\nOther", "Of words\n\n\nSome\nBlank"]:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_first_words_are_forgotten_too(byte_bpe, library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 40)
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    for i in range(30):
        texts = [f"first{i}of{j}\nline{i}of{j}..." for j in range(10)] + [f"\tuneven{i}of{j}" for j in range(10)]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.words.numbers) <= 40 + 20 and len(encoder.starts.numbers) <= 40 + 10


def test_forgetting_changes_nothing(byte_bpe, library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 5)
    monkeypatch.setattr(token_files, "GATHER_PARTS", 3)
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    for i in range(20):
        texts = [f"some words, {i} of them. And{j} more! é{i}" for j in range(4)]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_keeps_words_that_return(byte_bpe, library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 40)
    with open(byte_bpe) as f:
        encoder = token_files.LibraryEncoder(f.read())
    for i in range(12):
        texts = [f"x the same words " + " ".join(f"rare{i}a{j}" for j in range(25)), f"alone{i}"]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.words.numbers) <= 40 + 28 and {"the", "same", "words"} <= encoder.words.numbers.keys()
    # texts of one word fill the memo of first words
    for i in range(30):
        encoder.encode([f"first{i}of{j}" for j in range(10)])
        assert len(encoder.starts.numbers) <= 40 + 10


@pytest.mark.parametrize("kind", ["random", "period", "equal", "empty", "one"])
def test_grammar_round_trip_and_random_access(kind):
    rng = np.random.default_rng(1)
    ids = {
        "random": rng.zipf(1.3, 40_000) % 500, "period": np.tile([5, 6, 7, 5, 6, 8, 0], 4000), "equal": np.full(9_999, 3),
        "empty": np.zeros(0), "one": np.array([0]),
    }[kind].astype("<u4")
    ends = np.unique(np.append(np.flatnonzero(ids == 0) + 1, len(ids)))
    shard = token_files.Shard(token_files.pack_shard(ids, ends))
    assert (shard.all_ids() == ids).all()
    for i in [*range(min(50, len(ends))), len(ends) - 1]:
        assert (shard.document(i) == ids[(ends[i - 1] if i else 0) : ends[i]]).all()
    for start, end in rng.integers(0, len(ids) + 1, (50, 2)):
        assert (shard.ids(min(start, end), max(start, end)) == ids[min(start, end) : max(start, end)]).all()
    if kind in ("period", "equal"):
        assert len(shard.sequence) < len(ids) / 50
    rules = shard.rules
    assert not (rules[:, 0] == token_files.END_ID).any() if len(rules) else True


def test_pairs_that_do_not_fit_one_number():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 5, (2, 1000))
    places = np.arange(1000)
    packed = token_files._in_order(left, right, places, 3)
    wide = token_files._in_order(left, right, places, 30)
    assert (packed[1] == wide[1]).all() and (packed[1] == np.lexsort((places, right, left))).all()
    assert (packed[0] == np.sort(left << 3 | right)).all() and (wide[0] == np.sort(left << 30 | right)).all()


def test_odd_rows_and_small_shards(spark, odd, empty, byte_bpe, library):
    path = scratch_folder(spark, "token-test")
    token_files.write_token_files(odd, byte_bpe, path, shard_tokens=50)
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    want = expected(library, [(r.doc_id, r.text) for r in odd.collect()])
    assert got == want
    path = scratch_folder(spark, "token-test")
    token_files.write_token_files(empty, byte_bpe, path)
    assert token_files.read_token_files(spark, path).count() == 0
