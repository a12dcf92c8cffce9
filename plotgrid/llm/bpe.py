"""Byte-pair encoding and decoding as streaming transducers."""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotgrid.llm.common import Memo, documents
from plotgrid.llm.registry import query

WORD_END = "</w>"
BLOCK = 4_096
MEMO = 200_000
MEMO_CHARS = 64
FLUSH = 2_000_000
NONE = 1 << 60

# fixed value: white space of the tokenizer's patterns (Unicode White_Space)
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = regex.compile(rf"\p{{L}}+|'(?:s|t|re|ve|m|ll|d)|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CHUNK = regex.compile(rf"[^{SPACE}]+")
# what str.split() takes for white space and the patterns do not
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeList:
    """Vocabulary and merges of a tokenizer file, with the lookahead that its merges need."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        self.vocab: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.merges: dict[int, int] = {}  # a pair's ids to rank and made id, one number
        parents: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab[left + right]
            a, b = self.vocab[left], self.vocab[right]
            self.merges[a << 24 | b] = rank << 24 | made
            parents.append((a, b, made))
        alphabet = byte_alphabet()
        self.inner = [self.vocab[alphabet[b]] for b in range(256)]
        self.final = [self.vocab[alphabet[b] + WORD_END] for b in range(256)]
        self.bytes_of = {c: b for b, c in alphabet.items()}
        self.lookahead = sufficient_lookahead(parents)


def sufficient_lookahead(rules: list[tuple[int, int, int]]) -> int | None:
    """Symbols behind a token's end after which nothing that follows can change the token.

    A merge at a token's end is only undone by an earlier merge that takes the end of its right part
    away, which in turn depends on a still earlier one. So ranks fall along such a chain, and
    its length is the sum of the right parts. One pass by rising rank finds the longest chain.
    None if a token has several merges or is used before it is made: ranks need not fall then.
    """
    size: dict[int, int] = {}
    right_of: dict[int, int] = {}
    best: dict[int, int] = {}
    used: set[int] = set()
    for a, b, made in rules:
        if made in right_of or made in used:
            return None
        used.update((a, b))
        size[made] = size.get(a, 1) + size.get(b, 1)
        right_of[made] = b
        reach, t = best.get(b, 0), b
        while t in right_of:
            t = right_of[t]
            reach = max(reach, best.get(t, 0))
        best[a] = max(best.get(a, 0), size.get(b, 1) + reach)
    return max(best.values(), default=0)


def _merge_few(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
    get = merges.get
    found = [get(a << 24 | b, NONE) for a, b in zip(ids, ids[1:])]
    while found:
        low = min(found)
        if low == NONE:
            break
        i = found.index(low)
        made = low & 0xFFFFFF
        ids[i : i + 2] = [made]
        del found[i]
        if i:
            found[i - 1] = get(ids[i - 1] << 24 | made, NONE)
        if i < len(found):
            found[i] = get(made << 24 | ids[i + 1], NONE)
    return ids


def _merge_many(ids: list[int], merges: dict[int, int]) -> list[int]:
    """As ``_merge_few`` with a heap of pairs over a linked list, for long buffers."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := merges.get(ids[i] << 24 | ids[j])) is not None:
            heapq.heappush(heap, (found, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        found, i, left, right = heapq.heappop(heap)
        j = after[i] if ids[i] == left else n
        if j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = found & 0xFFFFFF, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


class WordTransducer:
    """Encodes one word fed in parts of any size and emits each token once it is stable.

    At most two blocks, the lookahead and one token are held. A list of merges without a bound keeps
    the word until its end.
    """

    def __init__(self, merges: MergeList, block: int = BLOCK):
        self.of = merges
        self.limit = None if merges.lookahead is None else block + merges.lookahead
        self.held: list[int] = []

    def _encode(self, symbols: list[int]) -> list[int]:
        return (_merge_few if len(symbols) <= 24 else _merge_many)(symbols, self.of.merges)

    def _length(self, token: int) -> int:
        text = self.of.tokens[token]
        return len(text) - len(WORD_END) if text.endswith(WORD_END) and len(text) > len(WORD_END) else len(text)

    def feed(self, data: bytes) -> list[int]:
        """The tokens that the word's next bytes make stable; the word's end is still to come."""
        inner, stable = self.of.inner, []
        for at in range(0, len(data), BLOCK):
            self.held += [inner[b] for b in data[at : at + BLOCK]]
            if self.limit is not None and len(self.held) > self.limit:
                safe, done = len(self.held) - self.of.lookahead, 0
                for token in self._encode(self.held[:]):
                    size = self._length(token)
                    if done + size > safe:
                        break
                    done += size
                    stable.append(token)
                del self.held[:done]
        return stable

    def finish(self, last: int) -> list[int]:
        """The rest of the tokens, given the word's last byte."""
        self.held.append(self.of.final[last])
        tokens, self.held = self._encode(self.held), []
        return tokens


class Encoder:
    """Ids of whole texts, appended to an array. Two bounded memos keep the ids of short
    white-space separated chunks and of short words."""

    def __init__(self, merges: MergeList):
        self.of = merges
        self.chunks, self.words = Memo(MEMO), Memo(MEMO)
        self.anywhere = any(not t.startswith("<") for t in merges.special)
        self.special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None

    def _word(self, word: str, out: array) -> None:
        known = self.words.young.get(word) or self.words.recall(word)
        if known is not None:
            out.frombytes(known)
            return
        data = word.encode("utf-8", "surrogatepass")
        transducer = WordTransducer(self.of)
        if len(word) > MEMO_CHARS:
            out.extend(transducer.feed(data[:-1]))
            out.extend(transducer.finish(data[-1]))
            return
        made = array("i", transducer.feed(data[:-1]))
        made.extend(transducer.finish(data[-1]))
        self.words.store(word, made.tobytes())
        out.extend(made)

    def _plain(self, text: str, out: array) -> None:
        if not text.isascii():
            # a capital sigma lower-cases by itself, not by its place in the word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            self._word(text, out)
        elif text[:-1].isalpha() and text[-1] in ".,!|":
            self._word(text[:-1], out)
            self._word(text[-1], out)
        else:
            for word in PIECE.findall(text):
                self._word(word, out)

    def _chunk(self, chunk: str, out: array) -> None:
        if self.special is None or "<" not in chunk and not self.anywhere:
            return self._plain(chunk, out)
        for i, part in enumerate(self.special.split(chunk)):
            if i % 2:
                out.append(self.of.special[part])
            elif part:
                self._plain(part, out)

    def encode(self, text: str | None, out: array) -> None:
        """Append the text's ids to ``out``."""
        text = text or ""
        memo, append = self.chunks, out.frombytes
        chunks = map(regex.Match.group, CHUNK.finditer(text)) if SEPARATORS.search(text) else text.split()
        for chunk in chunks:
            known = memo.young.get(chunk)
            if known is None:
                known = memo.recall(chunk)
                if known is None:
                    start = len(out)
                    self._chunk(chunk, out)
                    if len(chunk) <= MEMO_CHARS:
                        memo.store(chunk, out[start:].tobytes())
                    continue
            append(known)


class TokenText:
    """Text of ids as the tokenizer file decodes them: it names no decoder, so the token
    strings with a space between. Fed id by id in parts of any size; the state is whether one came before."""

    def __init__(self, merges: MergeList):
        self.tokens, self.begun = merges.tokens, False

    def feed(self, ids) -> str:
        shown = [self.tokens[i] for i in ids]
        if not shown:
            return ""
        lead, self.begun = " " if self.begun else "", True
        return lead + " ".join(shown)


class ByteText:
    """Readable text of ids: token strings back to bytes, a space for every word end, bytes to text.

    The state is an unfinished UTF-8 sequence of at most three bytes; a broken sequence becomes U+FFFD.
    """

    def __init__(self, merges: MergeList):
        self.of = merges
        self.specials = set(merges.special.values())
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        out = []
        for i in ids:
            token = self.of.tokens[i]
            if i in self.specials:
                out.append(self.state.decode(b"", True) + token + " ")
                self.state.reset()
                continue
            ended = token.endswith(WORD_END) and len(token) > len(WORD_END)
            data = bytes(self.of.bytes_of[c] for c in (token[: -len(WORD_END)] if ended else token))
            out.append(self.state.decode(data + b" " if ended else data))
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_encoders: dict[bytes, Encoder] = {}


def encoder_of(content: bytes) -> Encoder:
    """One encoder for each tokenizer file and worker process."""
    if content not in _encoders:
        _encoders.clear()
        _encoders[content] = Encoder(MergeList(content))
    return _encoders[content]


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with token_ids and decoded_text of every whole text, by the tokenizer file at ``path``.

    The driver reads the file and sends it along. A null or empty text has no ids and decodes
    to the empty text. The strings of special tokens in a text are those tokens. Only
    the text is read; other columns pass through (columns of these names are replaced),
    repeated rows get equal ids, an empty table gives no rows.
    """
    content = Path(path).read_bytes()
    names = [c for c in docs.columns if c.lower() not in ("token_ids", "decoded_text")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    text_at = [c.lower() for c in names].index("text")
    schema = T.StructType(docs.schema.fields + [
        T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded_text", T.StringType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content)

        def flush(part: pa.RecordBatch, ids: array, ends: list[int], texts: list[str]) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(ids) if len(ids) else [], pa.int32()))
            return pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(texts, pa.string())], names=[*names, "token_ids", "decoded_text"])

        for batch in batches:
            ids, ends, texts, begin = array("i"), [0], [], 0
            column = batch.column(text_at)
            for i in range(batch.num_rows):
                encoder.encode(column[i].as_py(), ids)
                texts.append(TokenText(encoder.of).feed(ids[ends[-1] :]))
                ends.append(len(ids))
                if len(ids) >= FLUSH:
                    yield flush(batch.slice(begin, i + 1 - begin), ids, ends, texts)
                    ids, ends, texts, begin = array("i"), [0], [], i + 1
            if begin < batch.num_rows:
                yield flush(batch.slice(begin), ids, ends, texts)

    return docs.mapInArrow(encode, schema)


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows, on request with token_ids."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", *(["token_ids"] if keep_ids else []), F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op9_bpe_codec")
def op9_bpe_codec(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(with_tokens(documents(spark, sf_dir).select("doc_id", "text"), path))
