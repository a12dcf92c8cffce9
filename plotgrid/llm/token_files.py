"""Token ids in shards compressed by a Re-Pair grammar, written and read as a table of files."""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotgrid.llm.bpe import byte_alphabet
from plotgrid.llm.common import documents
from plotgrid.llm.registry import query
from plotgrid.session import scratch_folder

END_ID = 0
SHARD_TOKENS = 1 << 20
FIRST_SHARE = 1 / 1024
STEP = 16
MIN_COUNT = 4
MEMO_WORDS = 800_000
MEMO_CHARS = 30_000_000
WORDS_AT_ONCE = 200
LEARNED_AT_ONCE = 20_000
SLICE_BYTES = 16_000_000
BATCH_ROWS = 2_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
GATHER_PARTS = 400_000
# letters of Latin script, behind a space or a newline, are one piece of byte-level BPE, and the marks behind them are another
LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARKED = rf"^\n?{LETTERS}[!-/:-@\[-`{{-~]+$"
WORD = re.compile(rf"\n?{LETTERS}")
NO_MARKS = "\n" + "".join(c for c in map(chr, range(0x250)) if re.fullmatch(LETTERS, c))

MAGIC = b"RPSHARD1"
# a space before another character than white space always begins a new piece of byte-level
# BPE, so the text may be encoded in parts cut there
CUT = re.compile(r" (?=\S)")
# White_Space and the four separators, without space and newline
BLANK = r"\t\x{b}-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = rf"[ \n{BLANK}]"
# texts in which not every space is such a cut, as white space or the end follows one, or that begin with white space of another kind
UNEVEN = rf" (?:{WHITE}|$)|^[{BLANK}]|^\n(?:{WHITE}|$)"
# texts in which not every newline is such a cut, as one stands within white space, neither first nor last
LOOSE = rf"{WHITE}\n(?:{WHITE}|$)"
# in those, a run of newlines between other characters, whose last one is a piece by itself, and a single newline
RUN, SINGLE = rf"([^ \n{BLANK}])(\n+)(\n[^ \n{BLANK}])", rf"([^ \n{BLANK}])(\n[^ \n{BLANK}])"


# ---- encoding

def _gather(ids: np.ndarray, ends: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all entries one after the other, and how many each has; those of entry i stand from ends[i] to ends[i + 1]."""
    begins = ends[entries]
    sizes = ends[entries + 1] - begins
    total = np.cumsum(sizes)
    at = np.repeat(begins - (total - sizes), sizes)
    at += np.arange(len(at))
    return ids[at], sizes


class Entries:
    """Ids of words, one after the other in a growing array, where each word's ids begin, and how many slices met it."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.ends, self.used, self.chars = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0, 0
        self.met = np.zeros(1 << 14, np.int32)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.numbers)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.met = np.concatenate((self.met, np.zeros_like(self.met)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.chars += sum(map(len, words))
        self.numbers.update(zip(words, range(n, n + len(words))))

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries one after the other, and how many each has."""
        return _gather(self.ids, self.ends, entries)

    def over(self) -> bool:
        return len(self.numbers) > MEMO_WORDS or self.chars > MEMO_CHARS

    def often_met(self, always: int) -> Entries:
        """The first ``always`` entries and those that most slices met, of at least two, down to half of the bounds."""
        met = self.met[: len(self.numbers)].copy()
        met[:always] = np.iinfo(np.int32).max
        need, kept = 2, Entries()
        while len(self.numbers):
            keep = met >= need
            words = [w for w, k in zip(self.numbers, keep.tolist()) if k]
            if keep[always:].any() and (len(words) > MEMO_WORDS / 2 or sum(map(len, words)) > MEMO_CHARS / 2):
                need *= 2
                continue
            kept.add(words, *self.gather(np.flatnonzero(keep)))
            kept.met[: len(words)] = self.met[: len(met)][keep] // 2
            break
        return kept


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library.

    Texts are cut at spaces and newlines in Arrow, and equal words of a slice are looked up once. A word that begins a line
    is kept with the newline before it, that of a text's first line too; marks behind letters are kept by themselves, with
    a space, which no word begins with. Words no earlier text had go to the library: those of Latin letters, one piece
    each, to its merges, the others behind a space joined, which gives each the ids it has alone; the ids of all words are kept. Before they pass ``MEMO_WORDS`` words or ``MEMO_CHARS`` characters by more than a slice,
    those that only one slice met are dropped, as most words of a text are rare and would only fill a worker's memory.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        spec = json.loads(content)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pieces = spec["pre_tokenizer"] or {}
        byte_level = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space", True)
        # a tokenizer that changes or cuts texts in another way gets no pieces
        whole = byte_level and spec["normalizer"] is None and not any(re.fullmatch(LETTERS, t.strip()) for t in self.special)
        self.model = self.tokenizer.model if whole else None
        self.shown = "".join(c for _, c in sorted(byte_alphabet().items()))
        space = self.tokenizer.id_to_token(self._library([" "])[0][0])
        self.newline = self._library(["\n"])[0]
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        self.apart = re.compile("|".join(map(re.escape, [" ", "\n", *self.special])))
        self.uneven = "|".join([UNEVEN, *map(re.escape, self.special)])
        self.words, self.starts = Entries(), Entries()
        self._one_by_one([" "])  # entry 0: no marks

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, into: Entries, words: list[str], made: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        into.add(words, np.fromiter(chain.from_iterable(made), "<u4", int(sizes.sum())), sizes)

    def _one_by_one(self, words: list[str]) -> None:
        self._add(self.words, words, self._library([w if w[0] == "\n" else w[1:] if w[0] == " " else " " + w for w in words]))

    def _by_merges(self, words: list[str]) -> list[list[int]]:
        """Ids of pieces of Latin letters, with the space before them if they have one."""
        shown = codecs.charmap_decode("\n".join(words).encode(), "strict", self.shown)[0].split(self.shown[10])
        return [[token.id for token in self.model.tokenize(w)] for w in shown]

    def _learn(self, words: list[str]) -> None:
        """Learn words that follow a space, or hold the newline that they follow, and marks. Those without a space, newline or
        special token in them are joined: each begins at a token that begins with the space."""
        if self.model is not None:
            behind, first, others = [], [], []
            for w in words:
                (others if not WORD.fullmatch(w) else first if w[0] == "\n" else behind).append(w)
            if behind:
                self._add(self.words, behind, self._by_merges([" " + w for w in behind]))
            if first:
                self._add(self.words, first, [self.newline + ids for ids in self._by_merges([w[1:] for w in first])])
            words = others
        alone = [w for w in words if self.apart.search(w)]
        self._one_by_one(alone)
        if alone:
            words = [w for w in words if not self.apart.search(w)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            ids = np.array(self._library([" " + " ".join(some)])[0], "<u4")
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(some):
                self.words.add(some, ids, np.diff(np.append(begins, len(ids))))
            else:  # another kind of tokenizer file
                self._one_by_one(some)

    def _different(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all different parts one after the other, where each one's end, from 0 on, and which of them each part is."""
        coded = parts.dictionary_encode()
        texts = coded.dictionary
        stems, mark = texts, np.zeros(len(texts), np.int64)
        if self.model is not None:
            marked = pc.match_substring_regex(texts, MARKED)
            some = texts.filter(marked)
            marks = pc.utf8_ltrim(some, NO_MARKS).dictionary_encode()
            numbers = self._numbers(self.words, [" " + m for m in _strings(marks.dictionary)], self._learn)
            mark[marked.to_numpy(zero_copy_only=False)] = numbers[marks.indices.to_numpy()]
            stems = pc.replace_with_mask(texts, marked, pc.utf8_rtrim(some, MARKS))
        coded_stems = stems.dictionary_encode()
        number = self._numbers(self.words, _strings(coded_stems.dictionary), self._learn)
        # a part's ids are those of its word, and of the mark behind it or nothing
        both = np.stack([number[coded_stems.indices.to_numpy()], mark], axis=1).ravel()
        ids, sizes = self.words.gather(both)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[::2], coded.indices.to_numpy()

    def _numbers(self, of: Entries, words: list[str], learn) -> np.ndarray:
        """The entries of different words."""
        numbers = np.fromiter(map(of.numbers.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            some = [words[i] for i in unknown.tolist()]
            for at in range(0, len(some), LEARNED_AT_ONCE):  # lists of ids are large
                learn(some[at : at + LEARNED_AT_ONCE])
            numbers[unknown] = np.fromiter(map(of.numbers.__getitem__, some), np.int64, len(some))
        of.met[numbers] += 1
        return numbers

    def _parts(self, texts: pa.Array, loose: bool) -> tuple[pa.Array, np.ndarray]:
        """All parts of all texts, each text behind a newline, and where each text's parts begin."""
        if loose:
            cut = pc.replace_substring_regex(pc.replace_substring_regex(texts, RUN, r"\1 \2 \3"), SINGLE, r"\1 \2")
        else:
            cut = pc.replace_substring(texts, "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", cut, ""), " ")
        return parts.flatten(), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()

    def _uneven_parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        """All parts but the texts' first ones, where each text's parts begin, and the ids of the first ones."""
        cut = [CUT.split(t) for t in _strings(texts)]
        first = pa.array([parts[0] for parts in cut], pa.string()).dictionary_encode()
        numbers = self._numbers(self.starts, _strings(first.dictionary), lambda words: self._add(self.starts, words, self._library(words)))
        ids, sizes = self.starts.gather(numbers[first.indices.to_numpy()])
        begins = np.cumsum([0, *(len(parts) - 1 for parts in cut)], dtype=np.int64)
        return pa.array([p for parts in cut for p in parts[1:]], pa.string()), begins, np.split(ids, np.cumsum(sizes)[:-1])

    def _encode(self, texts: pa.Array, loose: bool, uneven: bool) -> list[np.ndarray]:
        if self.words.over():
            self.words = self.words.often_met(1)
        if self.starts.over():
            self.starts = self.starts.often_met(0)
        if uneven:
            parts, begins, first = self._uneven_parts(texts)
        else:
            parts, begins = self._parts(texts, loose)
        part_ids, part_ends, which = self._different(parts)
        del parts
        skipped = 0 if uneven else len(self.newline)
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            low = len(out)
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + GATHER_PARTS, side="right")) - 1)
            ids, sizes = _gather(part_ids, part_ends, which[begins[low] : begins[high]])
            ends = np.concatenate(([0], np.cumsum(sizes)))[begins[low : high + 1] - begins[low]].tolist()
            out += [ids[a + skipped : b] for a, b in zip(ends[:-1], ends[1:])]
        return [np.concatenate(both) for both in zip(first, out)] if uneven else out

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        uneven, loose = (pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False) for p in (self.uneven, LOOSE))
        # texts with uneven spaces or loose newlines are cut by themselves, so that they do not hold up the others
        kind = np.where(uneven, 2, loose.astype(np.int64))
        if not kind.any():
            return self._encode(column, False, False)
        out: list[np.ndarray | None] = [None] * len(column)
        for k in range(3):
            at = np.flatnonzero(kind == k)
            if len(at):
                for i, ids in zip(at.tolist(), self._encode(column.take(pa.array(at)), k == 1, k == 2)):
                    out[i] = ids
        return out


# ---- grammar

def _in_order(left: np.ndarray, right: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols of so many bits as one number each, in ascending order, and their places, ascending for equal pairs."""
    pairs = left << bits
    pairs |= right
    place_bits = int(places[-1]).bit_length() if len(places) else 0
    if 2 * bits + place_bits > 63:
        order = np.argsort(pairs, kind="stable")
        return pairs[order], places[order]
    # plain numbers are sorted much faster than an order of them is found
    pairs <<= place_bits
    pairs |= places
    pairs.sort()
    return pairs >> place_bits, pairs & ((1 << place_bits) - 1)


def repair(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules, base): Re-Pair grammar of a shard.

    Every round replaces all pairs that stand at least so often by new symbols from ``base`` on, where
    they do not overlap, the left one first; the next round asks for a ``STEP``-th of the count, down
    to ``min_count``, at which rounds repeat until no pair is left. No pair begins with the end
    id, so no symbol crosses from one document to the next.
    """
    base = int(ids.max(initial=0)) + 1
    sequence = ids.astype(np.int64)
    rules = [np.zeros((0, 2), np.int64)]
    level, symbols, newest = max(min_count, int(len(ids) * FIRST_SHARE)), base, 0
    while len(sequence) > 1:
        bits = symbols.bit_length()
        if newest:
            # all pairs were counted at this level, so only those of the last round's symbols can have become frequent
            new = np.flatnonzero(sequence >= newest)
            places = np.sort(np.concatenate((new, new[np.diff(new, prepend=-1) != 1] - 1)))
            places = places[: np.searchsorted(places, len(sequence) - 1)]
            pairs, places = _in_order(sequence[places], sequence[places + 1], places, bits)
        else:
            pairs, places = _in_order(sequence[:-1], sequence[1:], np.arange(len(sequence) - 1), bits)
        begins = np.flatnonzero(np.diff(pairs, prepend=-1))
        counts = np.diff(begins, append=len(pairs))
        found = pairs[begins]
        frequent = (counts >= level) & (found >> bits != END_ID)
        if frequent.any():
            found = found[frequent]
            hits = places[np.repeat(frequent, counts)] << 32
            hits |= np.repeat(np.arange(len(found)), counts[frequent])
            hits.sort()
            places = hits >> 32
            # of touching places take the first, third, ..
            begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            take = (np.arange(len(places)) - np.repeat(begins, np.diff(begins, append=len(places)))) % 2 == 0
            places, number = places[take], hits[take] & 0xFFFFFFFF
            used = np.zeros(len(found), dtype=bool)
            used[number] = True
            found = found[used]
            rules.append(np.stack([found >> bits, found & ((1 << bits) - 1)], axis=1))
            newest = symbols if level == min_count else 0
            sequence[places] = (symbols - 1 + np.cumsum(used))[number]
            symbols += len(found)
            keep = np.ones(len(sequence), dtype=bool)
            keep[places + 1] = False
            sequence = sequence[keep]
        elif level <= min_count:
            break
        level = max(min_count, level // STEP)
    return sequence.astype("<u4"), np.concatenate(rules).astype("<u4"), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each rule stands for."""
    inner = rules.astype(np.int64) - base
    is_rule = inner >= 0
    inner[~is_rule] = 0
    lengths = np.zeros(len(rules), dtype=np.int64)
    while True:  # once for each rule inside a rule inside a rule
        longer = np.where(is_rule, lengths[inner], 1).sum(axis=1) if len(rules) else lengths
        if (longer == lengths).all():
            return lengths.astype("<u4")
        lengths = longer


def _opened(symbols: np.ndarray, rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of symbols, all rules opened at once until none is left, and how many each symbol gave."""
    owner = np.arange(len(symbols))
    while len(symbols) and (is_rule := symbols >= base).any():
        at = np.arange(len(symbols)) + np.cumsum(is_rule) - is_rule
        out = np.empty(len(symbols) + int(is_rule.sum()), dtype=np.int64)
        out[at] = symbols
        opened = rules[symbols[is_rule] - base]
        out[at[is_rule]], out[at[is_rule] + 1] = opened[:, 0], opened[:, 1]
        symbols, owner = out, np.repeat(owner, 1 + is_rule)
    return symbols, owner


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a run of symbols: each rule that occurs is opened once and its ids are copied to its places."""
    symbols = symbols.astype(np.int64)
    is_rule = symbols >= base
    rule = symbols[is_rule] - base
    seen = np.zeros(len(rules), dtype=bool)
    seen[rule] = True
    ids, owner = _opened(np.flatnonzero(seen) + base, rules, base)
    number = (np.cumsum(seen) - 1)[rule]
    size = np.bincount(owner, minlength=int(seen.sum()))
    sizes, begin = np.ones(len(symbols), np.int64), len(ids) + np.arange(len(symbols))
    sizes[is_rule], begin[is_rule] = size[number], (np.cumsum(size) - size)[number]
    total = np.cumsum(sizes)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - sizes), sizes)
    return np.concatenate((ids, symbols))[at].astype("<u4")


# ---- shard format: magic, then five counts, then the arrays, all little-endian

def pack_shard(ids: np.ndarray, doc_ends: np.ndarray) -> bytes:
    """A shard's bytes: magic, (documents, rules, symbols, base, 0) as u32, document ends as
    u64, rule pairs as u32, expansion lengths as u32, symbols as u32."""
    sequence, rules, base = repair(ids)
    lengths = expansion_lengths(rules, base)
    head = np.array([len(doc_ends), len(rules), len(sequence), base, 0], dtype="<u4")
    return b"".join([MAGIC, head.tobytes(), doc_ends.astype("<u8").tobytes(), rules.tobytes(), lengths.tobytes(), sequence.tobytes()])


class Shard:
    """Reader of one shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, n_rules, n_symbols, self.base, _ = np.frombuffer(data, "<u4", 5, 8).tolist()
        at = 28
        self.ends = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * n_rules
        lengths = np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)
        self.sequence = np.frombuffer(data, "<u4", n_symbols, at + 4 * n_rules).astype(np.int64)
        is_rule = self.sequence >= self.base
        sizes = np.ones(n_symbols, dtype=np.int64)
        sizes[is_rule] = lengths[self.sequence[is_rule] - self.base]
        self.places = np.cumsum(sizes)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``; only the symbols that cover them are expanded."""
        first, last = np.searchsorted(self.places, [start, end], side="right")[0], np.searchsorted(self.places, end, side="left")
        before = int(self.places[first - 1]) if first else 0
        return expand(self.sequence[first : last + 1], self.rules, self.base)[start - before : end - before]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def all_ids(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.base)


# ---- Spark jobs

_encoders: dict[str, LibraryEncoder] = {}


def _encoder(content: str) -> LibraryEncoder:
    if content not in _encoders:
        _encoders.clear()
        _encoders[content] = LibraryEncoder(content)
    return _encoders[content]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``SLICE_BYTES``, as equal words of a slice are looked up once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents of about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of every whole text, each document closed by id 0, in ascending doc_id order.

    Rows are dealt by ranges of doc_id and sorted; a task cuts its range into shards of about
    ``shard_tokens`` ids (whole documents) and compresses each. Files hold (part, shard, doc_ids, n_tokens, data),
    ``part`` rising with doc_id. A null text is an empty document, a null doc_id comes first, rows of equal doc_id
    follow in the order of their texts. Only doc_id and text are read. An empty table gives an empty table.
    """
    content = Path(tokenizer_path).read_text()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(content), 0
        ids, ends, names, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, ends, names, size
            data = pack_shard(np.concatenate(ids), np.array(ends, dtype=np.int64))
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([number], pa.int32()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "n_tokens": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary()),
            })
            number, ids, ends, names, size = number + 1, [], [], [], 0
            return row

        end = np.array([END_ID], "<u4")
        for batch in _gathered(batches):
            for part in _slices(batch):
                for doc_id, made in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids += (made, end)
                    size += len(made) + 1
                    ends.append(size)
                    names.append(doc_id)
                    if size >= shard_tokens:
                        yield close()
        if names:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    made = ordered.mapInArrow(shards, "shard int, doc_ids array<bigint>, n_tokens bigint, data binary")
    spark = docs.sparkSession
    before = spark.conf.get(ARROW_ROWS)
    # a batch of whole texts lies in memory on both sides of the pipe, in buffers that double as they grow
    spark.conf.set(ARROW_ROWS, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        made.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it: sums per part (one row each), then
    shards within a part, then the ends inside the shard.
    """
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("shard_start"))
    starts = shards.join(offsets, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, doc_ids, data in zip(*(batch.column(i) for i in range(4))):
                reader = Shard(data.as_py())
                ids, ends = reader.all_ids(), reader.ends
                begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part.as_py()] * len(ends), pa.int32()),
                    "shard": pa.array([shard.as_py()] * len(ends), pa.int32()),
                    "doc_id": doc_ids.values, "begin": pa.array(begins), "n_tokens": pa.array(ends - begins),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64()),
                })

    rows = files.select("part", "shard", "doc_ids", "data").mapInArrow(
        documents_of, "part int, shard int, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    import public_tokenizers

    path = scratch_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)
