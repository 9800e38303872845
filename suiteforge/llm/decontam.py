"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of consecutive documents of one task, about
``common.BLOCK_BYTES`` of text.  Its words become symbols: each word of the
benchmark block has a number, and every stretch of other words is a separator.
Stretches of benchmark words shorter than the shortest phrase can hold no
occurrence and are left out; nothing else is.  Over that sequence the task
builds a suffix array, its Burrows-Wheeler transform, and a wavelet matrix
whose ranks drive the backward search of all phrases at once.  Rows of the
found ranges walk back to the next sampled suffix position, which gives the
place of each occurrence; occurrences merge into removal spans.

The benchmark is the stated query set: it goes to the tasks in blocks of
bounded size (``block_bytes``), one pass over the documents for each block.

Defined results: null text has no words; an item without words has no phrase;
an item of fewer words than ``width`` is one phrase; a null item id marks words
but is not listed; repeated items count once; repeated documents get equal
rows; empty tables give no hits or no rows; ``find`` ignores extra columns,
``remove`` keeps them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, blocks, map_batches, stored, text_bytes, words

WIDTH = 10
SAMPLE_EVERY = 8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.shifts = range(max(1, int(alphabet).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for shift in self.shifts:
            bits = (symbols >> shift) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bits))).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        every = np.arange(alphabet + 1)
        self.first = np.zeros(alphabet + 1, np.int64)
        self.first = self.rank(every, np.zeros(alphabet + 1, np.int64))

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``before``."""
        at = before
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            up = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + up, at - up)
        return at - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            up = ones[at]
            bit = ones[at + 1] - up
            symbol |= bit.astype(np.int64) << shift
            at = np.where(bit, zeros + up, at - up)
        return symbol, at - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; separators (0) sort by place, so no comparison runs past one."""
    n = len(symbols)
    cuts = symbols == 0
    rank = symbols + np.int64(cuts.sum())
    rank[cuts] = np.arange(cuts.sum())
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= 2 * n:
            return order


class FMIndex:
    """Over symbols 1..alphabet with 0 as separator; the sequence ends in a separator."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_array(symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))))
        self.tree = WaveletMatrix(symbols[order - 1], alphabet)  # the last symbol stands before the first
        sampled = (order % SAMPLE_EVERY == 0) | (symbols[order - 1] == 0)
        self.marks = sampled
        self.mark_rank = np.cumsum(sampled) - 1
        self.places = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (one row each, equal length) that occur: their row numbers and their ranges of suffixes."""
        rows = np.arange(len(phrases))
        low, high = self.before[phrases[:, -1]], self.before[phrases[:, -1] + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            some = low < high
            rows, low, high = rows[some], low[some], high[some]
            if not len(rows):
                break
            symbol = phrases[rows, column]
            low = self.before[symbol] + self.tree.rank(symbol, low)
            high = self.before[symbol] + self.tree.rank(symbol, high)
        some = low < high
        return rows[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix: steps back to the nearest sampled place, plus that place."""
        places, walk, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64)
        steps = 0
        while len(walk):
            done = self.marks[at]
            places[walk[done]] = self.places[self.mark_rank[at[done]]] + steps
            walk, at = walk[~done], at[~done]
            if len(walk):
                symbol, rank = self.tree.access(at)
                at = self.before[symbol] + rank
            steps += 1
        return places


@dataclass
class Phrases:
    """A block of benchmark phrases: the word numbers, and by phrase length the phrases and their items."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], width: int = WIDTH) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found[min(width, len(own))][tuple(own[i : i + width])].update([item] if item is not None else [])
        return cls(vocabulary, {n: (np.array(list(p), np.int64), [sorted(x) for x in p.values()]) for n, p in sorted(found.items())})


def occurrences(texts: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """One shard: places (word numbers over all texts) and lengths of all occurrences, their phrase numbers, each phrase's items."""
    owners = [x for _, own in phrases.by_length.values() for x in own]
    none = np.zeros(0, np.int64)
    if not owners:
        return none, none, none, owners
    get = phrases.vocabulary.get
    total = sum(map(len, texts)) + len(texts)
    ids = np.zeros(total + 1, np.int64)
    at = 0
    for own in texts:
        ids[at : at + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
        at += len(own) + 1  # a separator between documents
    # stretches of known words that are long enough, each with the separator after it
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    long = end - start >= min(phrases.by_length)
    start, size = start[long], end[long] - start[long] + 1
    if not len(start):
        return none, none, none, owners
    place = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    index = FMIndex(ids[place], len(phrases.vocabulary))
    places, lengths, numbers, base = [], [], [], 0
    for length, (rows, _) in phrases.by_length.items():
        which, low, high = index.search(rows)
        count = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        places.append(place[index.locate(at)])
        lengths.append(np.full(len(at), length))
        numbers.append(base + np.repeat(which, count))
        base += len(rows)
    return np.concatenate(places), np.concatenate(lengths), np.concatenate(numbers), owners


def find_in(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each text (its words): merged spans (first word, number of words) and the sorted items that occur."""
    out: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
    places, lengths, numbers, owners = occurrences(texts, phrases)
    if not len(places):
        return out
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    cover = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + lengths, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        doc = int(np.searchsorted(starts, a, "right")) - 1
        out[doc][0].append((a - int(starts[doc]), b - a))
    docs = np.searchsorted(starts, places, "right") - 1
    items = defaultdict(set)
    for doc, number in np.unique(np.stack([docs, numbers], 1), axis=0).tolist():
        items[doc].update(owners[number])
    for doc, own in items.items():
        out[doc] = (out[doc][0], sorted(own))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as disjoint spans that do not touch."""
    out: list[tuple[int, int]] = []
    for start, size in sorted(spans):
        if out and start <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), start + size) - out[-1][0])
        else:
            out.append((start, size))
    return out


class PhraseBlocks:
    """The benchmark as ``n`` blocks of about ``block_bytes`` of text; iterating reads one block after the other."""

    def __init__(self, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text"):
        rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
        self.items, self.width = rows.where("text is not null").distinct(), width
        size = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, -(-size // block_bytes))

    def __iter__(self) -> Iterator[Phrases]:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(self.n))
        for i in range(self.n):
            yield Phrases.of([(r.item, r.text.encode()) for r in self.items.where(part == i).sort("item", "text").toLocalIterator()], self.width)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: its word count, merged removal spans (in words), and the items that occur in it."""
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.expr("array()").cast("array<struct<start:int,size:int>>").alias("_spans"), F.expr("array()").cast("array<string>").alias("_items"))
    parts = PhraseBlocks(benchmark, width, block_bytes)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
    for number, part in enumerate(parts, 1):
        held = docs.sparkSession.sparkContext.broadcast(part)  # bounded by block_bytes

        def run(b: pa.RecordBatch, held=held, last=number == parts.n) -> pa.RecordBatch:
            texts, spans, items, sizes = text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), []
            for start, end in blocks(map(len, texts)):
                own = [words(t) for t in texts[start:end]]
                sizes += map(len, own)
                for i, (more, names) in enumerate(find_in(own, held.value), start):
                    if more:
                        spans[i] = [{"start": s, "size": n} for s, n in merge([*((x["start"], x["size"]) for x in spans[i]), *more])]
                        items[i] = sorted({*items[i], *names})
            first = pa.array(sizes, pa.int64()) if last else b.column(1)
            return pa.RecordBatch.from_arrays([b.column(0), first, pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], names=["_id", "_words" if last else "_text", "_spans", "_items"])

        out = map_batches(out, run, f"_id {kind}, {'_words long' if number == parts.n else '_text string'}, _spans array<struct<start:int,size:int>>, _items array<string>")
    return out.select(F.col("_id").alias(id_col), F.col("_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(WORD_TABLE))]
    kept, end = [], 0
    for start, size in spans:
        kept.append(text[end : at[start][0]])
        end = at[start + size - 1][1]
    return b"".join([*kept, text[end:]])


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", chars_col: str = "n_chars", block_bytes: int = 8 << 20) -> DataFrame:
    """The documents without their removal spans; all columns kept, ``chars_col`` (if there) set anew where a text changed.

    The spans of all blocks of the benchmark are merged, cut at once, and the
    search repeats on what was cut until no phrase is left, so the result does
    not depend on the blocks.  A document of which no word is left goes; one
    that never had a word stays.
    """
    parts = PhraseBlocks(benchmark, width, block_bytes)
    place = docs.columns.index(text_col)
    if parts.n == 1:  # nothing to merge: each task searches and cuts until its texts are clean
        held = docs.sparkSession.sparkContext.broadcast(next(iter(parts)))  # bounded by block_bytes

        def clean(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, changed = text_bytes(b.column(place)), {}
            for start, end in blocks(map(len, texts)):
                todo = list(range(start, end))
                while todo:
                    found = find_in([words(texts[i]) for i in todo], held.value)
                    todo = [i for i, (spans, _) in zip(todo, found, strict=True) if spans]
                    for i, spans in zip(todo, (s for s, _ in found if s), strict=True):
                        texts[i] = changed[i] = cut(texts[i], spans)
            return _with_texts(b, changed, place, chars_col)

        return map_batches(docs, clean, docs.schema)

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(True).alias("open"))
    spans_type = "array<struct<start:int,size:int>>"
    while True:
        work = given.withColumn("spans", F.array().cast(spans_type))
        for part in parts:
            held = docs.sparkSession.sparkContext.broadcast(part)
            work = stored(map_batches(work, _searcher(held), work.schema))
            held.destroy()
        given = stored(map_batches(work, _cut_all, given.schema))
        if given.where("open").isEmpty():
            break
    changed = F.col("text").isNotNull() & ~F.col(f"given.`{text_col}`").eqNullSafe(F.col("text"))
    out = given.where(~changed | F.col("text").rlike(_ANY_WORD))
    columns = {c: F.col(f"given.`{c}`") for c in docs.columns}
    columns[text_col] = F.col("text")
    if chars_col in columns:
        columns[chars_col] = F.when(changed, F.length("text").cast(dict(docs.dtypes)[chars_col])).otherwise(columns[chars_col])
    return out.select(*[c.alias(name) for name, c in columns.items()])


#: A character of a word.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _with_texts(b: pa.RecordBatch, changed: dict[int, bytes], place: int, chars_col: str) -> pa.RecordBatch:
    """The batch with its changed texts, without the documents of which no word is left."""
    if not changed:
        return b
    columns = list(b.columns)
    was = columns[place]
    columns[place] = pa.array([changed[i].decode() if i in changed else was[i].as_py() for i in range(b.num_rows)], was.type)
    if chars_col in b.schema.names:
        at = b.schema.names.index(chars_col)
        columns[at] = pa.array([len(changed[i].decode()) if i in changed else columns[at][i].as_py() for i in range(b.num_rows)], columns[at].type)
    keep = [i not in changed or bool(words(changed[i])) for i in range(b.num_rows)]
    return pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep))


def _searcher(held):
    """Adds a block's spans to those that are there, for the texts that are still open."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, opened, spans = text_bytes(b.column("text")), b.column("open").to_pylist(), b.column("spans").to_pylist()
        for start, end in blocks(map(len, texts)):
            todo = [i for i in range(start, end) if opened[i]]
            for i, (more, _) in zip(todo, find_in([words(texts[i]) for i in todo], held.value), strict=True):
                if more:
                    spans[i] = [{"start": s, "size": n} for s, n in merge([*((x["start"], x["size"]) for x in spans[i]), *more])]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, b.schema.field("spans").type)], names=b.schema.names)

    return run


def _cut_all(b: pa.RecordBatch) -> pa.RecordBatch:
    """Cuts the spans; a text that was cut stays open, the others are clean."""
    texts, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
    texts = [cut(t.encode(), [(x["start"], x["size"]) for x in s]).decode() if s else t for t, s in zip(texts, spans, strict=True)]
    return pa.RecordBatch.from_arrays([b.column("given"), pa.array(texts, pa.string()), pa.array([bool(s) for s in spans])], names=["given", "text", "open"])
