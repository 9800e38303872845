"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. Texts with the same words are one node (64-bit hash of the word sequence; a
   text without words is a node by its bytes).  Everything below is per node.
2. A shingle (five words; fewer if the text has no more) weighs
   (1 + ln tf) * idf, and every shingle has its own idf: ln(N / df) / ln(1 / rare),
   at least 0.05.  df counts distinct document sketches (each text's smallest
   shingle hash), so that passages shared by different texts lose weight and
   copies of one text do not.  Above the document share ``rare`` df is exact:
   each chunk of documents proposes those above the share in the chunk (a
   shingle above it overall is above it somewhere), and a second pass counts
   the proposals.  For all others df is estimated from a table of fixed size:
   each of ``CELLS`` cells keeps ``REGISTERS`` smallest draws of the sketches
   whose texts hold one of its shingles.  The smallest do not change by copies,
   nor by how documents are dealt to tasks.  Shingles that share a cell raise
   its df, so in a large corpus the rarest shingles weigh alike, at about
   ln(N * CELLS / distinct pairs of shingle and sketch); four draws know ln df
   to about 0.5.  A shingle weighs the same in all texts.
3. Each node draws ``bands * band_rows`` consistent weighted samples; equal
   samples in all rows of a band put nodes into one bucket.
4. Nodes of a bucket are compared by exact weighted Jaccard similarity.  Loose
   components of buckets travel together to one task, which compares nodes that
   share a bucket and are not linked yet.  A component of more than
   ``task_nodes`` nodes goes bucket by bucket instead, and a bucket of more
   nodes in a grid of block pairs, so no task holds more than two blocks.
5. Links of ``threshold`` or more make the classes; the class id is the
   smallest document id in it.

Defined results: null text counts as empty; texts without words are copies of
each other only if equal; a null id never names a class unless all ids of the
class are null; repeated rows share a class; ``keep_one`` keeps one row of
each class; empty tables give no rows; extra columns are ignored by
``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, stored, text_bytes, words
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
BANDS, BAND_ROWS = 16, 4
RARE = 0.05
#: Shingle ids have 48 bits, so that a block of up to 2 ** 16 texts sorts them with its row numbers in one word.
BITS = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Shingled:
    """Shingles of a block of texts: ids sorted by text, how often each occurs, where each text starts; node ids."""

    ids: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray

    def sketches(self) -> np.ndarray:
        """For each text its smallest mixed shingle (0 where it has none)."""
        out = np.zeros(len(self.starts) - 1, np.uint64)
        some = np.diff(self.starts) > 0
        if len(self.ids):
            out[some] = np.minimum.reduceat(_mixed(self.ids * _MULTIPLY), self.starts[:-1][some])
        return out


def node_of(text: bytes, own: list[bytes] | None = None) -> int:
    """The node of a text, a signed 64-bit hash: of its word sequence, or of its bytes where it has no word."""
    own = words(text) if own is None else own
    bits = xxhash.xxh64_intdigest(b" ".join(own), 1) if own else xxhash.xxh64_intdigest(text, 2)
    return bits - (bits >> 63 << 64)


def shingled(texts: list[bytes], hashes: WordHashes) -> Shingled:
    """The shingles of up to 2 ** 16 texts."""
    own = [words(t) for t in texts]
    sizes = np.array([len(w) for w in own], np.int64)
    flat = np.concatenate([np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in own] or [np.zeros(0, np.uint64)])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    with np.errstate(over="ignore"):
        rolled = flat.copy()
        for i in range(1, SHINGLE):
            rolled[: len(flat) - i] = rolled[: len(flat) - i] * _MULTIPLY + flat[i:] if len(flat) > i else rolled[:0]
        doc = np.repeat(np.arange(len(own)), sizes)
        whole = np.arange(len(flat)) + SHINGLE <= ends[doc] if len(flat) else np.zeros(0, bool)
        keys, docs = _mixed(rolled[whole]), doc[whole]
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        if len(short):
            keys = np.concatenate((keys, np.array([xxhash.xxh64_intdigest(b" ".join(own[i]), 5) for i in short], np.uint64)))
            docs = np.concatenate((docs, short))
        packed = np.sort((docs.astype(np.uint64) << BITS) | (keys >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(packed)])))
    packed = packed[first]
    nodes = np.array([node_of(t, w) for t, w in zip(texts, own, strict=True)], np.int64)
    return Shingled(packed & _MASK, counts, np.searchsorted(packed >> BITS, np.arange(len(own) + 1).astype(np.uint64)), nodes)


@dataclass
class Idf:
    """Weights of the frequent shingles, sorted by id; all others weigh what the level of their cell does (one without levels)."""

    ids: np.ndarray
    weights: np.ndarray
    levels: np.ndarray | None = None
    by_level: np.ndarray | None = None

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), np.float32) if self.levels is None else self.by_level[self.levels[cell_of(ids)]]
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            out[hit] = self.weights[at[hit]]
        return out


#: Cells of the table of document frequencies, smallest draws in each, cells in a part of the table that travels as one row.
CELL_BITS, REGISTERS, PART = 22, 4, 1 << 14
CELLS = 1 << CELL_BITS
#: A draw of e is kept as the byte 1 + 6 * (6 - log2 e): a greater byte is a smaller draw, none is 0.
_DRAW_STEPS, _DRAW_TOP = 6, 6
#: Levels of ln df.
LEVEL_STEPS = 8


def cell_of(ids: np.ndarray) -> np.ndarray:
    """The cell of a shingle: the upper bits of its id."""
    return (ids >> (BITS - np.uint64(CELL_BITS))).view(np.int64)


class Frequencies:
    """For each cell the smallest of exponential draws that the document sketches make, one for each register."""

    def __init__(self):
        self.table = np.zeros((REGISTERS, CELLS), np.uint8)

    def add(self, ids: np.ndarray, sketches: np.ndarray) -> None:
        """Shingles with the sketches of their documents, in any order and any number of times."""
        cells = cell_of(ids)
        for j, own in enumerate(self.table):
            np.maximum.at(own, cells, self.draws(sketches, j))

    @staticmethod
    def draws(sketches: np.ndarray, register: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            bits = _mixed(_mixed((sketches + np.uint64(register + 1)) * _MULTIPLY) * _MULTIPLY)
        e = -np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        return np.clip(1 + _DRAW_STEPS * (_DRAW_TOP - np.log2(e)), 1, 255).astype(np.uint8)

    def parts(self) -> tuple[list[int], list[bytes]]:
        """The parts that hold anything, compressed, with their numbers."""
        out = ([], [])
        for part in range(CELLS // PART):
            own = self.table[:, part * PART : (part + 1) * PART]
            if own.any():
                out[0].append(part)
                out[1].append(pa.compress(own.tobytes(), codec="zstd", asbytes=True))
        return out


def merged_levels(parts: list[bytes]) -> np.ndarray:
    """The levels of ln df of one part's cells from the tables of all tasks."""
    table = np.zeros((REGISTERS, PART), np.uint8)
    for part in parts:
        own = pa.decompress(part, decompressed_size=table.size, codec="zstd", asbytes=True)
        np.maximum(table, np.frombuffer(own, np.uint8).reshape(table.shape), out=table)
    total = np.exp2(_DRAW_TOP - (table.astype(np.float64) - 0.5) / _DRAW_STEPS).sum(axis=0)
    # the sum of the smallest draws of df sketches is gamma distributed: the mean of its logarithm is digamma(REGISTERS) - ln df
    digamma = sum(1 / k for k in range(1, REGISTERS)) - 0.5772156649015329
    return np.clip(np.rint(LEVEL_STEPS * (digamma - np.log(total))), 0, 255).astype(np.uint8)


def weights(s: Shingled, idf: Idf) -> np.ndarray:
    return ((1 + np.log(s.counts)) * idf.of(s.ids)).astype(np.float32)


class Sampler:
    """ICWS with pooled variates: in each sample a shingle picks one of 2 ** 14 triples (r, c, beta).

    ln a = ln c - r * (floor(ln w / r + beta) - beta) - r; the sample is the
    shingle of the smallest a (of shingles with equal triples, the one with the
    smallest further hash bits).  Two texts agree in a sample about as often as
    their weighted Jaccard similarity says.
    """

    POOL_BITS = 14
    #: Shingles that one step works on: their arrays stay in the processor's cache.
    PIECE = 1 << 14

    def __init__(self, samples: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        shape = (samples, 1 << self.POOL_BITS)
        self.r = draw.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, shape)).astype(np.float32)
        self.beta = draw.random(shape, np.float32)
        self.factors = draw.integers(1, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.per_r, self.base = 1 / self.r, self.log_c + self.r * self.beta - self.r

    def __call__(self, s: Shingled, weight: np.ndarray) -> np.ndarray:
        """The samples of each text that has shingles: one row of words each; the high half of a word is a, as positive floats sort as their bits do."""
        some = np.diff(s.starts) > 0
        starts = s.starts[:-1][some]
        out = np.zeros((int(some.sum()), len(self.factors)), np.uint64)
        if not len(starts):
            return out
        log_w = np.log(weight)
        spread = s.ids * _MULTIPLY
        value = np.empty(len(spread), np.uint64)
        pieces = [(spread[i : i + self.PIECE], log_w[i : i + self.PIECE], value[i : i + self.PIECE]) for i in range(0, len(spread), self.PIECE)]
        for j, factor in enumerate(self.factors):
            for own, own_log_w, own_value in pieces:
                self._words(j, own * factor, own_log_w, own_value)
            out[:, j] = np.minimum.reduceat(value, starts)
        return out

    def _words(self, j: int, bits: np.ndarray, log_w: np.ndarray, value: np.ndarray) -> None:
        at = (bits >> np.uint64(64 - self.POOL_BITS)).view(np.int64)
        x = self.per_r[j].take(at)
        x *= log_w
        x += self.beta[j].take(at)
        np.floor(x, out=x)
        x *= self.r[j].take(at)
        np.subtract(self.base[j].take(at), x, out=x)
        np.exp(x, out=x)
        value[:] = x.view(np.uint32)
        value <<= np.uint64(32)
        bits >>= np.uint64(18)
        bits &= np.uint64(0xFFFFFFFF)
        value |= bits


def sampler_of(samples: int) -> Sampler:
    """One per worker process: its tables are drawn once, not for every task or group."""
    kept = vars(sys).setdefault("_weighted_samplers", {})
    if samples not in kept:
        kept[samples] = Sampler(samples)
    return kept[samples]


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each text; the band's number is part of it."""
    rows = samples.reshape(len(samples), bands, samples.shape[1] // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        key = _mixed(key * _MULTIPLY + rows[:, :, i])
    return key.view(np.int64)


def _blocks_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = text_bytes(batch.column(column))
    for start, end in blocks(map(len, texts)):
        for a in range(start, end, 1 << 16):
            yield a, min(end, a + (1 << 16)), texts[a : min(end, a + (1 << 16))]


@dataclass
class Chunk:
    """Shingle ids of some documents, each with its document's sketch."""

    ids: np.ndarray
    sketches: np.ndarray
    docs: int
    size: int


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Chunk]:
    """Chunks of ``limit`` to twice as many text bytes (a smaller one only if there is no more)."""
    hashes, held = WordHashes(), []
    for batch in batches:
        for _, _, part in _blocks_of(batch, 0):
            s = shingled(part, hashes)
            held.append(Chunk(s.ids, np.repeat(s.sketches(), np.diff(s.starts)), len(part), sum(map(len, part))))
            if sum(c.size for c in held) >= 2 * limit:
                yield _joined(held[: len(held) // 2])
                held = held[len(held) // 2 :]
    if held:
        yield _joined(held)


def _joined(parts: list[Chunk]) -> Chunk:
    return Chunk(np.concatenate([c.ids for c in parts]), np.concatenate([c.sketches for c in parts]), sum(c.docs for c in parts), sum(c.size for c in parts))


def _distinct(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of shingle and sketch, sorted."""
    order = np.lexsort((chunk.sketches, chunk.ids))
    ids, sketches = chunk.ids[order], chunk.sketches[order]
    first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (sketches[1:] != sketches[:-1]))) if len(ids) else np.zeros(0, bool)
    return ids[first], sketches[first]


def proposals(chunk: Chunk, rare: float) -> np.ndarray:
    """Shingles that more than ``rare`` of the chunk's documents hold, by distinct sketches."""
    least = rare * chunk.docs
    ids, counts = np.unique(chunk.ids, return_counts=True)
    often = np.isin(chunk.ids, ids[counts > least]) if (counts > least).any() else np.zeros(len(chunk.ids), bool)
    ids, counts = np.unique(_distinct(Chunk(chunk.ids[often], chunk.sketches[often], 0, 0))[0], return_counts=True)
    return ids[counts > least]


def idf_of(docs: DataFrame, text_col: str = "text", rare: float = RARE, chunk_bytes: int = 6 << 20, block_ids: int = 2_000_000) -> Idf:
    """Exact counts of the shingles above the share ``rare``; there are at most (mean shingles per text) / ``rare``.  Estimates of all others.

    Proposals are counted in blocks of about ``block_ids``, one pass each.  The
    pass that proposes also fills the table of frequencies, which tasks hand on
    in compressed parts; parts are merged by shuffle, and the driver gets one
    byte for each cell.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["id", "part", "cells"], None
        for chunk in _chunks(batches, chunk_bytes):
            seen = seen or Frequencies()
            seen.add(chunk.ids, chunk.sketches)
            own = pa.array(proposals(chunk, rare).view(np.int64))
            yield pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())], names=names)
        if seen is not None:
            parts, cells = seen.parts()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(cells, pa.binary())], names=names)

    def merge(rows: pa.Table) -> pa.Table:
        levels = merged_levels(rows.column("cells").to_pylist())
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    passed = stored(texts.mapInArrow(propose, "id long, part int, cells binary"))
    levels = np.zeros(CELLS, np.uint8)
    for row in passed.where("part is not null").select("part", "cells").groupBy("part").applyInArrow(merge, "part int, levels binary").toLocalIterator():
        levels[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.levels, np.uint8)
    proposed = stored(passed.where("id is not null").select("id").distinct())
    n_docs, n_ids = docs.count(), proposed.count()
    n_blocks = -(-n_ids // block_ids)
    rows = []
    for block in range(n_blocks):
        own = proposed.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).toArrow().column("id").to_numpy()
        held = docs.sparkSession.sparkContext.broadcast(np.sort(own.view(np.uint64)))

        def occurrences(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches, chunk_bytes):
                at = np.minimum(np.searchsorted(held.value, chunk.ids), len(held.value) - 1)
                use = held.value[at] == chunk.ids
                ids, sketches = _distinct(Chunk(chunk.ids[use], chunk.sketches[use], 0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(sketches.view(np.int64))], names=["id", "sketch"])

        counted = texts.mapInArrow(occurrences, "id long, sketch long").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        rows += counted.where(F.col("n") > rare * n_docs).collect()
    rows.sort(key=lambda r: r.id % (1 << 64))
    full = math.log(1 / rare)
    exact = [min(1.0, max(0.05, math.log(n_docs / r.n) / full)) for r in rows]
    # what is not above the share weighs one at least
    by_level = np.maximum(1.0, (math.log(max(n_docs, 1)) - np.arange(256) / LEVEL_STEPS) / full).astype(np.float32)
    return Idf(np.array([r.id for r in rows], np.int64).view(np.uint64), np.array(exact, np.float32), levels, by_level)


class Links:
    """Links between the nodes of one task: a spanning forest of the pairs that are alike enough."""

    def __init__(self, s: Shingled, weight: np.ndarray, threshold: float):
        _, self.local = np.unique(s.ids, return_inverse=True)
        self.weight, self.starts, self.threshold = weight.astype(np.float64), s.starts, threshold
        self.total = np.array([self.weight[a:b].sum() for a, b in zip(s.starts, s.starts[1:], strict=False)])
        self.look = np.zeros(int(self.local.max()) + 1 if len(self.local) else 1)
        self.up = list(range(len(self.total)))
        self.seen: set[tuple[int, int]] = set()
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def alike(self, one: int, others: list[int]) -> np.ndarray:
        """Exact weighted Jaccard similarity of one node to others."""
        own = slice(self.starts[one], self.starts[one + 1])
        self.look[self.local[own]] = self.weight[own]
        sizes = self.starts[np.array(others) + 1] - self.starts[others]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[others] - (ends - sizes), sizes) + np.arange(ends[-1])
        both = np.add.reduceat(np.minimum(self.look[self.local[at]], self.weight[at]), ends - sizes)
        self.look[self.local[own]] = 0
        return both / (self.total[one] + self.total[others] - both)

    def compare(self, one: int, others: list[int]) -> None:
        """Compare with those that are neither linked to it nor compared before."""
        mine = self.root(one)
        todo = [o for o in others if self.root(o) != mine and (min(one, o), max(one, o)) not in self.seen]
        if not todo:
            return
        self.seen.update((min(one, o), max(one, o)) for o in todo)
        for o in np.array(todo)[self.alike(one, todo) >= self.threshold - 1e-9].tolist():
            if (a := self.root(one)) != (b := self.root(o)):
                self.up[a] = b
                self.found.append((one, o))

    def bucket(self, members: list[int]) -> None:
        """All pairs of a bucket, but those already linked: the largest linked part is left to the others."""
        parts = defaultdict(list)
        for m in members:
            parts[self.root(m)].append(m)
        largest = max(parts.values(), key=len)
        self.compare(largest[0], members)
        parts = defaultdict(list)
        for m in members:
            parts[self.root(m)].append(m)
        for part in sorted(parts.values(), key=len)[:-1]:
            for m in part:
                self.compare(m, members)

    def across(self, left: list[int], right: list[int]) -> None:
        for m in left:
            self.compare(m, right)


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    rare: float = RARE,
    task_nodes: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: (id, ``node`` of equal texts, ``class_id``, ``class_node``).

    ``class_id`` is the smallest id of the class; ``class_node`` is the node
    that holds it.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(idf_of(docs, text_col, rare))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sampler = WordHashes(), sampler_of(bands * band_rows)
        for batch in batches:
            for start, end, part in _blocks_of(batch, 1):
                s = shingled(part, hashes)
                found = iter(band_keys(sampler(s, weights(s, idf.value)), bands).tolist())
                rows = [next(found) if some else [] for some in np.diff(s.starts) > 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(s.nodes), pa.array(rows, pa.list_(pa.int64()))], names=["id", "node", "bands"])

    keyed = stored(texts.mapInArrow(keys, f"id {kind}, node long, bands array<long>"))
    nodes = keyed.groupBy("node").agg(F.min("id").alias("id"))

    # buckets with more than one node; equal texts meet in the partial aggregation
    listed = keyed.select("node", F.explode("bands").alias("bucket")).groupBy("bucket", "node").agg(F.lit(1).alias("one")).drop("one")
    shared = listed.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last")
    members = stored(listed.join(shared.drop("last"), "bucket"))
    loose = components(members.select(F.col("node").alias("a"), F.col("first").alias("b")))
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = loose.join(sizes, "root")

    # a small component is one task; of a larger one each bucket is, and a large bucket is a grid of block pairs
    whole = placed.where(F.col("size") <= task_nodes).select(F.col("root").alias("task"), F.lit(-1).alias("left"), F.lit(-1).alias("right"), "node", F.lit(-1).alias("side"))
    split = members.join(placed.where(F.col("size") > task_nodes).select("node"), "node").withColumn("n", F.ceil(F.col("size") / task_nodes).cast("int"))
    split = split.withColumn("side", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    split = split.select(F.col("bucket").alias("task"), F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "node", "side")
    wanted = whole.union(split).join(nodes, "node")
    by_node = with_node(texts.where("id is null"), "text", "found").select(F.col("found").alias("node"), "text")
    tasks = wanted.where("id is not null").join(texts, "id").select("task", "left", "right", "side", "node", "text")
    tasks = tasks.union(wanted.where("id is null").join(by_node, "node").select("task", "left", "right", "side", "node", "text"))

    def link(rows: pa.Table) -> pa.Table:
        part, side, expected = text_bytes(rows.column("text").combine_chunks()), rows.column("side").to_numpy(), rows.column("node").to_numpy()
        s = shingled(part, WordHashes())
        weight = weights(s, idf.value)
        links = Links(s, weight, threshold)
        # an id that stands at several texts brings texts of other nodes along; a node counts once for each side
        first = {(n, x): i for i, (n, x, e) in reversed(list(enumerate(zip(s.nodes.tolist(), side.tolist(), expected.tolist(), strict=True)))) if n == e}
        own = sorted(first.values())
        if side[0] < 0:
            found = defaultdict(list)
            some = np.flatnonzero(np.diff(s.starts) > 0)
            for i, row in zip(some.tolist(), band_keys(sampler_of(bands * band_rows)(s, weight), bands).tolist(), strict=True):
                if (int(s.nodes[i]), -1) in first and first[int(s.nodes[i]), -1] == i:
                    for key in row:
                        found[key].append(i)
            for same in sorted(found.values(), key=len, reverse=True):
                if len(same) > 1:
                    links.bucket(same)
        elif (left := rows.column("left")[0].as_py()) == (right := rows.column("right")[0].as_py()):
            links.bucket(own)
        else:
            links.across([i for i in own if side[i] == left], [i for i in own if side[i] == right])
        ends = np.array(links.found, np.int64).reshape(-1, 2)
        return pa.table({"a": s.nodes[ends[:, 0]], "b": s.nodes[ends[:, 1]]})

    linked = components(tasks.groupBy("task", "left", "right").applyInArrow(link, "a long, b long"))
    roots = nodes.join(linked, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    # the smallest id of each class, null only if all are, and the smallest node that holds it
    least = roots.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("m"))
    named = roots.join(least, "root").select("node", F.col("m.id").alias("class_id"), F.col("m.node").alias("class_node"))
    return keyed.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "node", "class_id", "class_node")


def with_node(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """The rows with the node of their text as a further column ``name``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [node_of(t) for t in text_bytes(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, all columns kept: a row of the smallest id (of rows that repeat, any one).

    Rows find their class by id; only where several rows have one id are their
    texts looked at, and rows without an id go by their texts.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where((F.col("node") == F.col("class_node")) & F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("_near_id"), F.col("node").alias("_near_node")).distinct()
    nodes = kept.where("_near_id is not null").groupBy("_near_id").agg(F.collect_set("_near_node").alias("_near_nodes"))
    rows = docs.join(nodes, docs[id_col] == nodes["_near_id"]).withColumn("_near_rows", F.count(F.lit(1)).over(Window.partitionBy("_near_id")))
    place, n = docs.columns.index(text_col), len(docs.columns)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()  # rows of one id follow each other
        for batch in batches:
            use = np.ones(batch.num_rows, bool)
            many = np.flatnonzero(batch.column(n + 2).to_numpy() > 1)
            for i in many.tolist():
                if (own := batch.column(n)[i].as_py()) != last:
                    last, seen = own, set()
                node = node_of((batch.column(place)[i].as_py() or "").encode())
                use[i] = node in batch.column(n + 1)[i].as_py() and node not in seen
                seen.add(node)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(use))

    named = rows.mapInArrow(once, docs.schema)
    unnamed = with_node(docs.where(F.col(id_col).isNull()), text_col, "_near_found")
    unnamed = unnamed.join(kept.where("_near_id is null"), F.col("_near_found") == F.col("_near_node")).dropDuplicates(["_near_node"])
    return named.union(unnamed.drop("_near_found", "_near_id", "_near_node"))
