"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

1. Every text gets a 64-bit fingerprint: a bit is one if it is set in over half
   of the XXH64 values (seed 42) of its three-word shingles, repeats included.
   Equal fingerprints are one node from here on.
2. The 64 bits are cut into ``blocks`` runs.  Fingerprints that differ in at
   most ``radius`` bits agree on all but ``radius`` runs, so each choice of
   ``blocks - radius`` runs deals the nodes into shards of equal bits, and any
   two linked nodes meet in a shard of some choice.
3. A shard's BK-tree holds its fingerprints; children are keyed by the integer
   Hamming distance to their parent.  A query at distance d of a node follows
   only the edges d - radius to d + radius (triangle inequality), so what it
   leaves out holds no link.
4. A shard of at most ``shard_nodes`` nodes stays in one task, tree and queries.
   A larger one is cut into trees of about that size; these are broadcast, a
   bounded number of bytes at a time, and its nodes query them wherever they
   lie, so a shard of a third of all nodes is searched by all tasks.
5. Each task unites what it links and returns a forest (fewer links than
   nodes), as a group of n copies has n * (n - 1) / 2 links.  Connected
   components of all forests are the classes.

``blocks`` follows from the number of nodes (a plan choice: every value gives
the same links), so that shards stay small as the table grows.

Defined results: null text counts as empty; texts of fewer than three words
have their whole sequence as one shingle; texts without words have fingerprint
zero, linked like any other; very long texts count whole; a component's id is
its smallest non-null document id, null if there is none; repeated rows appear
each; ties do not arise (a bit set in exactly half is zero); empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components as graph
from .common import blocks as byte_blocks
from .common import map_batches, stored, text_bytes

SEED = 42
SHINGLE = 3

#: Lane j of entry v is bit j of v: adding entries counts eight bits at once, up to 255 times.
_LANES = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        shingles, n = ([b" ".join(words)], 1) if words else ([], 0)
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of every text, as uint64."""
    out = np.zeros(len(texts), np.uint64)
    for start, end in byte_blocks(map(len, texts)):
        hashes = [shingle_hashes(t) for t in texts[start:end]]
        full = [k for k, h in enumerate(hashes) if len(h)]
        if not full:
            continue
        sizes = np.array([len(hashes[k]) for k in full])
        runs = -(-sizes // 255)
        first = np.cumsum(sizes) - sizes
        offset = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        lanes = _LANES[np.concatenate([hashes[k] for k in full]).view(np.uint8).reshape(-1, 8)]
        lanes = np.add.reduceat(lanes, np.repeat(first, runs) + 255 * offset, axis=0).view(np.uint8)
        counts = np.add.reduceat(lanes.astype(np.int64), np.cumsum(runs) - runs, axis=0)
        bits = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
        out[start + np.array(full)] = bits.view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, the fingerprint as a signed long of the same bits."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints_of(text_bytes(batch.column(1))).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fingerprint"])

    return map_batches(rows, run, rows.select("id", F.lit(0).cast("long").alias("fingerprint")).schema)


class Trees(NamedTuple):
    """BK-trees over ``values``: item k's children are those of ``child`` whose ``edge`` is 65 * k + distance (sorted)."""

    values: np.ndarray
    edge: np.ndarray
    child: np.ndarray


def plant(values: np.ndarray, root: np.ndarray) -> Trees:
    """Insert all items below their roots, in order: level by level, the first at a distance becomes the child, the rest go below it."""
    waiting = np.flatnonzero(root != np.arange(len(values)))
    at, edges, children = root[waiting], [], []
    while len(waiting):
        key = 65 * at + np.bitwise_count(values[waiting] ^ values[at])
        taken, first, which = np.unique(key, return_index=True, return_inverse=True)
        edges.append(taken)
        children.append(waiting[first])
        at = waiting[first][which]
        rest = at != waiting
        waiting, at = waiting[rest], at[rest]
    edge, child = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (edges, children))
    order = np.argsort(edge, kind="stable")
    return Trees(values, edge[order], child[order])


def search(trees: Trees, queries: np.ndarray, root: np.ndarray, radius: int, front: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, item) places within ``radius``, following only edges that can lead there; at most ``front`` steps are taken at once."""
    pending = [(np.arange(len(queries)), root)]
    while pending:
        query, item = pending.pop()
        if len(query) > front:
            half = len(query) // 2
            pending += [(query[:half], item[:half]), (query[half:], item[half:])]
            continue
        distance = np.bitwise_count(queries[query] ^ trees.values[item]).astype(np.int64)
        near = distance <= radius
        if near.any():
            yield query[near], item[near]
        low = np.searchsorted(trees.edge, 65 * item + np.maximum(distance - radius, 1))
        n = np.searchsorted(trees.edge, 65 * item + np.minimum(distance + radius, 64), "right") - low
        if total := int(n.sum()):
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            pending.append((np.repeat(query, n), trees.child[np.repeat(low, n) + step]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each item's is the smallest of its class) after joining a with b."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return label
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (label[label] != label).any():
            label = label[label]


def shard_links(values: np.ndarray, root: np.ndarray, radius: int) -> tuple[Trees, np.ndarray]:
    """The trees of all shards of a task, and the label of every item."""
    trees, label = plant(values, root), np.arange(len(values))
    several = np.flatnonzero(np.bincount(root, minlength=len(values))[root] > 1)
    for query, item in search(trees, values[several], root[several], radius):
        query = several[query]
        before = item < query
        label = unite(label, query[before], item[before])
    return trees, label


def _forest(values: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    joined = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(values[joined].view(np.int64)), pa.array(values[label[joined]].view(np.int64))], names=["a", "b"])


def _whole_shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted rows in pieces of about ``rows`` that end where a shard (all columns but the last) ends."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(b.num_rows for b in kept) >= rows:
            table = pa.Table.from_batches(kept)
            last = _roots(table)[-1]
            if last:
                yield table.slice(0, last)
                kept = table.slice(last).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _roots(table: pa.Table) -> np.ndarray:
    """For every row of a sorted table the first row of its shard."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for column in table.columns[:-1]:
        keys = column.to_numpy()
        new[1:] |= keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def choices(radius: int, blocks: int) -> list[int]:
    """Bit masks: every choice of ``blocks - radius`` of the runs that the 64 bits are cut into."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(runs, blocks - radius)]


def default_blocks(n_nodes: int, radius: int) -> int:
    """The fewest runs whose shards would hold at most 256 nodes if bits were even."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n_nodes >> (64 * (blocks - radius) // blocks) > 256:
        blocks += 1
    return blocks


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links(
    nodes: DataFrame, radius: int = 3, blocks: int | None = None, shard_nodes: int = 4096, broadcast_bytes: int = 32 << 20, piece: int = 65_536
) -> DataFrame:
    """(a, b) longs: a forest over the distinct ``fingerprint`` values of ``nodes`` with the components of all links within ``radius`` bits."""
    spark = nodes.sparkSession
    masks = choices(radius, blocks or default_blocks(nodes.count(), radius))
    shard = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fingerprint").bitwiseAND(_signed(m)).alias("bits")) for k, m in enumerate(masks)]))
    dealt = nodes.select(shard.alias("shard"), "fingerprint").select("shard.*", "fingerprint")
    sizes = dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > shard_nodes))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches, piece):
            values = table.column("fingerprint").to_numpy().view(np.uint64)
            yield _forest(values, shard_links(values, _roots(table), radius)[1])

    key = ["choice", "bits"]
    small = dealt.join(large, key, "left_anti").repartition(*key).sortWithinPartitions(*key, "fingerprint")
    out = small.mapInArrow(in_task, "a long, b long")
    if large.isEmpty():
        return out

    tree_count = F.ceil(F.col("n") / shard_nodes).cast("long")
    tree = F.pmod(F.xxhash64(F.lit(1), "fingerprint"), tree_count)
    members = stored(dealt.join(large, key).select(*key, tree.alias("tree"), "fingerprint"))

    def trees_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches, 2 * shard_nodes):
            values, root = table.column("fingerprint").to_numpy().view(np.uint64), _roots(table)
            for start in np.unique(root):
                own = values[root == start]
                made, label = shard_links(own, np.zeros(len(own), np.int64), radius)
                row = [[table.column(c)[int(start)].as_py()] for c in key] + [[cloudpickle.dumps((made, label))]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary())], names=[*key, "made"])

    grouped = members.repartition(*key, "tree").sortWithinPartitions(*key, "tree", "fingerprint")
    made = stored(grouped.mapInArrow(trees_of, "choice int, bits long, made binary"))
    out = out.union(made.select("made").mapInArrow(_own_links, "a long, b long"))
    passes = made.agg(F.ceil(F.sum(F.length("made")) / broadcast_bytes)).first()[0]
    for k in range(passes):
        # about ``broadcast_bytes``: trees have like sizes, and their hash deals them evenly
        part = made.where(F.pmod(F.xxhash64("made"), F.lit(passes)) == k).collect()
        shared = spark.sparkContext.broadcast([(r.choice, r.bits, *cloudpickle.loads(bytes(r.made))) for r in part])
        out = out.union(stored(members.select(*key, "fingerprint").mapInArrow(_prober(shared, radius), "a long, b long").distinct()))
    return out


def _own_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest inside every stored tree."""
    for batch in batches:
        for made in batch.column(0).to_pylist():
            trees, label = cloudpickle.loads(made)
            yield _forest(trees.values, label)


def _prober(shared, radius: int):
    """Nodes of large shards against the broadcast trees of the same shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            choice, bits, value = (c.to_numpy() for c in batch.columns)
            value = value.view(np.uint64)
            for of_choice, of_bits, trees, own in shared.value:
                if not len(at := np.flatnonzero((choice == of_choice) & (bits == of_bits))):
                    continue
                n = len(own)  # items of the tree first, under the labels that they have already
                label = np.concatenate([own, n + np.arange(len(at))])
                for query, item in search(trees, value[at], np.zeros(len(at), np.int64), radius):
                    label = unite(label, n + query, item)
                both, old = np.concatenate([trees.values, value[at]]), np.concatenate([own, n + np.arange(len(at))])
                joined = np.flatnonzero((old == np.arange(len(old))) & (both != both[label]))  # a tree's own links are returned once, elsewhere
                yield pa.RecordBatch.from_arrays([pa.array(both[joined].view(np.int64)), pa.array(both[label[joined]].view(np.int64))], names=["a", "b"])

    return run


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, **limits) -> DataFrame:
    """(id_col, fingerprint long, component_id) of every row; ``limits`` go to ``links``."""
    rows = stored(fingerprints(docs, id_col, text_col))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = stored(graph.components(links(nodes.select("fingerprint"), radius, **limits)))
    linked = nodes.join(roots, nodes.fingerprint == roots.node).select("fingerprint", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.select("fingerprint", "root").join(stored(least), "root").select("fingerprint", "least_id")
    whole = nodes.join(named, "fingerprint", "left").select("fingerprint", F.when(F.col("least_id").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"))
    return rows.join(stored(whole), "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")
