"""Product codes of vectors by ball k-means: exact assignments that skip what the balls rule out.

Vectors become integers floor(``scale`` * x) and are cut into ``parts`` equal
consecutive parts, each with a codebook of ``entries`` integer entries.  Each
round assigns every part to its nearest entry (ties to the lower index) and
moves each entry to the floored mean of its parts.

For a part that was at entry i, with squared distance d to it now, an entry j
can only be as near if its squared distance to i is at most 4 d (triangle
inequality; integers throughout, so nothing is rounded).  In a batch

* entry i's ball has the radius of its farthest part, and its neighbours are
  the entries that this radius reaches, sorted by their distance to i;
* a ball that did not move, with no neighbour that moved, is left as it is;
* parts nearer than half the way to the first neighbour are the stable core,
  and stay;
* the others lie in rings: a part in ring m is compared exactly with the first
  m neighbours, no others.

Spark's part: the integers and the codes of the last round are one table,
written once a round (a lost executor redoes its tasks from the last one); sums
by (part, entry, position) are combined in each task and then shuffled.  The
codebooks, the starting vectors and the sums are all that the driver sees, and
their size does not depend on the number of vectors.

Defined results: rows whose vector is null, empty, or holds null, non-finite or
out-of-range components (2 ** 15 or more in size; the squared errors of larger
ones do not fit a long) are dropped, as are those of another length than the
vector of the smallest kept id; lengths that ``parts`` does not divide give
earlier parts one position more; ids that tie at the start are ordered by
vector, null ids come last; equal entries tie to the lower index; repeated rows
are coded each; fewer vectors than ``entries`` make a smaller codebook; tables
without kept rows give no rows; other columns are ignored unless named in
``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components of this size or more do not count: squared errors of smaller ones fit a long.
LIMIT = float(1 << 15)


class Codes(NamedTuple):
    """Final codebooks (one array of integer entries by part) and the table of integers and last codes."""

    codebooks: list[np.ndarray]
    moved: list[np.ndarray] | None
    table: DataFrame


def integers(column: pa.Array, scale: int = 1024) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of the usable vectors, and their components floor(scale * x)."""
    column = column.cast(pa.list_(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(invalid="ignore"):
        usable = np.isfinite(flat) & (np.abs(flat) < LIMIT)
    bad = np.concatenate([[0], np.cumsum(~usable)])
    end = np.cumsum(length)
    kept = np.flatnonzero((length > 0) & (bad[end] == bad[end - length]))
    whole = np.floor(np.where(usable, flat, 0) * scale).astype(np.int64)
    return kept, [whole[end[k] - length[k] : end[k]] for k in kept]


def _pack(vectors: np.ndarray) -> pa.Array:
    """One binary value a row, in the narrowest integers that hold the batch."""
    kind = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or len(vectors) == 0 or (vectors.min() >= np.iinfo(t).min and vectors.max() <= np.iinfo(t).max))
    return pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    width = np.array([len(r) // dim for r in rows])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(rows[k] for k in at), f"<i{w}").reshape(-1, dim)
    return out


def cuts(dim: int, parts: int) -> list[int]:
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(dim), parts)]).tolist()]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b."""
    if a.shape[1] * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)).item() ** 2 < 1 << 50:
        a, b = a.astype(np.float64), b.astype(np.float64)  # every product and sum is a whole number below 2 ** 53
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row against the whole codebook."""
    found = squared(x, book)
    code = found.argmin(1)
    return code, found[np.arange(len(x)), code]


def nearest_by_balls(x: np.ndarray, book: np.ndarray, between: np.ndarray, code: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, from the codes of the last round; ``between``: the entries' squared distances, ``moved``: which entries changed since."""
    own = ((x - book[code]) ** 2).sum(1)
    out, best = code.copy(), own.copy()
    order = np.lexsort((own, code))
    bounds = np.searchsorted(code[order], np.arange(len(book) + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        ball = order[bounds[i] : bounds[i + 1]]  # nearest part first
        radius = own[ball[-1]]
        near = np.flatnonzero(between[i] <= 4 * radius)
        near = near[near != i]
        if not len(near) or not (moved[i] or moved[near].any()):
            continue
        near = near[np.argsort(between[i, near], kind="stable")]
        ring = np.searchsorted(between[i, near], 4 * own[ball], "right")
        outside = np.searchsorted(ring, 1)  # the stable core lies before
        for start in range(outside, len(ball), 512):
            part = ball[start : start + 512]
            some = near[: ring[start : start + 512].max()]
            found = squared(x[part], book[some])
            found[np.arange(len(some))[None, :] >= ring[start : start + 512, None]] = np.iinfo(np.int64).max
            least = found.min(1)
            index = np.where(found == least[:, None], some[None, :], len(book)).min(1)
            nearer = (least < best[part]) | ((least == best[part]) & (index < out[part]))
            out[part[nearer]], best[part[nearer]] = index[nearer], least[nearer]
    return out, best


def _assign(vectors: np.ndarray, books: list[np.ndarray], bounds: list[int], between, codes: np.ndarray | None, moved) -> tuple[np.ndarray, np.ndarray]:
    out, error = np.empty((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
    for p, book in enumerate(books):
        x = vectors[:, bounds[p] : bounds[p + 1]]
        out[:, p], found = nearest(x, book) if codes is None else nearest_by_balls(x, book, between[p], codes[:, p], moved[p])
        error += found
    return out, error


def _codes_of(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)


def _code_column(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes.astype(np.uint16)], pa.binary())


def _start(rows: DataFrame, entries: int, scale: int) -> np.ndarray | None:
    """The integer vectors of the smallest kept ids, of one length (a bounded number of rows)."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = integers(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(found, pa.list_(pa.int64()))], names=["id", "vector"])

    whole = rows.mapInArrow(usable, rows.select("id", F.lit(None).cast("array<long>").alias("vector")).schema)
    by = [F.col("id").asc_nulls_last(), "vector"]
    first = whole.orderBy(*by).limit(1).collect()
    if not first:
        return None
    same = whole.where(F.size("vector") == len(first[0].vector))
    smallest = stored(same.orderBy(*by).limit(entries)).orderBy(*by)
    return np.array([r.vector for r in smallest.collect()], np.int64)


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: Sequence[str] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> Codes:
    """Learn the codebooks; ``keep`` columns stay beside the codes for ``encode``."""
    if entries > 1 << 16:
        raise ValueError("codes have 16 bits a part")
    if rounds < 1:
        raise ValueError("at least one round")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"), F.struct(F.col(id_col), *[F.col(c) for c in keep]).alias("kept"))
    start = _start(rows.select("id", "vector"), entries, scale)
    if start is None:
        empty = rows.where(F.lit(False)).select("kept", F.lit(b"").alias("packed"), F.lit(b"").alias("codes"))
        return Codes([np.zeros((0, 0), np.int64)] * parts, None, empty)
    dim = start.shape[1]
    bounds = cuts(dim, parts)
    books = [start[:, a:b].copy() for a, b in zip(bounds, bounds[1:], strict=False)]
    moved: list[np.ndarray] | None = None
    kept_type = rows.select("kept").schema["kept"].dataType.simpleString()
    schema = f"kept {kept_type}, packed binary, codes binary"
    table = None
    for _ in range(rounds):
        if table is None:

            def first_codes(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    at, found = integers(batch.column(0), scale)
                    own = [k for k, v in enumerate(found) if len(v) == dim]
                    if own:
                        x = np.array([found[k] for k in own])
                        codes, _ = _assign(x, books, bounds, None, None, None)
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at[own])), _pack(x), _code_column(codes)], names=["kept", "packed", "codes"])

            table = stored(rows.select("vector", "kept").mapInArrow(first_codes, schema))
        else:
            table = stored(table.mapInArrow(_next_codes(books, moved, bounds, parts), schema))
        old, books = books, _means(table, books, bounds)
        moved = [(a != b).any(1) for a, b in zip(old, books, strict=True)]
    return Codes(books, moved, table)


def _next_codes(books, moved, bounds, parts):
    between = [squared(b, b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch.column(1), bounds[-1])
            codes, _ = _assign(x, books, bounds, between, _codes_of(batch.column(2), parts), moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _code_column(codes)], names=["kept", "packed", "codes"])

    return run


def _means(table: DataFrame, books: list[np.ndarray], bounds: list[int]) -> list[np.ndarray]:
    """The floored mean of the parts at every entry; entries without parts stay."""
    parts, dim = len(books), bounds[-1]
    size = len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((size, dim), np.int64), np.zeros((size, parts), np.int64)
        for batch in batches:
            x, codes = _unpack(batch.column(0), dim), _codes_of(batch.column(1), parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                if len(used):
                    total[used, bounds[p] : bounds[p + 1]] += np.add.reduceat(x[order, bounds[p] : bounds[p + 1]], first, axis=0)
                count[:, p] += np.bincount(codes[:, p], minlength=size)
        # a column of sums for every position, then one of counts for every part
        entry, place = np.nonzero(np.repeat(count > 0, [b - a for a, b in zip(bounds, bounds[1:], strict=False)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(total[entry, place])], names=["entry", "place", "total"])
        entry, place = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(dim + place), pa.array(count[entry, place])], names=["entry", "place", "total"])

    found = table.select("packed", "codes").mapInArrow(sums, "entry long, place long, total long").groupBy("entry", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((size, dim + parts), np.int64)
    for r in found:
        total[r.entry, r.place] = r.total
    out = []
    for p, book in enumerate(books):
        n = total[:, dim + p]
        out.append(np.where(n[:, None] > 0, total[:, bounds[p] : bounds[p + 1]] // np.maximum(n, 1)[:, None], book))
    return out


def encode(codes: Codes) -> DataFrame:
    """The kept columns of every vector, ``code`` (hex digits of its entries) and ``error`` under the final codebooks."""
    books, moved, table = codes
    if moved is None:
        return table.select("kept.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    parts, between = len(books), [squared(b, b) for b in books]
    bounds = [0, *np.cumsum([b.shape[1] for b in books]).tolist()]
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, error = _assign(_unpack(batch.column(1), bounds[-1]), books, bounds, between, _codes_of(batch.column(2), parts), moved)
            code = ["".join(f"{c:0{digits}x}" for c in row) for row in found.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error)], names=["kept", "code", "error"])

    kept_type = table.schema["kept"].dataType.simpleString()
    return table.mapInArrow(run, f"kept {kept_type}, code string, error long").select("kept.*", "code", "error")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, comma-joined in decimal."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame, books: list[np.ndarray], label_col: str = "label") -> DataFrame:
    """Adds ``label_error`` (errors summed over equal labels, nulls together) and ``codebooks_sha256``; drops the label."""
    coded = stored(coded)
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(stored(sums), coded[label_col].eqNullSafe(F.col("_label")))
    return joined.drop(label_col, "_label").withColumn("codebooks_sha256", F.lit(digest(books)))


def sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The query's rows in DuckDB: every part against every entry in every round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding AS e, len(embedding) // {parts} AS w
  FROM embeddings WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[]))),
v AS MATERIALIZED (SELECT r, w, unnest(range(len(e))) AS pos, floor({scale} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept),
c0 AS MATERIALIZED (SELECT pos, r AS entry, x FROM v WHERE r < {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT r, pos // w AS part, entry, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c USING (pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT r, part, min(d * {entries} + entry) AS best FROM d{k} GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT pos, best % {entries} AS entry, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{k} a ON a.r = v.r AND a.part = pos // w GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.pos, c.entry, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} c LEFT JOIN m{k} USING (pos, entry))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error
  FROM kept JOIN a{rounds} USING (r) GROUP BY r, vec_id, label),
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos // w, entry, pos)) AS h FROM c{rounds}, (SELECT min(w) AS w FROM kept))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, book"""
