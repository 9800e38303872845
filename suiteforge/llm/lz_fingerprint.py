"""Lempel-Ziv phrase fingerprints: LZ78 phrases of a text, hashed, kept as a bottom-k minimum-hash signature.

The text is read word by word (white space apart; a word of more than ``LONG``
characters goes character by character, so that texts without spaces have
phrases too).  The parser extends the current phrase while the dictionary knows
it, adds the first unknown extension, and starts anew.  The set of phrases
depends on the text alone, and repeated material makes longer phrases, so the
likeness of two phrase sets (their Jaccard similarity, estimated from the k
smallest hashes of both) behaves like a compression distance.

``next_in_order`` walks documents in descending id order with one shuffle of
the texts: ranges of ids are found on the ids alone, each range's first
document also goes to the range before it, and a task streams its ranges.

Defined results: null text counts as empty; the empty phrase set has the empty
fingerprint, like itself (1.0) and unlike all others (0.0); documents of equal
id follow each other by text; null ids come last; a single document is its own
next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in a signature.
SIZE = 128
LONG = 24
_M, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class UnitHashes(dict):
    """Word to 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode()) | 1
        return out


def units(text: str) -> list[str]:
    own = text.split()
    if own and max(map(len, own)) > LONG:
        own = [u for w in own for u in ([w] if len(w) <= LONG else w)]
    return own


def parse(codes: list[int], seen: set[int], phrase: int = 0) -> tuple[list[int], int]:
    """Continues a parse over unit hashes: the phrases added to ``seen``, and the unfinished phrase at the end."""
    added = []
    for code in codes:
        phrase = (phrase * _M + code) & _MASK
        if phrase not in seen:
            seen.add(phrase)
            added.append(phrase)
            phrase = 0
    return added, phrase


def signature(phrases: set[int], size: int = SIZE) -> np.ndarray:
    """The smallest ``size`` distinct 32-bit hashes of the phrases, in order."""
    x = np.fromiter(phrases, np.uint64, len(phrases))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x = (x >> np.uint64(32)).astype(np.uint32)
    if len(x) > 4 * size:  # far fewer than half of the smallest can be equal; if not, look at all
        least = np.unique(np.partition(x, 2 * size)[: 2 * size])
        if len(least) > size:
            return least[:size]
    return np.unique(x)[:size]


def text_of(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two signatures; exact for sets that fit in."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    twice = np.flatnonzero(both[1:] == both[:-1])
    first = np.ones(len(both), bool)
    first[twice + 1] = False
    kept = np.flatnonzero(first)[:size]
    return float(np.isin(kept, twice).sum() / len(kept))


def fingerprint(text: str, hashes: UnitHashes | None = None) -> np.ndarray:
    """The signature of a text."""
    seen: set[int] = set()
    parse([*map((hashes if hashes is not None else UnitHashes()).__getitem__, units(text))], seen)
    return signature(seen)


def with_edit(text: str, edited: str, hashes: UnitHashes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of its edited form; the units they begin with are parsed once."""
    one, two = units(text), units(edited)
    same = 0
    for a, b in zip(one, two, strict=False):
        if a != b:
            break
        same += 1
    codes, seen = [*map(hashes.__getitem__, one)], set()
    _, phrase = parse(codes[:same], seen)
    added, _ = parse(codes[same:], seen, phrase)
    own = signature(seen)
    seen.difference_update(added)
    parse([*map(hashes.__getitem__, two[same:])], seen, phrase)
    return own, signature(seen)


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the following text's first."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = UnitHashes()
        for b in batches:
            found = [text_of(fingerprint(t or "", hashes)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, tail, id, text): in each part, in this order, every row but the tail is followed by its next document.

    Ids are integers.  Parts are ranges of descending ids; the tail of a part
    repeats the first document of the next one (of the first part, for the last).
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.select("id").where("id is not null").repartitionByRange(ranges, F.desc("id"))
    # one number per range reaches the driver
    heads = ids.select("id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.max("id").alias("head")).collect()
    first = np.array(sorted((r.head for r in heads), reverse=True), np.int64)
    last = max(0, len(first) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascending = first[::-1]
        for b in batches:
            null = np.asarray(b.column(0).is_null())
            own = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(null, last, len(first) - 1 - np.searchsorted(ascending, own, "left")) if len(first) else np.zeros(len(own), np.int64)
            head = np.flatnonzero(~null & (first[part] == own) if len(first) else null)
            at = np.concatenate((np.arange(len(own)), head))
            tail = np.arange(len(at)) >= len(own)
            part = np.concatenate((part, (part[head] - 1) % (last + 1)))
            again = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(tail), again.column(0), again.column(1)], names=["part", "tail", "id", "text"])

    dealt = rows.mapInArrow(deal, "part int, tail boolean, id long, text string")
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("id"), "text")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: its fingerprint, that of its text edited with the next document, and both likenesses."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, done = UnitHashes(), None, []  # held: the row before and, if known, its finished columns but near_next
        waiting = None

        def finish(own: np.ndarray) -> None:
            nonlocal waiting
            if waiting is not None:
                done.append((*waiting[0], likeness(waiting[1], own)))
                waiting = None

        for b in batches:
            for part, tail, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if held is not None and held[0] == part:
                    edited = edit(held[2], text)
                    own, other = with_edit(held[2], edited, hashes)
                    finish(own)
                    waiting = ((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(other), likeness(own, other)), own)
                    if tail:
                        finish(fingerprint(text, hashes))
                held = None if tail else (part, key, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done.clear()

    found = next_in_order(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)
