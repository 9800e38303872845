"""Exact token counts at every prefix, by dynamic programming over a public BPE vocabulary (sentencepiece model).

A byte-pair encoding of a prefix ends in exactly one piece whose cut-off rest
is itself encoded, with no merge across the cut.  So one pass over the
characters keeps, for each prefix, the last piece and the number of tokens:
the last piece is the one that ends there, encodes to itself, and stays apart
from the last piece of the prefix before it.  Whether two pieces stay apart is
a fact about the pair (the merges of their joined string), remembered once.

No piece has a space mark after another character, so the pass starts afresh
at every run of spaces; words recur, and the counts of a word's prefixes are
remembered too (both memories are bounded and live in the worker process).

Counts are those of the library's plain ``encode`` (no begin or end tokens,
special strings as ordinary text): a space is the mark U+2581, a text that is
not empty gets one mark in front, a character outside the vocabulary takes one
token per UTF-8 byte.

Defined results: null and empty texts have no token; repeated rows get equal
counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

MARK = "▁"
_CHUNK = re.compile(f"[\n\t]|{MARK}+[^{MARK}\n\t]*|[^{MARK}\n\t]+")
#: Remembered words and pairs per worker process.
WORDS_KEPT, STATES_KEPT, PAIRS_KEPT = 600_000, 800_000, 1_500_000
#: Chunks of more characters are not remembered.
LONG = 48


class Vocabulary:
    """The merges of a model file, as (piece -> priority); smaller merges first."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.longest = max(map(len, self.rank), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has a space mark after another character: words cannot be counted apart")
        if any(c in p for p in self.rank if len(p) > 1 for c in "\n\t"):
            raise ValueError("a piece joins a line end or tab to other characters")
        # by the last two characters: the lengths of the pieces that end so, longest first
        lengths: dict[str, set[int]] = {}
        for p in self.rank:
            lengths.setdefault(p[-2:], set()).add(len(p))
        for end, own in lengths.items():
            if end[-1] in self.rank:
                own.add(1)
        self.lengths = {end: sorted(own, reverse=True) for end, own in lengths.items()}
        self.alone: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.words: dict[str, int] = Remembered(self)

    def encode(self, text: str) -> list[str]:
        """Plain merging of a piece or two (so a few dozen characters): the best-ranked neighbours first, the leftmost of equals."""
        pieces, rank = list(text), self.rank.get
        while True:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                if (r := rank(pieces[i] + pieces[i + 1])) is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return pieces
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]

    def is_alone(self, piece: str) -> bool:
        """Whether the piece encodes to itself."""
        if (known := self.alone.get(piece)) is None:
            known = self.alone[piece] = self.encode(piece) == [piece]
        return known

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether no merge joins the two pieces."""
        if (known := self.apart.get((left, right))) is None:
            if len(self.apart) > PAIRS_KEPT:
                self.apart.clear()
            both = left + right
            known = self.apart[left, right] = not (both in self.rank and self.is_alone(both)) and self.encode(both) == [left, right]
        return known

    def step(self, prefix: str, states: dict[str, tuple[str, int]]) -> tuple[str, int]:
        """Last piece and tokens of a prefix, given those of all shorter ones."""
        rank, apart, end = self.rank, self.apart, len(prefix)
        lengths = self.lengths.get(prefix[-2:])
        for size in (1,) if lengths is None else lengths:
            if size > end or (piece := prefix[end - size :]) not in rank or not (self.alone.get(piece) or self.is_alone(piece)):
                continue
            left, tokens = states[prefix[: end - size]]
            if not left or (known := apart.get((left, piece))) or (known is None and self.stay_apart(left, piece)):
                return piece, tokens + 1
        # a character outside the vocabulary: its bytes, and nothing merges with it
        return "", states[prefix[:-1]][1] + len(prefix[-1].encode())

    def learn(self, chunk: str) -> int:
        """Tokens of a short chunk; the states of its prefixes are remembered for the words that begin alike."""
        if len(self.states) > STATES_KEPT:
            self.states = {"": ("", 0)}
        states, known = self.states, len(chunk)
        while (prefix := chunk[:known]) not in states:
            known -= 1
        for end in range(known + 1, len(chunk) + 1):
            prefix = chunk[:end]
            states[prefix] = self.step(prefix, states)
        return states[prefix][1]

    def walk(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk, shortest first."""
        if len(chunk) > LONG:
            return self.walk_long(chunk)
        self.learn(chunk)
        return [self.states[chunk[:end]][1] for end in range(1, len(chunk) + 1)]

    def walk_long(self, chunk: str) -> list[int]:
        """The same over a list of states, none of them remembered: in time proportional to the length."""
        states = [("", 0)]
        for end in range(1, len(chunk) + 1):
            for size in (1,) if (lengths := self.lengths.get(chunk[max(0, end - 2) : end])) is None else lengths:
                if size <= end and (piece := chunk[end - size : end]) in self.rank and self.is_alone(piece):
                    left, tokens = states[end - size]
                    if not left or self.stay_apart(left, piece):
                        states.append((piece, tokens + 1))
                        break
            else:
                states.append(("", states[-1][1] + len(chunk[end - 1].encode())))
        return [n for _, n in states[1:]]


class Remembered(dict):
    """Chunk to its tokens; forgets all when it holds too many."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > LONG:
            return self.vocabulary.walk_long(chunk)[-1]
        if len(self) > WORDS_KEPT:
            self.clear()
        self[chunk] = found = self.vocabulary.learn(chunk)
        return found


def vocabulary(model_file: str) -> Vocabulary:
    """One per worker process, whatever the number of tasks."""
    kept = vars(sys).setdefault("_prefix_token_vocabularies", {})
    if model_file not in kept:
        kept[model_file] = Vocabulary(model_file)
    return kept[model_file]


def chunks(text: str) -> list[str]:
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def count(text: str, vocab: Vocabulary) -> int:
    """Tokens of the whole text: the sum of its chunks' last prefixes."""
    return sum(map(vocab.words.__getitem__, chunks(text)))


def prefix_counts(text: str, vocab: Vocabulary) -> np.ndarray:
    """Tokens of every prefix by code points, from the empty one to the whole text.

    A prefix may have more tokens than a longer one, as merges wait for their right half.
    """
    out, base = [0], 0
    for i, chunk in enumerate(chunks(text)):
        own = vocab.walk(chunk)
        out += [base + n for n in (own[1:] if i == 0 else own)]  # the first mark stands before the text
        base += own[-1]
    return np.array(out, np.int64)


def longest_within(text: str, budget: int, vocab: Vocabulary) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    at, base, best = 0, 0, 0
    for i, chunk in enumerate(chunks(text)):
        if base + vocab.words[chunk] <= budget - 64:  # far from the budget: the whole chunk fits
            at, base = at + len(chunk) - (i == 0), base + vocab.words[chunk]
            best = at
            continue
        own = vocab.walk(chunk)
        counts = own[1:] if i == 0 else own
        if base > budget + 64:  # no later prefix can come back: a chunk's prefixes never undercut its start
            break
        for n in range(len(counts), 0, -1):
            if base + counts[n - 1] <= budget:
                best = at + n
                break
        at, base = at + len(counts), base + own[-1]
    return best


def token_counts(docs: DataFrame, model_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text", store_prefixes: bool = False) -> DataFrame:
    """One row per document: bytes, tokens, and the longest prefix (code points) within ``limit`` tokens.

    With ``store_prefixes`` also the token count at every prefix, from the
    empty one on: any later budget or cut is then a look-up.
    """
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "n_bytes", "n_tokens", "n_chars_within", *(["prefix_tokens"] if store_prefixes else [])]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        vocab, rows = vocabulary(model_file), text_bytes(b.column(1))
        texts = [t.decode() for t in rows]
        totals = [count(t, vocab) for t in texts]
        within = [len(t) if n <= limit else longest_within(t, limit, vocab) for t, n in zip(texts, totals, strict=True)]
        columns = [b.column(0), pa.array(list(map(len, rows)), pa.int64()), pa.array(totals, pa.int64()), pa.array(within, pa.int64())]
        if store_prefixes:
            columns.append(pa.array([prefix_counts(t, vocab) for t in texts], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, n_chars_within long" + (", prefix_tokens array<long>" if store_prefixes else "")
    return map_batches(narrow, run, schema)


def within_budget(counted: DataFrame, budget: int, prefix_col: str = "prefix_tokens") -> DataFrame:
    """Longest prefix (code points) within ``budget`` tokens, from stored counts: no text is read or encoded again."""
    fits = F.array_max(F.transform(prefix_col, lambda n, i: F.when(n <= budget, i)))
    return counted.withColumn("n_chars_within", fits.cast("long"))


