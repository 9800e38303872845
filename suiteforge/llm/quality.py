"""Quality: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

1. Every document gets the votes of overlapping heuristics: good (+1), bad (-1)
   or abstain (0).  Spark counts the documents of each vote pattern; there are
   at most 3 ** labellers patterns, whatever the input.
2. Expectation-maximisation over the pattern counts estimates for each
   labeller how often it votes either way on good and on bad documents, and
   the share of good documents.  No gold label is read.
3. The posteriors of a bounded, hash-chosen sample (``max_rows``) train a
   logistic scorer over hashed word shapes; the scorer decides on every whole
   text.

Defined results: a null text counts as empty; a text without words gets no
votes, ``score`` the prior of the model, and is kept (nothing speaks against
it); repeated rows get equal scores; an empty table gives no rows; extra
columns are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_share, fit_in_task, in_share, keep_rows, map_batches, text_bytes, words

# Frequent function words of a few languages.
STOPWORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it for on was as with be by are this at from "
        "der die und das von den zu mit ist auf für des im dem ein eine als auch "
        "de la le et les des du en un une est que pour dans qui sur pas au par "
        "el los las del y se por con para su al lo como más o"
    ).split()
)
LABELLERS = "symbols capitals marks repetition few_words repeated_lines stopwords plain_words sentences".split()
#: The first so many labellers look for one defect each; they vote bad on at most this share of good documents.
DEFECTS, FALSE_ALARM = 6, 0.005
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*+/<=>@[]^_`{|}~\\"
_SHAPES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_CLASSES = np.frombuffer(b"aA9", np.uint8)
#: Shapes of ordinary words: lower case, capitalised or a number, with at most one mark after it.
PLAIN = frozenset(w + m for w in (b"a", b"Aa", b"A", b"9") for m in (b"", b".", b",", b";", b":", b"?", b"!"))
#: A labeller that judges shares needs so many words.
LEAST_WORDS = 20


@dataclass
class View:
    """What the labellers and the scorer see of one text."""

    tokens: list[bytes]
    shapes: Counter
    same: int
    distinct: int


def view(text: bytes) -> View:
    tokens = text.split()
    shaped = np.frombuffer(text.translate(_SHAPES), np.uint8)
    if len(shaped):  # a run of one letter or digit class becomes one character
        keep = np.ones(len(shaped), bool)
        keep[1:] = (shaped[1:] != shaped[:-1]) | ~np.isin(shaped[1:], _CLASSES)
        shaped = shaped[keep]
    return View(tokens, Counter(shaped.tobytes().split()), sum(map(eq, tokens, tokens[1:])), len(set(tokens)))


def votes(text: bytes, seen: View | None = None) -> tuple[int, ...]:
    """One vote of each of ``LABELLERS``: -1 bad, 0 abstains, 1 good; all abstain where the text has no word.

    The first six look for one defect each and never vote good; the last
    three look for running prose and vote either way.
    """
    seen = seen or view(text)
    n = len(seen.tokens)
    letters = len(text) - len(text.translate(None, _LETTERS))
    if not letters:
        return (0,) * len(LABELLERS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = (len(text) - len(text.translate(None, _UPPER))) / letters
    symbols = (len(text) - len(text.translate(None, _SYMBOLS))) / n
    marks = (text.count(b"!") + text.count(b"|")) / n
    stops = sum(map(STOPWORDS.__contains__, seen.tokens)) / n
    plain = sum(k for s, k in seen.shapes.items() if s in PLAIN) / n
    ends = sum(k for s, k in seen.shapes.items() if s[-1] in b".!?") / n
    enough = n >= LEAST_WORDS
    return (
        -1 if symbols >= 0.3 and enough else 0,
        -1 if upper >= 0.5 and enough else 0,
        -1 if marks >= 0.2 and enough else 0,
        -1 if seen.same >= 0.2 * n and enough else 0,
        -1 if seen.distinct <= n**0.7 and enough else 0,  # natural texts of n words have more distinct ones
        -1 if len(lines) > 4 and len(set(lines)) <= 0.5 * len(lines) else 0,
        (1 if stops >= 0.1 else -1 if stops <= 0.02 else 0) if enough else 0,
        (1 if plain >= 0.9 else -1 if plain <= 0.6 else 0) if enough else 0,
        (1 if 0.01 <= ends <= 0.5 else -1 if ends <= 0.002 else 0) if n >= 3 * LEAST_WORDS else 0,
    )


@dataclass
class LabelModel:
    """``rates[k, c, v]``: how often labeller k votes v (bad, abstain, good) on documents of class c (bad, good)."""

    prior: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.full((len(LABELLERS), 2, 3), 1 / 3))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good; the prior where every labeller abstains."""
        logs = np.log(self.rates)
        side = [math.log((1 - self.prior, self.prior)[c]) + sum(logs[k, c, patterns[:, k] + 1] for k in range(patterns.shape[1])) for c in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(side[0] - side[1], -700, 700)))
        return np.where((patterns == 0).all(1), self.prior, post)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over distinct vote patterns and their document counts, started from the majority vote."""
    model = LabelModel()
    use = (patterns != 0).any(1) if len(patterns) else np.zeros(0, bool)
    if not use.any():
        return model
    patterns, counts = patterns[use], counts[use].astype(float)
    good = 1 / (1 + np.exp(-2.0 * (patterns.sum(1) + 2 * patterns[:, :DEFECTS].sum(1))))
    # Dirichlet prior worth a fiftieth of the documents: a vote for a class is rarer on the other class
    believed = np.array([[0.3, 0.6, 0.1], [0.002, 0.5, 0.498]]) * counts.sum() / 50
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        model.prior = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        rates = np.stack([np.stack([(weight * (patterns[:, k] == v)).sum(1) for v in (-1, 0, 1)], 1) for k in range(patterns.shape[1])]) + believed + 1e-3
        rates /= rates.sum(2, keepdims=True)
        # the look-outs for defects are built to be precise: EM may not explain their votes as errors on good documents
        excess = np.maximum(rates[:DEFECTS, 1, 0] - FALSE_ALARM, 0)
        rates[:DEFECTS, 1, 0] -= excess
        rates[:DEFECTS, 1, 1] += excess
        model.rates = rates
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


SHAPE_BITS = 14
#: Added to the word count in a feature's share, so that a few words say little.
SHRINK = 12


def shape_features(seen: View, known: dict[bytes, int]) -> tuple[list[int], np.ndarray]:
    """Hashed word shapes and their shares; also the share of words that repeat the one before, and of repeated words."""
    cols = [known[s] if s in known else known.setdefault(s, 2 + zlib.crc32(s) % ((1 << SHAPE_BITS) - 2)) for s in seen.shapes]
    n = len(seen.tokens)
    counts = [*seen.shapes.values(), seen.same, max(0.0, n**0.7 - seen.distinct)]
    return [*cols, 0, 1], np.sqrt(np.array(counts, float) / (n + SHRINK))


@dataclass
class Scorer:
    labels: LabelModel = field(default_factory=LabelModel)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << SHAPE_BITS))
    bias: float = 0.0
    fitted: bool = False


def _packed(views: Iterable[View]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and shares of the features; a view is not needed after its own are taken."""
    known: dict[bytes, int] = {}
    cols, shares = [], []
    for v in views:
        if len(known) > 200_000:  # bounded memory; the hash of a shape stays the same
            known.clear()
        c, share = shape_features(v, known)
        cols.append(np.array(c, np.int32))
        shares.append(share)
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    return rows, np.concatenate([*cols, np.zeros(0, np.int32)]).astype(np.int64), np.concatenate([*shares, np.zeros(0)])


def fit_scorer(texts: list[bytes], target: np.ndarray, labels: LabelModel, rounds: int = 200, l2: float = 1e-5) -> Scorer:
    """Logistic regression on the posteriors as soft targets, by full-batch AdaGrad."""
    rows, cols, vals = _packed(view(t) for t in texts)  # one view at a time
    w, b, square, square_b = np.zeros(1 << SHAPE_BITS), 0.0, np.full(1 << SHAPE_BITS, 1e-6), 1e-6
    n = max(1, len(texts))
    for _ in range(rounds):
        margin = np.bincount(rows, w[cols] * vals, len(texts)) + b
        slope = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - target) / n
        g, gb = np.bincount(cols, slope[rows] * vals, len(w)) + l2 * w, slope.sum()
        square += g * g
        square_b += gb * gb
        w -= 0.3 * g / np.sqrt(square)
        b -= 0.3 * gb / math.sqrt(square_b)
    return Scorer(labels, w, float(b), True)


def score_views(model: Scorer, views: list[View]) -> np.ndarray:
    """Probability of good quality; at least one half where a text has no words or nothing was learnt."""
    out = np.full(len(views), max(0.5, model.labels.prior))
    if model.fitted and views:
        rows, cols, vals = _packed(views)
        margin = np.bincount(rows, model.weights[cols] * vals, len(views)) + model.bias
        some = np.array([bool(v.tokens) for v in views])
        out[some] = 1 / (1 + np.exp(-np.clip(margin[some], -60, 60)))
    return out


def score_texts(model: Scorer, texts: list[bytes]) -> np.ndarray:
    parts = [score_views(model, [view(t) for t in texts[a:b]]) for a, b in blocks(map(len, texts))]
    return np.concatenate(parts or [np.zeros(0)])


def with_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the vote pattern (one signed digit for each labeller) and the bytes of its text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(b.column(1))
        found = [list(votes(t)) for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int8())), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "votes", "n_bytes"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, votes array<tinyint>, n_bytes long")


def fit(docs: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 256 << 20) -> Scorer:
    """Label model from the votes on all documents; scorer from a sample of about ``max_rows`` of them, or fewer that have ``max_bytes`` of text."""
    patterns = with_votes(docs, id_col, text_col).groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size")).collect()  # at most 3 ** 9 rows
    patterns.sort(key=lambda r: tuple(r.votes))
    table = np.array([list(r.votes) for r in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    labels = fit_labels(table, np.array([r.n for r in patterns]))
    share = min(bounded_share(sum(r.n for r in patterns), max_rows), bounded_share(sum(r.size for r in patterns), max_bytes))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(in_share("_id", share))

    def learn(rows: pa.Table) -> Scorer:
        texts = sorted(t for t in text_bytes(rows.column("text")) if words(t))
        return fit_scorer(texts, labels.posterior(np.array([votes(t) for t in texts]).reshape(-1, len(LABELLERS))), labels) if texts else Scorer(labels)

    return fit_in_task(sample, learn) or Scorer(labels)


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the posterior of its votes (``weak``) and the scorer's probability (``score``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 14 weights

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, weak, strong = text_bytes(b.column(1)), [], []
        for start, end in blocks(map(len, texts)):
            views = [view(t) for t in texts[start:end]]
            weak.append(held.value.labels.posterior(np.array([votes(t, v) for t, v in zip(texts[start:end], views, strict=True)])))
            strong.append(score_views(held.value, views))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(weak)), pa.array(np.concatenate(strong))], names=[id_col, "weak", "score"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, weak double, score double")


def reject(docs: DataFrame, model: Scorer, at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents scored ``at`` or better, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: score_texts(held.value, texts) >= at)
