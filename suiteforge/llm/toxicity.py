"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a text are rates, so long and short texts compare: density of
lexicon words (a fixed public list of insults, and a list learnt from the
training rows by log-odds), second-person words and their closeness to lexicon
words, capitals, punctuation, and the rate of obfuscated spellings (digits and
signs inside words, and lexicon words that only appear after undoing them).

Training rows are a hash-chosen, bounded sample of the labelled rows of the
training folds (``max_rows``, a parameter); every text is scored whole.

Defined results: a null text counts as empty; an empty text has all-zero
features and the score the trees give those; rows with a null label or no
label are not learnt from; without any training row every score is 0.0;
repeated rows get equal scores; extra columns are ignored by ``score`` and
kept by ``reject``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, fit_in_task, in_share, keep_rows, map_batches, text_bytes

# A small public list of insults and threats.
LEXICON = (
    "asshole bastard bitch clown coward creep crap damn degenerate despicable dirtbag disgrace disgusting dumb "
    "dumbass failure filth filthy fool freak fuck garbage hate idiot idiotic ignorant imbecile jerk kill liar loser "
    "lowlife maggot moron moronic parasite pathetic pig rat repulsive retard savage scum shit shut sick slut stupid "
    "subhuman sucker swine terrible trash ugly vermin vile weasel whore worthless wretch"
).split()
SECOND_PERSON = "you your yours yourself you're u ur tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus".split()
OBFUSCATION = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")

#: Digits, letters, non-ASCII bytes and the signs that stand for letters make up a word here.
_TOKEN = re.compile(rb"[0-9a-z@$!|+*\x80-\xff]+")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: A word within so many words of a second-person word is close to it.
NEAR = 4
FEATURES = (
    "lexicon_density learnt_density learnt_weight lexicon_types second_person lexicon_near_second capitals punctuation "
    "exclamations obfuscated obfuscated_lexicon digits log_words"
).split()


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[at]


@dataclass
class Model:
    learnt: dict[bytes, float] = field(default_factory=dict)
    base: float = -math.inf
    trees: list[Tree] = field(default_factory=list)
    steps_x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    steps_y: np.ndarray = field(default_factory=lambda: np.zeros(1))


def features(texts: list[bytes], learnt: dict[bytes, float]) -> np.ndarray:
    """One row of dense features (``FEATURES``) for each text."""
    fixed, second = {w.encode() for w in LEXICON}, {w.encode() for w in SECOND_PERSON}
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        lower = text.lower()
        tokens = _TOKEN.findall(lower)
        n, size = max(1, len(tokens)), len(text)
        counts = Counter(tokens)
        hits = learnt_hits = weight = you = odd = odd_hits = 0.0
        found = set()
        for word, k in counts.items():
            plain = word.strip(b"!|+*$@")
            if plain in fixed:
                hits += k
                found.add(plain)
            if plain in learnt:
                learnt_hits += k
                weight += k * learnt[plain]
                found.add(plain)
            if plain in second:
                you += k
            if not plain.isalpha() and plain.isascii() and not plain.isdigit() and plain:
                odd += k
                undone = plain.translate(OBFUSCATION).replace(b"*", b"")
                if undone in fixed or undone in learnt:
                    odd_hits += k
                    found.add(undone)
        near = 0
        if found and you:
            at = np.array([i for i, w in enumerate(tokens) if w.strip(b"!|+*$@") in second])
            for i, w in enumerate(tokens):
                if w.strip(b"!|+*$@") in found:
                    j = np.searchsorted(at, i)
                    near += min(abs(int(at[x]) - i) for x in (max(0, j - 1), min(j, len(at) - 1))) <= NEAR
        letters = size - len(text.translate(None, _LETTERS))
        row[:] = (
            hits / n, learnt_hits / n, weight / n, len(found), you / n, near / n,
            (size - len(text.translate(None, _UPPER))) / max(1, letters),
            (size - len(text.translate(None, _PUNCTUATION))) / size,
            text.count(b"!") / size, odd / n, odd_hits / n,
            (size - len(text.translate(None, b"0123456789"))) / size, math.log1p(n),
        )
    return out


def learn_lexicon(texts: list[bytes], labels: np.ndarray, size: int = 200, least: int = 5) -> dict[bytes, float]:
    """Words whose presence speaks for label 1: by smoothed log-odds of the share of texts that hold them."""
    hot, cold = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        (hot if label else cold).update({w.strip(b"!|+*$@") for w in _TOKEN.findall(text.lower())})
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = {w: math.log(((k + 0.1) / (n1 + 0.2)) / ((cold[w] + 0.5) / (n0 + 1))) for w, k in hot.items() if w and k >= least}
    # a word must tell the classes apart beyond the chance of a rare word: two standard errors above one
    odds = {w: o for w, o in odds.items() if o - 2 * math.sqrt(1 / (hot[w] + 0.1) + 1 / (cold[w] + 0.5)) > 1}
    return dict(sorted(odds.items(), key=lambda x: (-x[1] * hot[x[0]], x[0]))[:size])


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, l2: float, rate: float) -> Tree:
    """One regression tree by the gradient and Hessian sums of each bin."""
    nodes = 2 ** (depth + 1) - 1
    tree = Tree(np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes))
    members = {0: np.arange(len(x))}
    for node in range(nodes):
        rows = members.pop(node, None)
        if rows is None:
            continue
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.value[node] = -rate * g / (h + l2)
        if node >= 2**depth - 1 or len(rows) < 40:
            continue
        best = (1e-6, -1, 0)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(cuts) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(cuts) + 1))[:-1]
            gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
            gain[(hs < 1) | (h - hs < 1)] = 0
            if (k := int(np.argmax(gain))) >= 0 and gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] >= 0:
            tree.feature[node], tree.threshold[node] = best[1], edges[best[1]][best[2]]
            left = binned[rows, best[1]] <= best[2]
            members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
    return tree


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps (lowest score of each step, its mean label), non-decreasing."""
    order = np.argsort(score, kind="stable")
    means: list[list[float]] = []
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        if means and means[-1][2] == s:
            means[-1][0] += y
            means[-1][1] += 1
        else:
            means.append([y, 1.0, s])
        while len(means) > 1 and means[-2][0] * means[-1][1] >= means[-1][0] * means[-2][1]:
            y1, n1, _ = means.pop()
            means[-1][0] += y1
            means[-1][1] += n1
    return np.array([m[2] for m in means]), np.array([m[0] / m[1] for m in means])


def fit_rows(texts: list[bytes], labels: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0) -> Model:
    """Of every five rows two give the lexicon, two the trees and one the isotonic steps; copies count once."""
    first = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())
    texts, labels = [texts[i] for i in first], np.asarray(labels, float)[first]
    if not len(labels):
        return Model()
    turn = np.arange(len(labels)) % 5
    words_from, build, held = (turn < 2, (turn == 2) | (turn == 3), turn == 4) if len(labels) >= 50 else (turn < 5,) * 3
    lexicon = learn_lexicon([t for t, b in zip(texts, words_from, strict=True) if b], labels[words_from])
    x = features(texts, lexicon)
    xb, yb = x[build], labels[build]
    edges = [np.unique(np.quantile(c[c > 0], np.linspace(0, 1, 33)[:-1])) if (c > 0).any() else np.zeros(0) for c in xb.T]
    edges = [np.concatenate(([0.0], e)) if len(e) else e for e in edges]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, xb.T, strict=True)], 1)
    p = min(max(yb.mean(), 1e-3), 1 - 1e-3)
    model = Model(lexicon, math.log(p / (1 - p)))
    margin = np.full(len(xb), model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        tree = _grow(xb, binned, edges, prob - yb, prob * (1 - prob), depth, l2, rate)
        model.trees.append(tree)
        margin += tree.predict(xb)
    model.steps_x, model.steps_y = isotonic(margins(model, x[held]), labels[held])
    return model


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    return model.base + sum((t.predict(x) for t in model.trees), np.zeros(len(x)))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Calibrated probability of label 1, 0 to 1; a tiny share of the raw margin keeps the order inside a step."""
    if not model.trees:
        return np.zeros(len(texts))
    raw = margins(model, features(texts, model.learnt))
    step = model.steps_y[np.clip(np.searchsorted(model.steps_x, raw, "right") - 1, 0, None)]
    return np.clip(0.999 * step + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = 24_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_bytes: int = 256 << 20
) -> Model:
    """Fit on a hash-chosen sample of about ``max_rows`` labelled rows for which ``train`` holds, or fewer that have ``max_bytes`` of text.

    The sample is bounded by these parameters and fitted in one task; only the
    model (lexicon, trees, steps) comes to the driver.
    """
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).where(F.col(id_col).isNotNull() & F.col("_y").isin(0, 1))
    marked = marked.where(train if train is not None else F.lit(True)).groupBy(F.col(id_col).alias("_id")).agg(F.max("_y").alias("_y"))
    n_marked, mean = marked.count(), docs.agg(F.avg(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)))).first()[0] or 0
    chosen = in_share("_id", min(bounded_share(n_marked, max_rows), bounded_share(n_marked * mean, max_bytes)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(chosen)

    def learn(table: pa.Table) -> Model:
        ids, ys, texts = table.column("_id").to_pylist(), table.column("_y").to_pylist(), text_bytes(table.column("_t"))
        order = sorted(range(len(ids)), key=lambda i: (hash_order(ids[i]), texts[i]))
        return fit_rows([texts[i] for i in order], np.array([ys[i] for i in order], float))

    return fit_in_task(rows.join(marked.where(chosen), "_id"), learn) or Model()


def hash_order(value) -> int:
    """A seeded order of ids (text ids by their digest) that does not depend on Python's hash seed."""
    if not isinstance(value, int):
        return int.from_bytes(hashlib.md5(str(value).encode()).digest()[:8], "little")
    return (value * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and calibrated score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB: bounded by rounds, depth and lexicon size

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = score_texts(held.value, text_bytes(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=[id_col, "score"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def reject(docs: DataFrame, model: Model, at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below ``at``, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: score_texts(held.value, texts) < at)
