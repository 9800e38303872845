"""Language identification by segmentation-marginalised unigrams over a public vocabulary.

Each language has a probability for every piece of a fixed vocabulary (a
sentencepiece model file; nothing of it is trained).  The probability of a word
is the sum over all its segmentations into pieces of the product of their
probabilities, by a forward pass over the characters; a text's is the product
over its words.  The piece probabilities come from expectation-maximisation
(forward-backward expected counts) on a hash-chosen sample of at most about
``docs_per_language`` labelled training documents of each language; the
language shares count all training documents.

Words are runs of non-ASCII characters and ASCII letters of the lower-cased
text.  All words of a whole text count; distinct words are scored once per
block of texts.

Defined results: ``und`` with score 0 for a null text, one without a letter, or
when nothing was learnt; ties go to the first language in name order; rows with
null language are not learnt from; repeated rows get equal results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fit_in_task, in_share, text_bytes

MARK = "▁"
UNKNOWN = "und"
#: Longer words are learnt and scored in parts of so many characters.
LONG = 32
_LETTERS = bytes(range(97, 123))
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 0x20 for b in range(256))
WORDS_KEPT = 700_000


def lower_words(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_TABLE).split()


def word_parts(word: bytes) -> list[bytes]:
    """The word, or its parts of LONG characters if it has more."""
    text = word.decode(errors="replace") if len(word) > LONG else ""
    return [text[j : j + LONG].encode() for j in range(0, len(text), LONG)] if len(text) > LONG else [word]


def has_letter(text: bytes) -> bool:
    lower = text.lower()
    return len(lower.translate(None, _LETTERS)) < len(lower) or any(c.isalpha() for c in text.decode())


class Pieces:
    """Numbers of the plain pieces of a vocabulary, and by last two characters the lengths of the pieces that end so (longest first)."""

    def __init__(self, names: list[str]):
        self.number = {p: i for i, p in enumerate(names)}
        lengths: dict[str, set[int]] = {}
        for p in names:
            lengths.setdefault(p[-2:], set()).add(len(p))
        for end, own in lengths.items():
            if end[-1] in self.number:
                own.add(1)
        self.lengths = {end: sorted(own, reverse=True) for end, own in lengths.items()}


def load_pieces(model_file: str) -> Pieces:
    """The plain pieces of the model file, once per worker process."""
    kept = vars(sys).setdefault("_language_pieces", {})
    if model_file not in kept:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        kept[model_file] = Pieces([model.id_to_piece(i) for i in plain if len(model.id_to_piece(i)) <= LONG])
    return kept[model_file]


class Lattice:
    """Segmentations of many words at once: a state for every distinct prefix, an edge for every piece that ends there.

    Words that begin alike share states.  Edges (state, state before the
    piece, piece number) come in the order of prefix length.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.states = pieces, {"": 0}

    def add(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The states of the words; the edges into new states, an array (state, before, piece) for each prefix length."""
        number, lengths, unknown, states = self.pieces.number.get, self.pieces.lengths.get, len(self.pieces.number), self.states
        ends, edges = [], [[] for _ in range(LONG + 2)]
        for word in words:
            marked = MARK + word.decode(errors="replace")[:LONG]
            known = len(marked)
            while (prefix := marked[:known]) not in states:
                known -= 1
            for e in range(known + 1, len(marked) + 1):
                prefix = marked[:e]
                states[prefix] = own = len(states)
                into, single = edges[e], False
                for n in lengths(prefix[-2:], (1,)):
                    if n <= e and (k := number(prefix[e - n :])) is not None:
                        into += (own, states[prefix[: e - n]], k)
                        single = n == 1
                if not single:  # every single character can stand alone
                    into += (own, states[prefix[:-1]], unknown)
            ends.append(states[prefix])
        return np.array(ends, np.int64), [np.array(x, np.int64).reshape(-1, 3) for x in edges if x]


def forward(alpha: np.ndarray, edges: list[np.ndarray], p: np.ndarray) -> None:
    """Fills alpha[state, language]: the probability of the prefix over all its segmentations (p[piece, language])."""
    for own in edges:
        low, size = own[:, 0].min(), own[:, 0].max() + 1
        for k in range(alpha.shape[1]):
            alpha[low:size, k] += np.bincount(own[:, 0] - low, alpha[own[:, 1], k] * p[own[:, 2], k], size - low)


def expected(edges: list[np.ndarray], ends: np.ndarray, n_states: int, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over words (states ``ends``) with the given counts."""
    alpha = np.zeros((n_states, p.shape[1]))
    alpha[0] = 1
    forward(alpha, edges, p)
    beta, uses = np.zeros_like(alpha), np.zeros_like(p)
    beta[ends] = counts / np.maximum(alpha[ends], 1e-300)
    for own in reversed(edges):
        for k in range(p.shape[1]):
            onward = p[own[:, 2], k] * beta[own[:, 0], k]
            beta[:, k] += np.bincount(own[:, 1], onward, n_states)
            uses[:, k] += np.bincount(own[:, 2], alpha[own[:, 1], k] * onward, len(p))
    return uses


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    pieces: np.ndarray  # one row for each piece (the last: any other character), one column for each language


def fit_words(counts: np.ndarray, words: list[bytes], pieces: Pieces, rounds: int = 3, step: int = 50_000) -> np.ndarray:
    """EM from a flat start over the words (rows of ``counts``) of each language (columns); each part of a long word has the word's counts."""
    split = [word_parts(w) for w in words]
    counts, words = np.repeat(counts, [len(own) for own in split], axis=0), [part for own in split for part in own]
    p = np.full((len(pieces.number) + 1, counts.shape[1]), 1 / (len(pieces.number) + 1))
    parts = []
    for i in range(0, len(words), step):
        lattice = Lattice(pieces)
        parts.append((*lattice.add(words[i : i + step]), len(lattice.states), counts[i : i + step]))
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for ends, edges, size, own in parts:
            uses += expected(edges, ends, size, p, own)
        shared = uses.sum(1, keepdims=True) + 0.01
        shared /= shared.sum()
        # a little of the shared distribution: a piece unseen in one language stays possible there
        p = uses + 0.02 * uses.sum(0) * shared + shared
        p /= p.sum(0)
    return p


def fit(docs: DataFrame, model_file: str, train: Column | None = None, docs_per_language: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Piece probabilities of every language that labels a training document; None without any."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (train if train is not None else F.lit(True)))
    shares = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return None
    languages = sorted(shares)
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / shares[k]))]), F.col(lang_col))
    sample = rows.where(in_share(id_col, share)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))

    def learn(table: pa.Table) -> np.ndarray:
        places: dict[bytes, int] = {}
        pairs: list[np.ndarray] = []
        for text, lang in zip(text_bytes(table.column("text")), table.column("lang").to_pylist(), strict=True):
            own = np.array([places.setdefault(w, len(places)) for w in lower_words(text)], np.int64)
            pairs.append(own * len(languages) + languages.index(lang))
        flat = np.bincount(np.concatenate(pairs), minlength=len(places) * len(languages))
        order = sorted(places)
        return fit_words(flat.reshape(-1, len(languages))[[places[w] for w in order]].astype(float), order, load_pieces(model_file))

    found = fit_in_task(sample, learn)
    if found is None:
        return None
    total = sum(shares.values())
    return Model(languages, np.log([shares[k] / total for k in languages]), found)


class Scores:
    """Log-probabilities of words; forgets all when it remembers too many."""

    def __init__(self, model: Model, pieces: Pieces):
        self.model, self.pieces = model, pieces
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word by language; a word of more than LONG characters is scored in parts."""
        parts, owner = [], []
        for i, w in enumerate(words):
            own = word_parts(w)
            parts += own
            owner += [i] * len(own)
        lattice = Lattice(self.pieces)
        ends, edges = lattice.add(parts)
        alpha = np.zeros((len(lattice.states), len(self.model.languages)))
        alpha[0] = 1
        forward(alpha, edges, self.model.pieces)
        out = np.zeros((len(words), alpha.shape[1]))
        np.add.at(out, np.array(owner, np.int64), np.log(np.maximum(alpha[ends], 1e-300)))
        return out

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """One row per text: the log-probabilities of its words, added up by language."""
        if len(self.places) > WORDS_KEPT:
            self.clear()
        places, known = self.places, len(self.places)
        place = places.setdefault
        ids = [[place(w, len(places)) for w in own] for own in texts]
        if len(places) > known:
            self.logs = np.concatenate((self.logs, self.learn(list(islice(places, known, None)))))
        return np.stack([self.logs[own].sum(0) if own else np.zeros(self.logs.shape[1]) for own in ids])


def predict(docs: DataFrame, model: Model | None, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred`` and the posterior of that language."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x pieces numbers

    def run(batches):
        scores = Scores(held.value, load_pieces(model_file)) if held.value else None
        for b in batches:
            texts = text_bytes(b.column(1))
            langs, posts = [], []
            for start, end in blocks(map(len, texts)):
                part = texts[start:end]
                lettered = [has_letter(t) for t in part]
                if scores is None:
                    langs += [UNKNOWN] * len(part)
                    posts += [0.0] * len(part)
                    continue
                logs = scores.of([lower_words(t) for t in part]) + held.value.prior
                best = logs.argmax(1)
                post = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                langs += [held.value.languages[k] if some else UNKNOWN for k, some in zip(best.tolist(), lettered, strict=True)]
                posts += [float(x) if some else 0.0 for x, some in zip(post, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(posts, pa.float64())], names=[id_col, "lang_pred", "score"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
