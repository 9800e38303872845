"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

Tokens are the white-space words of the ASCII-lower-cased text and one end.
The model predicts units: the most frequent words, the end, and buckets of all
other words by their last two characters; a bucket's words share its
probability by their counts.  Units sorted by mass form classes, and the
softmax is P(class | state) * P(unit | class, state).

* Counts: every training document; Spark adds them up by token.
* Fit: gated recurrent unit in numpy, truncated backpropagation over windows of
  ``WINDOW`` tokens with the state carried from window to window.  Each round,
  at every size, takes all training documents: shards of them start from the
  common parameters and train apart; the parameters are then averaged.  The
  output biases start at the counts, so the fit starts from the unigram model.
* Score: every whole document, its state carried from its first word to its
  end.  Documents run side by side, sorted by length.  Counts of words outside
  the ``HEAD`` most frequent come by a join on the word, whatever the
  vocabulary's size.

Defined results: null text counts as empty (its only token is the end); with no
training documents all counts are zero and every unit is equally likely;
very long texts are scored whole, their state carried to the end; words with
equal counts are ranked by their bytes; repeated rows are scored each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored, text_bytes

#: Words with their own unit; buckets for the others; words whose counts every task holds (of at most LONGEST bytes).
OWN, BUCKETS, HEAD, LONGEST = 2047, 256, 131_072, 64
HIDDEN, EMBED, CLASS_SIZE, WINDOW, LANES = 32, 24, 48, 16, 500
SMOOTH = 0.1
#: Stands for the end in count tables: no word is empty.
END = ""


def tokens(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the ASCII-lower-cased text (without the end)."""
    return text.lower().split()


def counts_of(docs: DataFrame, text_col: str, flush: int = 250_000) -> DataFrame:
    """(token, c) over all documents, with one end each; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])

        for b in batches:
            for text in text_bytes(b.column(0)):
                found.update(tokens(text))
                found[b""] += 1
                if len(found) > flush:
                    yield out()
                    found.clear()
        if found:
            yield out()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def bucket_key(word: str) -> str:
    return word[-2:]


@dataclass
class Units:
    """Units by mass: of the words with a unit of their own, of the buckets, of the end; masses of buckets for sharing."""

    own: dict[bytes, int]
    bucket: np.ndarray
    end: int
    share: np.ndarray
    mass: np.ndarray

    @property
    def classes(self) -> int:
        return -(-len(self.mass) // CLASS_SIZE)

    @classmethod
    def of(cls, own: list[tuple[str, int]], ends: int, bucket_mass: np.ndarray) -> Units:
        """``bucket_mass``: smoothed counts of the words of each bucket, and of one unknown word."""
        mass = np.concatenate(([ends + SMOOTH], [c + SMOOTH for _, c in own], bucket_mass))
        rank = np.empty(len(mass), np.int64)
        rank[np.lexsort((np.arange(len(mass)), -mass))] = np.arange(len(mass))
        return cls({w.encode(): int(r) for (w, _), r in zip(own, rank[1:], strict=False)}, rank[1 + len(own) :], int(rank[0]), np.log10(bucket_mass), np.sort(mass)[::-1])


def bucket_numbers(words: Iterable[bytes], tails: dict[bytes, int]) -> np.ndarray:
    """The bucket of each word; ``tails`` remembers those of two ASCII characters, which are whole tails."""

    def number(word: bytes) -> int:
        if (found := tails.get(word[-2:])) is None:
            found = zlib.crc32(bucket_key(word.decode()).encode()) % BUCKETS
            if word[-2:].isascii():
                tails[word[-2:]] = found
        return found

    return np.fromiter(map(number, words), np.int32)


@dataclass
class Head:
    """Words whose counts every task holds: their places, and by place the unit, the log count and what a word adds to its unit's score (nothing if the unit is its own)."""

    place: dict[bytes, int]
    unit: np.ndarray
    log: np.ndarray
    adds: np.ndarray

    @classmethod
    def of(cls, words: list[tuple[str, int]], units: Units) -> Head:
        keys, log = [w.encode() for w, _ in words], np.array([math.log10(c + SMOOTH) for _, c in words])
        bucket = bucket_numbers(keys, {})
        own = np.array([units.own.get(w, -1) for w in keys], np.int64)
        return cls({w: i for i, w in enumerate(keys)}, np.where(own >= 0, own, units.bucket[bucket]), log, np.where(own >= 0, 0.0, log - units.share[bucket]))


class Gru:
    """The model's parameters as views of one vector."""

    def __init__(self, units: int, vector: np.ndarray | None = None):
        self.n_classes = -(-units // CLASS_SIZE)
        h, c = HIDDEN, self.n_classes
        shapes = {"embed": (c * CLASS_SIZE, EMBED), "wx": (EMBED, 3 * h), "b": (3 * h,), "wh": (h, 3 * h), "bh": (h,), "wc": (h, c), "bc": (c,), "wo": (c, h, CLASS_SIZE), "bo": (c, CLASS_SIZE)}
        size = sum(math.prod(s) for s in shapes.values())
        self.scratch: dict[str, np.ndarray] = {}
        self.vector = np.zeros(size, np.float32) if vector is None else vector
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.vector[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def start(cls, units: Units, seed: int = 3) -> Gru:
        model, draw = cls(len(units.mass)), np.random.default_rng(seed)
        for name, scale in (("embed", 0.3), ("wx", 0.3), ("wh", 0.2), ("wc", 0.02), ("wo", 0.02)):
            view = getattr(model, name)
            view[...] = draw.normal(0, scale, view.shape)
        model.b[:HIDDEN] = 1  # gates that keep the state at first
        mass = np.full(model.n_classes * CLASS_SIZE, 1e-6)
        mass[: len(units.mass)] = units.mass
        mass = mass.reshape(model.n_classes, CLASS_SIZE) / mass.sum()
        model.bc[:] = np.log(mass.sum(1))
        model.bo[:] = np.log(mass / mass.sum(1, keepdims=True))
        return model

    def inputs(self) -> np.ndarray:
        """What each unit adds to the gates."""
        return self.embed @ self.wx + self.b

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """With biases: from state and a one to keep and reset gates and the reset's inner sum; from a one and embedding to new, keep and reset gates."""
        h = HIDDEN
        return np.concatenate((self.wh, np.pad(self.bh, (2 * h, 0))[None])), np.roll(np.concatenate((self.b[None], self.wx)), h, axis=1)

    def room(self, name: str, *shape: int) -> np.ndarray:
        """Scratch memory under a name: fresh pages for every window cost as much as the sums in them."""
        size = math.prod(shape)
        if name not in self.scratch or len(self.scratch[name]) < size:
            self.scratch[name] = np.empty(size, self.vector.dtype)
        return self.scratch[name][:size].reshape(shape)

    @staticmethod
    def advance(gates: np.ndarray, x: np.ndarray, state: np.ndarray, out: np.ndarray) -> None:
        """One step of all lanes, a column each, from the sums that ``joined`` gives for states (``gates`` after the first part) and units (``x``).

        ``gates`` becomes new, keep and reset gates and the reset's inner sum; the next state goes to ``out``.
        """
        h = HIDDEN
        n, zr, inner = gates[:h], gates[h : 3 * h], gates[3 * h :]
        zr += x[h:]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[h:], inner, out=n)
        n += x[:h]
        np.tanh(n, out=n)
        np.subtract(state, n, out=out)
        out *= zr[:h]
        out += n

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of all lanes, a row each, from what ``inputs`` has for their units: next state and gates."""
        h = HIDDEN
        gates = np.empty((4 * h, len(state)), state.dtype)
        gates[h:] = (state @ self.wh).T
        gates[3 * h :] += self.bh[:, None]
        out = np.empty(state.shape[::-1], state.dtype)
        self.advance(gates, np.roll(x.T, h, axis=0), state.T, out)
        return out.T, gates.T

    def log_likelihood(self, states: np.ndarray, target: np.ndarray, grads: Gru | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """``outputs`` with a row of ``states`` for each target."""
        logs, back = self.outputs(np.ascontiguousarray(states.T), np.arange(len(target)), target, grads)
        return logs, None if back is None else back.T

    def outputs(self, states: np.ndarray, at: np.ndarray, target: np.ndarray, grads: Gru | None = None, columns: int = 1024) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target unit given the state in column ``at``.

        With ``grads``, adds output gradients there and gives those of the states (zero in columns that no target has).
        Targets are sorted by class once, so that a class is a slice of columns; ``columns`` of them at a time stay in
        the processor's cache.  A row of ones below the states makes the biases part of the matrices.
        """
        h, c, n, kind = HIDDEN, self.n_classes, len(at), states.dtype
        cls, place = np.divmod(target.astype(np.int32), np.int32(CLASS_SIZE))
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cls, place, at = cls[order], place[order] + c, at[order]
        cuts = np.searchsorted(cls, np.arange(c + 1)).tolist()
        # of every class: what gives the logits of all classes and of the units of this one
        whole = np.empty((c, h + 1, c + CLASS_SIZE), kind)
        whole[:, :h, :c], whole[:, h, :c], whole[:, :h, c:], whole[:, h, c:] = self.wc, self.bc, self.wo, self.bo
        sums = down = None
        if grads is not None:
            sums, down = np.zeros_like(whole), self.room("down", h, n + 1)
            down[:, n] = 0
        logs = np.zeros(n, kind)
        for a in range(0, n, columns):
            b = min(a + columns, n)
            rows = np.arange(b - a)
            own, logits = self.room("own", h + 1, b - a), self.room("logits", c + CLASS_SIZE, b - a)
            states.take(at[a:b], axis=1, mode="clip", out=own[:h])
            own[h] = 1
            some = [(k, slice(max(cuts[k], a) - a, min(cuts[k + 1], b) - a)) for k in range(int(cls[a]), int(cls[b - 1]) + 1) if cuts[k + 1] > cuts[k]]
            for k, these in some:
                np.matmul(whole[k].T, own[:, these], out=logits[:, these])
            halves = (logits[:c], cls[a:b]), (logits[c:], place[a:b] - c)
            for half, chosen in halves:
                half -= half.max(0)
                logs[a:b] += half[chosen, rows]
            np.exp(logits, out=logits)
            for half, chosen in halves:
                total = half.sum(0)
                logs[a:b] -= np.log(total)
                if grads is not None:
                    half *= -1 / total
                    half[chosen, rows] += 1
            if grads is not None:
                for k, these in some:
                    sums[k] += own[:, these] @ logits[:, these].T
                    np.matmul(whole[k, :h], logits[:, these], out=down[:, a + these.start : a + these.stop])
        if grads is not None:
            grads.wc += sums[:, :h, :c].sum(0)
            grads.bc += sums[:, h, :c].sum(0)
            grads.wo += sums[:, :h, c:]
            grads.bo += sums[:, h, c:]
            place = np.full(states.shape[1], n)
            place[at] = np.arange(n)
            down = down.take(place, axis=1, mode="clip")
        out = np.empty_like(logs)
        out[order] = logs
        return out, down

    def window(self, units: np.ndarray, target: np.ndarray, keep: np.ndarray, state: np.ndarray, grads: Gru) -> tuple[float, np.ndarray]:
        """One training window (steps x lanes; target -1: no token): log-likelihood, next state; gradients go to ``grads``.

        Inside, lanes are columns, and each step has one block of memory: what the gates are given (the state before,
        a one, the unit's embedding), and the gates.
        """
        (steps, lanes), h, kind = units.shape, HIDDEN, self.vector.dtype
        (by_state, by_unit), embed = self.joined(), np.ascontiguousarray(self.embed.T)
        given, gates = self.room("given", steps, h + EMBED + 1, lanes), self.room("gates", steps, 4 * h, lanes)
        states, x = self.room("states", h, steps * lanes), self.room("x", 3 * h, lanes)
        parts = [slice(t * lanes, (t + 1) * lanes) for t in range(steps)]
        given[:, h] = 1
        last = state.T
        for t, own in enumerate(parts):
            np.multiply(last, keep[t], out=given[t, :h])
            embed.take(units[t], axis=1, mode="clip", out=given[t, h + 1 :])
            np.matmul(by_state.T, given[t, : h + 1], out=gates[t, h:])
            np.matmul(by_unit.T, given[t, h:], out=x)
            self.advance(gates[t], x, given[t, :h], states[:, own])
            last = states[:, own]
        last, wanted = np.array(last.T), target.ravel()
        some = np.flatnonzero(wanted >= 0)
        logs, back = self.outputs(states, some, wanted[some], grads)
        d, embedding = self.room("d", 4 * h, lanes), self.room("embedding", EMBED, steps * lanes)
        met_state, met_unit, carry = np.zeros_like(by_state), np.zeros_like(by_unit), np.zeros((h, lanes), kind)
        dn, dz, dr, du = (d[i * h : (i + 1) * h] for i in range(4))
        for t in range(steps - 1, -1, -1):
            n, z, r, inner = (gates[t, i * h : (i + 1) * h] for i in range(4))
            carry += back[:, parts[t]]
            np.subtract(1, z, out=du)
            du *= carry
            np.subtract(given[t, :h], n, out=dz)
            dz *= z
            dz *= du
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= du
            np.multiply(dn, r, out=du)
            np.subtract(1, r, out=dr)
            dr *= inner
            dr *= du
            met_state += given[t, : h + 1] @ d[h:].T
            met_unit += given[t, h:] @ d[: 3 * h].T
            np.matmul(by_unit[1:], d[: 3 * h], out=embedding[:, parts[t]])
            carry *= z
            carry += by_state[:h] @ d[h:]
            carry *= keep[t]
        met_unit = np.roll(met_unit, -h, axis=1)
        grads.wh += met_state[:h]
        grads.bh += met_state[h, 2 * h :]
        grads.wx += met_unit[1:]
        grads.b += met_unit[0]
        at = units.ravel()
        for feature, row in zip(grads.embed.T, embedding, strict=True):
            feature += np.bincount(at, row, len(self.embed))
        return float(logs.sum()), last


class Adam:
    """Running means of the gradient and of its square; works on slices that stay in the processor's cache."""

    def __init__(self, like: np.ndarray, piece: int = 16_384):
        self.first, self.second, self.turn = np.zeros_like(like), np.zeros_like(like), 0
        self.pieces, self.spare = [slice(i, i + piece) for i in range(0, len(like), piece)], np.empty(min(piece, len(like)), like.dtype)

    def move(self, vector: np.ndarray, g: np.ndarray, scale: float, rate: float) -> None:
        """Adds the step for the gradient ``scale * g`` to ``vector``; ``g`` is used up."""
        self.turn += 1
        for piece in self.pieces:
            own, first, second = g[piece], self.first[piece], self.second[piece]
            spare = self.spare[: len(own)]
            own *= scale
            np.subtract(own, first, out=spare)
            spare *= 0.1
            first += spare
            own *= own
            own -= second
            own *= 0.01
            second += own
            np.multiply(second, 1 / (1 - 0.99**self.turn), out=spare)
            np.sqrt(spare, out=spare)
            spare += 1e-6
            np.divide(first, spare, out=spare)
            spare *= rate / (1 - 0.9**self.turn)
            vector[piece] += spare


def train(model: Gru, docs: list[np.ndarray], end: int, rate: float, lanes: int = LANES) -> float:
    """One pass of Adam over documents (unit numbers without the end); natural log-likelihood per token.

    The documents follow each other in one stream, cut into equal lanes, so that all windows are full however long a
    document is.  The state starts anew with each document and lane.
    """
    units = np.concatenate([x for doc in docs for x in ([end], doc)] or [[]]).astype(np.int32)
    target = np.concatenate([x for doc in docs for x in (doc, [end])] or [[]]).astype(np.int32)
    keep = np.ones(len(units), model.vector.dtype)
    keep[np.cumsum([0, *(len(doc) + 1 for doc in docs)])[:-1]] = 0
    lanes = max(1, min(lanes, len(units) // WINDOW))
    steps = -(-len(units) // lanes)
    units, target, keep = (np.ascontiguousarray(np.pad(x, (0, lanes * steps - len(x)), constant_values=fill).reshape(lanes, steps).T) for x, fill in ((units, 0), (target, -1), (keep, 1)))
    grads, adam = Gru(model.n_classes * CLASS_SIZE), Adam(model.vector)
    state, total, tokens_seen = np.zeros((lanes, HIDDEN), np.float32), 0.0, 0
    for at in range(0, steps, WINDOW):
        own = slice(at, at + WINDOW)
        n = max(1, int((target[own] >= 0).sum()))
        grads.vector[:] = 0
        logs, state = model.window(units[own], target[own], keep[own], state, grads)
        total, tokens_seen = total + logs, tokens_seen + n
        g = grads.vector
        adam.move(model.vector, g, 1 / max(n, float(np.sqrt(np.dot(g, g)))), rate)  # the mean over the window, of norm 1 at most
    return total / max(1, tokens_seen)


def score_docs(model: Gru, docs: list[np.ndarray], end: int, lanes: int = 1024, columns: int = 16_384) -> np.ndarray:
    """Natural log-likelihood of whole documents (unit numbers without the end), the end included.

    ``columns``: states that are kept before the softmax takes them all, so that a few very long documents do not make it narrow.
    """
    out, h, (by_state, by_unit), embed = np.zeros(len(docs)), HIDDEN, model.joined(), np.ascontiguousarray(model.embed.T)
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for first in range(0, len(order), lanes):
        group = order[first : first + lanes]
        sizes = np.array([len(docs[i]) + 1 for i in group])
        flat = np.concatenate([np.concatenate(([end], docs[i], [end])).astype(np.int32) for i in group])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        # sizes fall: the first so many still have a token at each step
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        state, logs = np.zeros((h, len(group)), np.float32), np.zeros(len(group))
        for a, b in blocks(live.tolist(), columns):
            width = live[a:b]
            ends = np.cumsum(width)
            lane = np.arange(int(ends[-1])) - np.repeat(ends - width, width)
            place = starts[lane] + np.repeat(np.arange(a, b), width)
            units, states = flat[place], model.room("states", h, len(lane))
            for n, done in zip(width.tolist(), ends.tolist(), strict=True):
                given, gates, x = model.room("given", h + EMBED + 1, n), model.room("gates", 4 * h, n), model.room("x", 3 * h, n)
                given[:h], given[h] = state[:, :n], 1
                embed.take(units[done - n : done], axis=1, mode="clip", out=given[h + 1 :])
                np.matmul(by_state.T, given[: h + 1], out=gates[h:])
                np.matmul(by_unit.T, given[h:], out=x)
                state = states[:, done - n : done]
                model.advance(gates, x, given[:h], state)
            state = state.copy()
            logs += np.bincount(lane, model.outputs(states, np.arange(len(lane)), flat[place + 1])[0], len(group))
        out[group] = logs
    return out


PARAMETERS = "shard int, chunk int, weight double, values array<double>"


def merged(shards: DataFrame, n: int) -> DataFrame:
    """Parameter vectors given as rows (shard, chunk, weight, values): ``n`` weighted means of them, by shard modulo ``n``."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        weight = table.column("weight").to_numpy()
        values = sum(np.asarray(v, np.float64) * w for v, w in zip(table.column("values").to_pylist(), weight.tolist(), strict=True)) / weight.sum()
        part, chunk = (pa.array([k.as_py()], pa.int32()) for k in key)
        return pa.table({"shard": part, "chunk": chunk, "weight": [float(weight.sum())], "values": pa.array([values], pa.list_(pa.float64()))})

    return shards.withColumn("part", F.pmod("shard", F.lit(n)).cast("int")).groupBy("part", "chunk").applyInArrow(add, PARAMETERS)


def average(shards: DataFrame, fan_in: int = 64) -> np.ndarray:
    """Weighted mean of parameter vectors given as rows (shard, chunk, weight, values); about ``fan_in`` rows meet in a task of a step."""
    n = shards.select("shard").distinct().count()
    while n > fan_in:
        n = -(-n // fan_in)
        shards = merged(shards, n)
    rows = sorted(merged(shards, 1).collect(), key=lambda r: r.chunk)
    return np.concatenate([np.array(r["values"]) for r in rows] or [np.zeros(0)]).astype(np.float32)


def fit(docs: DataFrame, units: Units, n_docs: int, rates: tuple[float, ...] = (0.02, 0.01, 0.005), shard_docs: int = 2_000, chunk: int = 4096, fan_in: int = 64) -> np.ndarray:
    """Rounds of training apart and averaging, each over all the ``n_docs`` training documents ``docs`` (units, place).

    A document's shard follows from its place, a hash of its id and text, not from the files or partitions it lies in.
    Only sums over ``fan_in`` shards' parameters are stored.
    """
    model = Gru.start(units)
    n_shards = max(1, round(n_docs / shard_docs))
    dealt = docs.select("units", F.pmod(F.hash("place"), F.lit(n_shards)).cast("int").alias("shard"))
    for rate in rates if n_docs else ():
        held = docs.sparkSession.sparkContext.broadcast((units, model.vector))  # half a million bytes, whatever the corpus

        def learn(batches: Iterator[pa.RecordBatch], held=held, rate=rate) -> Iterator[pa.RecordBatch]:
            own_units, vector = held.value
            shards: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for row, shard in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    shards.setdefault(shard, []).append(np.frombuffer(row, np.uint16).astype(np.int32))
            for shard, rows in shards.items():
                rows.sort(key=lambda r: zlib.crc32(r.tobytes()))  # a mixed but repeatable order
                own_model = Gru(len(own_units.mass), vector.copy())
                train(own_model, rows, own_units.end, rate)
                parts = [own_model.vector[i : i + chunk] for i in range(0, len(vector), chunk)]
                n, weight = len(parts), float(sum(len(r) + 1 for r in rows))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([weight] * n), pa.array(parts, pa.list_(pa.float32()))], names=["shard", "chunk", "weight", "values"])

        trained = dealt.repartitionById(n_shards, "shard").mapInArrow(learn, "shard int, chunk int, weight double, values array<float>")
        vector = average(stored(merged(trained, -(-n_shards // fan_in))))
        if len(vector):
            model = Gru(len(units.mass), vector)
    return model.vector


def head_count(counts: DataFrame) -> int:
    """The least count such that at most HEAD words have it or more, as far as classes of like counts (an eighth of an octave) tell."""
    classes = counts.groupBy(F.floor(8 * F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()  # at most 512 rows
    total, least = 0, 1 << 62
    for r in sorted(classes, key=lambda r: -r.k):
        total += r.n
        if total > HEAD:
            break
        least = r.least
    return least


#: What ``encode`` tells of a document besides its key, id and place.
CODED = "n_tokens long, n_known long, base double, shared double, units binary, rest array<struct<token string, tf long>>"


def encode(batches: Iterator[pa.RecordBatch], units: Units, head: Head, ends: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, text, place, learnt) as units, what head words give to their scores, and all other words with their numbers."""
    key, tails, log_end = TaskContext.get().partitionId() << 33, {}, math.log10(ends + SMOOTH)
    for b in batches:
        texts = text_bytes(b.column(1))
        for start, end in blocks(map(len, texts)):
            n, words, sizes = end - start, [], []
            for text in texts[start:end]:
                own = tokens(text)
                words += own
                sizes.append(len(own))
            place = np.fromiter(map(head.place.get, words, repeat(-1)), np.int64, len(words))
            unknown = np.flatnonzero(place < 0)
            rare = [words[i] for i in unknown.tolist()]
            bucket = bucket_numbers(rare, tails)
            # -1: the value at the end
            unit, base, shared = (np.append(values, 0)[place] for values in (head.unit, head.log, head.adds))
            unit[unknown], shared[unknown] = units.bucket[bucket], -units.share[bucket]
            doc = np.repeat(np.arange(n), sizes)
            of_rare = np.searchsorted(doc[unknown], np.arange(n + 1)).tolist()
            found = [Counter(rare[i:j]) for i, j in zip(of_rare, of_rare[1:], strict=False)]
            ids = np.arange(key, key + n)
            key += n
            cuts, flat = np.cumsum([0, *sizes]).tolist(), unit.astype(np.uint16)  # at most 1 + OWN + BUCKETS units
            sizes, lists = np.array(sizes), np.cumsum([0, *map(len, found)])
            rest = pa.StructArray.from_arrays([pa.array([w for c in found for w in c], pa.binary()).cast(pa.string()), pa.array([tf for c in found for tf in c.values()], pa.int64())], names=["token", "tf"])
            columns = {
                "key": ids, "id": b.column(0).slice(start, n), "place": b.column(2).slice(start, n), "learnt": b.column(3).slice(start, n),
                "n_tokens": sizes + 1, "n_known": int(ends > 0) + sizes - np.diff(of_rare),
                "base": log_end + np.bincount(doc, base, n), "shared": np.bincount(doc, shared, n).astype(np.float64),  # of no words at all it is whole numbers
                "units": pa.array([flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                "rest": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rest),
            }
            yield pa.RecordBatch.from_pydict(columns)


def score(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score (unigram) and score (model), both log10."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    counts = stored(counts_of(docs.where(train_rows), text_col))
    end_row = F.col("token") == END
    n, v, ends = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(end_row, F.col("c")))).first()
    n, v, ends = n or 0, v or 0, ends or 0
    short = counts.where(~end_row & (F.octet_length("token") <= LONGEST))
    head = short.where(F.col("c") >= head_count(short)).collect()  # at most HEAD words
    head.sort(key=lambda r: (-r.c, r.token))
    own = [(r.token, r.c) for r in head[:OWN]]
    # what each bucket's words weigh: all words but those with a unit of their own
    bucket = F.pmod(F.crc32(F.substring("token", -2, 2).cast("binary")), F.lit(BUCKETS)).cast("int")
    masses = counts.where(~end_row).groupBy(bucket.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")).collect()
    mass = np.full(BUCKETS, SMOOTH)
    for r in masses:
        mass[r.k] += r.c + SMOOTH * r.types
    for k, (_, c) in zip(bucket_numbers([w.encode() for w, _ in own], {}).tolist(), own, strict=True):
        mass[k] -= c + SMOOTH
    units = Units.of(own, ends, np.maximum(mass, SMOOTH))
    place, learnt = F.xxhash64(id_col, text_col), F.coalesce(train_rows, F.lit(False))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), place.alias("place"), learnt.alias("learnt"))
    held = spark.sparkContext.broadcast((units, Head.of([(r.token, r.c) for r in head], units), ends))  # bounded by HEAD words
    coded = stored(narrow.mapInArrow(lambda batches: encode(batches, *held.value), f"key long, id {kind}, place long, learnt boolean, {CODED}"))
    model = spark.sparkContext.broadcast((units, fit(coded.where("learnt"), units, ends, **options)))  # bounded by the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, vector = model.value
        own_model = Gru(len(units.mass), vector)
        for b in batches:
            rows = b.column("units").to_pylist()
            for start, end in blocks(map(len, rows), 8 << 20):
                likely = score_docs(own_model, [np.frombuffer(row, np.uint16).astype(np.int32) for row in rows[start:end]], units.end) / math.log(10)
                part = b.slice(start, end - start).drop_columns(["units", "shared"])
                yield part.append_column("score", pa.array(likely + b.column("shared").to_numpy()[start:end]))

    sums = ["key", "id", "n_tokens", "n_known", "base"]
    scored = coded.select(*sums, "shared", "units").mapInArrow(run, f"key long, id {kind}, n_tokens long, n_known long, base double, score double")
    terms = F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more")
    rare = coded.select("key", F.inline("rest")).join(counts.hint("shuffle_hash"), "token", "left").groupBy("key").agg(*terms)
    whole = scored.join(rare, "key", "left").na.fill(0, ["rare", "more"])
    per_token = math.log10(n + SMOOTH * (v + 1))
    return whole.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") - F.col("n_tokens") * per_token).alias("base_score"), (F.col("score") + F.col("rare")).alias("score"),
    )
