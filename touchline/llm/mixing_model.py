"""Logistic context mixing over running text, in numpy.

A text is coded token by token.  A word that training saw is drawn from one of three orders: from the words
that followed the two words before, the one word before, or all words of training, each with its share of
their counts.  A gate a order says, from the highest down, how likely the word is drawn there, so a word's
probability is the mixture of its shares at all orders that have it, and what no gate takes goes to a word
that training never saw, which is spelled, bit by bit, with its bytes and a closing space.

Every gate and spelling bit is predicted by several hashed contexts: a context's slot holds the counts of noughts
and ones that were met there, over all training text.  Their stretched probabilities are mixed with weights from
a set that a gate chooses.  The contexts of gates are what a reader of the text knows at that place: how often the
words before were met, at which order the last three words were found, how long the current run of words known
from the same place is, the share of such words in the text so far, and the word before.

The slots are sums over the training tokens, and the weights take one Newton step of the logistic loss from
equal ones, over all training texts, with each token's own bit taken out of the slots.  So neither depends
on how the texts are dealt out.  While a text is read, each gate is refined adaptively, online: by how often the word
was drawn there at the places before, in the same text, where the gate was about as open.

Each bit splits its probability, so those of all texts sum to at most 1 (a spelled word may be a known one,
which wastes a little).

A token of a training text is predicted from the counts without its own occurrence, as it would be in
a new text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

END = b"\n"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
RIDGE = 20.0  # pulls the weights of rare gates back to where they start
LEVELS, LEVEL_STEP = 9, 0.7  # classes of a gate's stretched probability, and per unit of it
PATIENCE = 150.0  # bits that a prediction counts for, against those met in the text
TINY = 1e-300


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def size_class(n: np.ndarray, most: int) -> np.ndarray:
    """0, 1, 2-3, 4-7, ... as 0, 1, 2, 3, ... up to ``most``."""
    return np.minimum(np.frexp(n.astype(np.float64))[1], most).astype(np.int32)


CONF = 6  # classes of how much a slot has seen


def confidence(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(seen.astype(np.float32) + np.float32(1.0))[1] // 2 + (seen > 0), CONF - 1)


class Mixer:
    """Predicts bits from the slots of K contexts.

    ``cells`` holds the noughts and ones of all contexts' slots; they are counts, so those of several learners
    add up.  ``weights`` holds those of the contexts and of a constant for each gate.
    """

    def __init__(self, sizes: tuple[int, ...], gates: int):
        self.k = len(sizes)
        self.first = np.cumsum([0, *sizes])
        self.cells = np.zeros((int(self.first[-1]), 2), np.int32)
        self.weights = np.full((self.k + 1, gates), 1.0 / self.k, np.float32)
        self._frozen: tuple[np.ndarray, np.ndarray] | None = None
        self._without: tuple[np.ndarray, np.ndarray] | None = None

    def freeze(self) -> None:
        """Stretches all slots' counts once, for scoring only."""
        pair = self.cells.astype(np.float32)
        self._frozen = self._stretch(pair), confidence(pair[:, 0] + pair[:, 1]).astype(np.uint8)

    @staticmethod
    def _stretch(pair: np.ndarray) -> np.ndarray:
        return np.log((pair[..., 1] + np.float32(0.05)) / (pair[..., 0] + np.float32(0.05)))

    def without(self) -> tuple[np.ndarray, np.ndarray]:
        """Stretched counts of all slots and how much they have seen (3, slots): as counted, without a nought, without a one."""
        if self._without is None:
            pair = self.cells.astype(np.float32) - np.array([[[0, 0]], [[1, 0]], [[0, 1]]], np.float32)
            np.maximum(pair, 0, out=pair)  # where there is none, none is taken
            self._without = self._stretch(pair), confidence(pair[..., 0] + pair[..., 1]).astype(np.uint8)
        return self._without

    def count(self, slots: list[np.ndarray], bits: np.ndarray) -> None:
        self._without = None
        for k, slot in enumerate(slots):
            cells, at = self.cells[self.first[k] : self.first[k + 1]].reshape(-1), 2 * slot + bits
            if len(cells) <= 4 * len(at):
                np.add(cells, np.bincount(at, minlength=len(cells)), out=cells, casting="unsafe")
            else:
                np.add.at(cells, at, np.int32(1))

    def left_out(self, bits: np.ndarray, own: np.ndarray | bool = True) -> np.ndarray:
        """Where the tables of ``without`` begin for these bits, which were counted themselves where ``own``."""
        return np.where(own, bits + 1, 0) * len(self.cells)

    def confidence(self, k: int, slot: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
        """How much the slots of context ``k`` have seen, as a class; ``left``: of ``left_out``."""
        if left is None:
            return self._frozen[1][self.first[k] : self.first[k + 1]][slot]
        return self.without()[1].reshape(-1)[self.first[k] :][left + slot]

    def inputs(self, slots: list[np.ndarray], left: np.ndarray | None = None) -> np.ndarray:
        """Stretched predictions (K + 1, bits), of frozen slots or, with ``left_out``, without the bits themselves; the last one is constant."""
        x = np.empty((self.k + 1, len(slots[0])), np.float32)
        x[self.k] = 0.3
        for k, slot in enumerate(slots):
            if left is None:
                np.take(self._frozen[0][self.first[k] : self.first[k + 1]], slot, out=x[k], mode="clip")
            else:
                np.take(self.without()[0].reshape(-1)[self.first[k] :], left + slot, out=x[k], mode="clip")
        return x

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        dot = x[self.k] * self.weights[self.k][gate]
        for k in range(self.k):
            dot += x[k] * self.weights[k][gate]
        return np.clip(dot, -11.0, 11.0, out=dot)


class Moments:
    """Sums for one Newton step of a mixer's weights: gradients, and curvatures above the diagonal, by gate."""

    def __init__(self, mixer: Mixer):
        self.n, self.gates = mixer.weights.shape
        self.pairs = [(i, j) for i in range(self.n) for j in range(i, self.n)]
        self.sums = np.zeros((self.n + len(self.pairs), self.gates))

    def add(self, x: np.ndarray, gate: np.ndarray, miss: np.ndarray, spread: np.ndarray) -> None:
        if not len(gate):
            return
        order = np.argsort(gate.astype(np.uint16), kind="stable")  # small keys are sorted by radix
        x, gate = x.astype(np.float64)[:, order], gate[order]
        both = np.empty((self.n + 1, len(gate)))
        np.multiply(x, spread[order], out=both[: self.n])
        both[self.n] = miss[order]
        starts = np.flatnonzero(np.concatenate([[True], gate[1:] != gate[:-1]]))
        first, second = np.array([*((self.n, k) for k in range(self.n)), *self.pairs]).T
        for g, a, b in zip(gate[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(gate)]):
            self.sums[:, g] += (both[:, a:b] @ x[:, a:b].T)[first, second]

    def step(self, weights: np.ndarray) -> np.ndarray:
        curve = np.zeros((self.gates, self.n, self.n))
        for k, (i, j) in enumerate(self.pairs):
            curve[:, i, j] = curve[:, j, i] = self.sums[self.n + k]
        move = np.linalg.solve(curve + RIDGE * np.eye(self.n), self.sums[: self.n].T[..., None])[..., 0]
        return (weights + move.T).astype(np.float32)


def sigmoid(dot: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-dot.astype(np.float64)))


# ---- decisions ---------------------------------------------------------------------------

HISTORY, RUNS, SHARES, COUNTS, SEEN = 5, 7, 8, 10, 6  # numbers of classes
WORD_BITS = 16  # slots for the word before, as a power of 2


class Tokens(NamedTuple):
    """Tokens of some texts one after the other, with what training knows of them.

    word: 64-bit hash; first: place of each text's first token; own: whether the text is of training;
    c0, c1, c2: occurrences in training of the word, of it after the word before, and after the
    two before; total: tokens of training; texts: texts of training.
    """

    word: np.ndarray
    first: np.ndarray
    own: np.ndarray
    c0: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    total: int
    texts: int


def some_texts(t: Tokens, chosen: np.ndarray) -> Tokens:
    """The tokens of the texts that ``chosen`` marks."""
    sizes = np.diff(np.append(t.first, len(t.word)))
    among, left = np.repeat(chosen, sizes), sizes[chosen]
    return Tokens(t.word[among], np.cumsum(left) - left, t.own[chosen], t.c0[among], t.c1[among], t.c2[among], t.total, t.texts)


class Reading:
    """What is known at each token: counts without the own occurrence, the order found, the history."""

    def __init__(self, t: Tokens):
        n = len(t.word)
        self.n = n
        sizes = np.diff(np.append(t.first, n))
        self.text = np.repeat(np.arange(len(sizes)), sizes)  # which one each token is of
        own = np.repeat(t.own, sizes).astype(np.int64)
        start = np.zeros(n, bool)
        start[t.first] = True
        before = np.maximum(np.arange(n) - 1, 0)
        self.c = [np.maximum(c - own, 0) for c in (t.c0, t.c1, t.c2)]
        after_one = np.where(start, t.texts, t.c0[before]) - own
        after_two = np.where(start, 0, t.c1[before] - own)
        self.n_at = [np.maximum(t.total - own, 0), np.maximum(after_one, self.c[1]), np.where(start, 0, np.maximum(after_two, self.c[2]))]
        found = [(self.c[k] > 0) & (self.n_at[k] > 0) for k in range(3)]
        self.found = np.where(found[2], 3, np.where(found[1], 2, found[0])).astype(np.int32)  # 0: a new word
        place = np.arange(n) - np.repeat(t.first, sizes)
        self.history = np.zeros(n, np.int32)
        for back in (1, 2, 3):
            earlier = np.full(n, HISTORY - 1, np.int32)
            earlier[back:] = self.found[:-back]
            earlier[place < back] = HISTORY - 1
            self.history = self.history * np.int32(HISTORY) + earlier
            if back == 1:
                self.last = earlier
        hit, open_ = found[2].astype(np.int64), (self.n_at[2] > 0).astype(np.int64)
        hits, chances = (np.cumsum(x) - x for x in (hit, open_))
        hits, chances = (x - np.repeat(x[t.first], sizes) for x in (hits, chances))
        self.share = np.minimum(SHARES * hits // (chances + 1), SHARES - 1).astype(np.int32)
        self.seen = size_class(chances, SEEN - 1)
        # where the run of words found at the highest order that reaches each token began
        began = np.maximum.accumulate(np.where((hit == 0) | start, np.arange(n) + (hit == 0), 0))
        run = np.zeros(n, np.int64)
        run[1:] = np.arange(1, n) - began[:-1]
        run[start] = 0
        self.run = size_class(run, RUNS - 1)
        word = np.zeros(n, np.uint64)
        word[1:] = t.word[:-1]
        word[start] = 0
        self.before = (scramble(word + np.uint64(1)) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        self.count_class = [np.zeros(n, np.int32), size_class(self.n_at[1], COUNTS - 1), size_class(self.n_at[2], COUNTS - 1)]

    def places(self, k: int, among: np.ndarray | None = None) -> np.ndarray:
        """Places where there is a gate of order ``k``: something followed."""
        there = np.broadcast_to(self.n_at[k] > 0, self.n)
        return np.flatnonzero(there if among is None else there & among)

    def share_of(self, k: int) -> np.ndarray:
        """Each word's share of what followed at order ``k``."""
        return self.c[k] / np.maximum(self.n_at[k], 1)

    def contexts(self, k: int, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of gates of order ``k``: slots of the contexts, the set of weights, the bit (is it the highest order that has the word?), and whether that was asked."""
        count, run, share, last = self.count_class[k][at], self.run[at], self.share[at], self.last[at]
        lower = self.count_class[max(k - 1, 0)][at]
        slots = [
            (k * COUNTS + count) * RUNS + run,
            k * HISTORY**3 + self.history[at],
            ((k * SHARES + share) * SEEN + self.seen[at]) * COUNTS + count,
            (k << WORD_BITS) + self.before[at],
            ((k * COUNTS + count) * COUNTS + lower) * HISTORY + last,
        ]
        return slots, (k * COUNTS + count) * HISTORY + last, (self.found[at] == k + 1).astype(np.int32), self.found[at] <= k + 1


def decision_mixer() -> Mixer:
    return Mixer((3 * COUNTS * RUNS, 3 * HISTORY**3, 3 * SHARES * SEEN * COUNTS, 3 << WORD_BITS, 3 * COUNTS * COUNTS * HISTORY), 3 * COUNTS * HISTORY)


BATCH = 1 << 14  # gates handled at once


def _batches(at: np.ndarray) -> Iterator[np.ndarray]:
    return (at[a : a + BATCH] for a in range(0, len(at), BATCH))


def count_decisions(mixer: Mixer, reading: Reading, training: np.ndarray) -> None:
    """Counts the gates' bits at the tokens that ``training`` marks."""
    for k in range(3):
        for at in _batches(reading.places(k, training & (reading.found <= k + 1))):
            slots, _, bits, _ = reading.contexts(k, at)
            mixer.count(slots, bits)


def mixture(reading: Reading, gates: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each word's probability but for the spelling of new ones, and its parts by order; gates[k]: how open each is, nought where there is none."""
    rest, parts = np.ones(reading.n), [np.zeros(reading.n)] * 3
    for k in (2, 1, 0):
        parts[k] = rest * gates[k] * reading.share_of(k)
        rest = rest * (1.0 - gates[k])
    return np.maximum(np.where(reading.found == 0, rest, parts[0] + parts[1] + parts[2]), TINY), parts


def weigh_decisions(mixer: Mixer, reading: Reading, moments: Moments) -> None:
    """Adds the moments of the log-probability of the words of training texts.

    A word is drawn at an order with its part of the mixture's probability, so that is the soft bit of a gate.
    """
    inputs, gates = [], []
    for k in range(3):
        own, opened = [], np.zeros(reading.n)
        for some in _batches(reading.places(k)):
            slots, gate, bits, asked = reading.contexts(k, some)
            x = mixer.inputs(slots, mixer.left_out(bits, asked))
            opened[some] = sigmoid(mixer.mix(x, gate))
            own.append((some, x, gate))
        inputs.append(own)
        gates.append(opened)
    total, parts = mixture(reading, gates)
    reached = np.ones(reading.n)
    for k in (2, 1, 0):
        drawn = parts[k] / total
        for at, x, gate in inputs[k]:
            p, r = gates[k][at], reached[at]
            moments.add(x, gate, drawn[at] - r * p, r * p * (1.0 - p))
        reached = reached - np.where(gates[k] > 0, drawn, 0.0)


def before_in_text(key: np.ndarray, ones: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many earlier rows of its key were asked, and how many of these were ones."""
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")  # small keys are sorted by radix
    start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    out = []
    for x in (asked, ones & asked):
        y = x[order].astype(np.float64)
        y = np.cumsum(y) - y
        back = np.empty(len(key))
        back[order] = y - y[start][group]
        out.append(back)
    return out[0], out[1]


def decision_scores(mixer: Mixer, reading: Reading) -> np.ndarray:
    """log10 probability of each token but for the spelling of new words; gates are refined while each text is read."""
    gates = []
    for k in range(3):
        at, opened = reading.places(k), np.zeros(reading.n)
        dot = np.concatenate([mixer.mix(mixer.inputs(slots), gate) for slots, gate, _, _ in (reading.contexts(k, some) for some in _batches(at))] or [np.zeros(0, np.float32)])
        level = np.clip(np.rint(dot * np.float32(LEVEL_STEP)) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)
        if len(at):
            asked, ones = before_in_text(reading.text[at] * LEVELS + level, reading.found[at] == k + 1, reading.found[at] <= k + 1)
            opened[at] = (PATIENCE * sigmoid(dot) + ones) / (PATIENCE + asked)
        gates.append(opened)
    return np.log10(mixture(reading, gates)[0])


# ---- spelling ----------------------------------------------------------------------------

ORDERS = (1, 2, 3, -1)  # bytes before; -1: all of the word
TABLE_BITS = (16, 17, 18, 18)  # slots of each context's table, as powers of 2
CHUNK_BYTES = 8_000  # spelled bytes handled at once: eight times as many bits
COUNT_RUNS = 8  # runs of words counted at once
_NODES = np.arange(8)


def spelling_mixer() -> Mixer:
    return Mixer(tuple(1 << b for b in TABLE_BITS), CONF * CONF)


#: Of each byte, its bits before each of its own (with a leading one), as what they add to a slot's hash.
_BITS_BEFORE = ((np.uint64(1) << _NODES.astype(np.uint64)) | (np.arange(256, dtype=np.uint64)[:, None] >> (8 - _NODES).astype(np.uint64))) * _ODD2 * _ODD


class Spelling:
    """Bytes, bits and context slots of some words; ``starts``: each word's first bit."""

    def __init__(self, words: list[bytes]):
        spelled = [w if w == END else w + b" " for w in words]
        sizes = np.array([len(w) for w in spelled], np.int64)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes)
        self.starts = 8 * (ends - sizes)
        place = np.arange(n) - np.repeat(ends - sizes, sizes)
        self.bits = np.unpackbits(data).astype(np.int64)
        padded = data.astype(np.uint64) + np.uint64(1)
        before = []
        for back in range(1, max(ORDERS) + 1):
            b = np.zeros(n, np.uint64)
            b[back:] = padded[:-back]
            b[place < back] = 0
            before.append(b)
        # the whole prefix: a polynomial in the bytes, summed within the word
        power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _ODD), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * power[place], dtype=np.uint64)[:-1]])
        prefix = total - np.repeat(total[ends - sizes], sizes)
        nodes = _BITS_BEFORE[data]
        self.slots = []
        for k, order in enumerate(ORDERS):
            h = np.full(n, k + 1, np.uint64) + (prefix if order < 0 else np.uint64(0))
            for b in before[: max(0, order)]:
                h = h * np.uint64(257) + b
            h = (((h * _ODD) ^ (h >> np.uint64(29))) * _ODD)[:, None] + nodes
            h >>= np.uint64(64 - TABLE_BITS[k])
            self.slots.append(h.view(np.int64).ravel())

    def gates(self, seen: Callable[[int], np.ndarray]) -> np.ndarray:
        """The set of weights, by how much the two longest contexts have seen."""
        return seen(2).astype(np.int64) * CONF + seen(3)


def runs(words: list[bytes]) -> Iterator[slice]:
    """Runs of words of about CHUNK_BYTES spelled bytes."""
    ends = np.cumsum([len(w) + 1 for w in words])
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1).tolist(), len(words)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def count_spelling(mixer: Mixer, words: list[bytes]) -> None:
    waiting: list[Spelling] = []

    def count() -> None:
        mixer.count([np.concatenate([s.slots[k] for s in waiting]) for k in range(mixer.k)], np.concatenate([s.bits for s in waiting]))
        waiting.clear()

    for part in runs(words):
        waiting.append(Spelling(words[part]))
        if len(waiting) == COUNT_RUNS:
            count()
    if waiting:
        count()


def weigh_spelling(mixer: Mixer, words: list[bytes], moments: Moments) -> None:
    """Adds the moments of the spelling of words that were counted."""
    for part in runs(words):
        s = Spelling(words[part])
        left = mixer.left_out(s.bits)
        x, gate = mixer.inputs(s.slots, left), s.gates(lambda k: mixer.confidence(k, s.slots[k], left))
        p = sigmoid(mixer.mix(x, gate))
        moments.add(x, gate, s.bits - p, p * (1.0 - p))


def spelling_scores(mixer: Mixer, words: list[bytes]) -> np.ndarray:
    """log10 probability of the spelling of each word."""
    out = np.zeros(len(words))
    for part in runs(words):
        s = Spelling(words[part])
        dot = mixer.mix(mixer.inputs(s.slots), s.gates(lambda k: mixer.confidence(k, s.slots[k])))
        nats = np.log1p(np.exp(np.where(s.bits == 1, -dot, dot)))
        out[part] = np.add.reduceat(nats, s.starts, dtype=np.float64) / -np.log(10.0)
    return out
