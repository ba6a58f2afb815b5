"""Main text of web pages: a recurrent block labeller over leaf sequences.

A page is parsed into blocks.  Each block is a vector: tags and names along its path, its
hashed words, and a few measures (length, link share, place).  A bidirectional LSTM in
numpy reads the whole sequence of the page's blocks forwards and backwards, and labels each as main text or not, so a
block is judged in the context of the whole document.  Main blocks are joined in page order.

The model is trained where it is used, on the driver, on TRAIN_PAGES made-up pages with
known main text (html_pages) from a fixed seed; the same seed gives the same weights.  It
takes a constant time, whatever the input, and its weights (about a megabyte) go
to the tasks with the function.

Defined cases: a null or empty page has empty text; so has a page without a main block; an
empty table gives an empty table; null ids and urls are kept; repeated rows give repeated
results; further columns are left out.  Pages of any length are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_blocks import Block, Path, parse
from .html_pages import PageMaker
from .store import read_columns

TRAIN_PAGES, TRAIN_SEED, EPOCHS, BATCH, RATE = 2000, 7, 6, 16, 0.01
EMBED, HIDDEN = 32, 24
DECAY = 0.05  # of the weights, times the rate, in a step
SLICE = 2048  # blocks embedded at once
NO_WORDS = 0.2  # share of blocks whose words are hidden in a training step, so that no label hangs on them alone
WORD_SLOTS, NAME_SLOTS = 1 << 13, 64
KNOWN_PAGES = 40  # a word on so many training pages has a slot of its own
#: Tags with a slot of their own; the last one is for all others.
TAGS = "html body article main section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption label button address details summary other".split()
#: Names from class, id and role with a slot of their own.
NAMES = (
    "content main post entry article story text body prose page ad ads advert advertisement banner sponsored promo adbox slot nav menu navbar "
    "navigation breadcrumb breadcrumbs toc pagination header masthead branding logo topbar top bar footer copyright colophon legal bottom cookie "
    "notice alert gdpr consent popup modal notification share social sharing buttons follow related popular more recommended widget latest posts "
    "stories comments comment discussion replies responses disqus user list newsletter subscribe search login signup contact sidebar side aside "
    "rail secondary area site wrapper container title byline author date tags meta"
).split()
_TAG = {t: k for k, t in enumerate(TAGS)}
_NAME = {n: k for k, n in enumerate(NAMES)}
N_MEASURES = 8
AT_TAGS = 0
AT_LEAF = AT_TAGS + len(TAGS)
AT_NAMES = AT_LEAF + len(TAGS)
AT_OTHER = AT_NAMES + len(NAMES)
AT_WORDS = AT_OTHER + NAME_SLOTS
AT_MEASURES = AT_WORDS + WORD_SLOTS
WIDTH = AT_MEASURES + N_MEASURES


def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


class _WordSlots(dict):
    """Slots of words, kept as they are met: known ones have a hashed slot, all others share the last one."""

    def __init__(self, known: frozenset[int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        h = _word_hash(word)
        slot = AT_WORDS + (h % (WORD_SLOTS - 1) if h in self.known else WORD_SLOTS - 1)
        if len(self) < 1 << 17:  # bounds memory; rarer words are hashed again
            self[word] = slot
        return slot


@lru_cache(maxsize=2)
def _word_slots(known: frozenset[int]) -> _WordSlots:
    return _WordSlots(known)


def _slots_along(path: Path) -> frozenset[int]:
    """Slots of the tags and names from the root down; kept with the path, shared where nothing is new."""
    todo = []
    while path is not None and path.kept is None:
        todo.append(path)
        path = path.above
    slots = path.kept if path is not None else frozenset()
    for p in reversed(todo):
        own = {AT_TAGS + _TAG.get(p.tag, len(TAGS) - 1)}
        own |= {AT_NAMES + _NAME[n] if n in _NAME else AT_OTHER + zlib.crc32(n.encode()) % NAME_SLOTS for n in p.names}
        slots = slots if own <= slots else slots | own
        p.kept = slots
    return slots


@lru_cache(maxsize=1 << 14)
def _path_slots(along: frozenset[int], tag: str) -> tuple[int, ...]:
    return tuple(sorted(along | {AT_LEAF + _TAG.get(tag, len(TAGS) - 1)}))


class Rows(NamedTuple):
    """Sparse rows of blocks, one after the other: places and values of what is not nought, and how many each row has."""

    index: np.ndarray
    value: np.ndarray
    sizes: np.ndarray


def vectors(blocks: list[Block], known: frozenset[int]) -> Rows:
    """One row per block: path, hashed words (of length 1) and measures.

    Words whose hash is not ``known`` from training share one slot, so that a rare word is not taken
    for another one that happens to have its slot.
    """
    index, value, sizes, total, slot = [], [], [], len(blocks), _word_slots(known).__getitem__
    measures, log = range(AT_MEASURES, WIDTH), math.log1p
    for k, b in enumerate(blocks):
        path = _path_slots(_slots_along(b.path), b.path.tag) if b.path is not None else ()
        words = b.text.split()
        counts = Counter(map(slot, words))
        scale = 1 / math.sqrt(sum(c * c for c in counts.values()))
        n = len(b.text)
        index += path
        index += counts
        index += measures
        value += [1.0] * len(path)
        value += [c * scale for c in counts.values()]
        value += (
            log(len(words)) / 4, log(n) / 6, b.link_chars / n, b.text[-1] in ".!?:;", k / total, log(k) / 4, log(total - k) / 4,
            min(b.path.depth if b.path else 0, 64) / 8,
        )
        sizes.append(len(path) + len(counts) + N_MEASURES)
    return Rows(np.array(index, np.int64), np.array(value, np.float32), np.array(sizes, np.int64))


def together(parts: list[Rows]) -> Rows:
    return Rows(*map(np.concatenate, zip(*parts)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class BlockLabeller:
    """Embedding, LSTMs in both directions and a logistic output, with training by back-propagation."""

    def __init__(self, seed: int):
        self.known: frozenset[int] = frozenset()  # hashes of the words with slots of their own
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"we": draw(WIDTH, EMBED) * 2, "be": np.zeros(EMBED, np.float32), "wo": draw(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": draw(EMBED, 4 * HIDDEN), f"wh{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open

    @staticmethod
    def _padded(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Time-major (longest, pages, features), the mask, and where each flat row went."""
        page = np.repeat(np.arange(len(sizes)), sizes)
        step = np.concatenate([np.arange(n) for n in sizes])
        out = np.zeros((max(sizes), len(sizes), flat.shape[1]), np.float32)
        out[step, page] = flat
        mask = np.zeros((max(sizes), len(sizes), 1), np.float32)
        mask[step, page] = 1.0
        return out, mask, step * len(sizes) + page

    def _run(self, z: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states by step of one direction; ``keep`` gathers what the way back needs."""
        p, steps = self.p, range(len(z)) if d == "f" else range(len(z) - 1, -1, -1)
        gates = z @ p[f"wx{d}"] + p[f"b{d}"]
        h = c = np.zeros((z.shape[1], HIDDEN), np.float32)
        out = np.empty((*z.shape[:2], HIDDEN), np.float32)
        for t in steps:
            g = gates[t] + h @ p[f"wh{d}"]
            ifo, u = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            new = f * c + i * u
            tanh = np.tanh(new)
            m = mask[t]
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tanh))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out

    def embedded(self, rows: Rows) -> np.ndarray:
        """Embeddings of blocks: sums of weight rows, SLICE blocks at once."""
        ends, out = np.cumsum(rows.sizes), []
        for at in range(0, len(ends), SLICE):
            low, high = ends[at] - rows.sizes[at], ends[min(at + SLICE, len(ends)) - 1]
            products = self.p["we"][rows.index[low:high]] * rows.value[low:high, None]
            starts = (ends - rows.sizes)[at : at + SLICE] - low  # no row is empty: all have measures
            out.append(np.tanh(np.add.reduceat(products, starts) + self.p["be"]))
        return np.concatenate(out)

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """Log odds of main text for every block of some pages, one after the other."""
        z, mask, at = self._padded(np.concatenate([self.embedded(vectors(blocks, self.known)) for blocks in pages]), [len(blocks) for blocks in pages])
        both = np.concatenate([self._run(z, mask, d, None) for d in "fb"], 2)
        return (both.reshape(-1, 2 * HIDDEN)[at] @ self.p["wo"] + self.p["bo"]).astype(np.float32)

    def gradients(self, rows: Rows, sizes: list[int], target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of labels and its gradients, by back-propagation through time."""
        p = self.p
        e = self.embedded(rows)
        z, mask, at = self._padded(e, sizes)
        kept = {d: [] for d in "fb"}
        both = np.concatenate([self._run(z, mask, d, kept[d]) for d in "fb"], 2).reshape(-1, 2 * HIDDEN)
        y = _sigmoid(both[at] @ p["wo"] + p["bo"])
        loss = -float(np.mean(np.log(np.where(target > 0.5, y, 1 - y) + 1e-7)))
        dy = (y - target) / len(target)
        g = {"wo": both[at].T @ dy, "bo": dy.sum(keepdims=True)}
        dboth = np.zeros_like(both)
        dboth[at] = dy[:, None] * p["wo"]
        dboth = dboth.reshape(*z.shape[:2], 2 * HIDDEN)
        dz = np.zeros_like(z)
        for d, cols in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            dh = dc = np.zeros((z.shape[1], HIDDEN), np.float32)
            dgates = np.zeros((*z.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(p[f"wh{d}"])
            for t, h, c, i, f, o, u, tanh in reversed(kept[d]):
                m = mask[t]
                dh = dh + dboth[t, :, cols]
                dnew_h = dh * m
                dnew_c = dc * m + dnew_h * o * (1 - tanh * tanh)
                dg = dgates[t]
                dg[:, :HIDDEN] = dnew_c * u * i * (1 - i)
                dg[:, HIDDEN : 2 * HIDDEN] = dnew_c * c * f * (1 - f)
                dg[:, 2 * HIDDEN : 3 * HIDDEN] = dnew_h * tanh * o * (1 - o)
                dg[:, 3 * HIDDEN :] = dnew_c * i * (1 - u * u)
                gh += h.T @ dg
                dh = dh * (1 - m) + dg @ p[f"wh{d}"].T
                dc = dc * (1 - m) + dnew_c * f
            flat_gates = dgates.reshape(-1, 4 * HIDDEN)
            g |= {f"wx{d}": z.reshape(-1, EMBED).T @ flat_gates, f"wh{d}": gh, f"b{d}": flat_gates.sum(0)}
            dz += dgates @ p[f"wx{d}"].T
        de = dz.reshape(-1, EMBED)[at] * (1 - e * e)
        g |= {"we": np.zeros_like(p["we"]), "be": de.sum(0)}
        np.add.at(g["we"], rows.index, rows.value[:, None] * np.repeat(de, rows.sizes, 0))
        return loss, g

    def train(self, pages: list[tuple[Rows, np.ndarray]], epochs: int, rate: float, seed: int) -> float:
        """Adam over batches of pages of like length; the weights are the mean of the second half (of evenly many epochs).

        Returns the last epoch's mean loss.
        """
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        mean_of = {k: np.zeros(v.shape) for k, v in self.p.items()}
        order, step, mean = sorted(range(len(pages)), key=lambda k: len(pages[k][1])), 0, 0.0
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for epoch in range(epochs):
            losses = []
            for b in r.permutation(len(batches)):
                own = [pages[k] for k in batches[b]]
                x = together([rows for rows, _ in own])
                hidden = np.repeat(r.random(len(x.sizes)) < NO_WORDS, x.sizes) & (x.index >= AT_WORDS) & (x.index < AT_MEASURES)
                x = x._replace(value=np.where(hidden, np.float32(0.0), x.value))
                loss, g = self.gradients(x, [len(y) for _, y in own], np.concatenate([y for _, y in own]))
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                now = rate * (1 - epoch / epochs * 0.8)
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] = ((1 - DECAY * now) * self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                    if 2 * epoch >= epochs:
                        mean_of[k] += self.p[k]
                losses.append(loss)
            mean = float(np.mean(losses))
        self.p = {k: (v / (epochs // 2 * len(batches))).astype(np.float32) for k, v in mean_of.items()}
        return mean


def training_pages(n: int, seed: int) -> tuple[list[tuple[Rows, np.ndarray]], frozenset[int]]:
    """Vectors and labels of the blocks of made-up pages, and the hashes of the words that many of them have."""
    maker, parsed, on_pages = PageMaker(seed), [], Counter()
    for _ in range(n):
        html, main = maker.page()
        blocks, at, label = parse(html), 0, []
        for b in blocks:  # main blocks are met in order
            is_main = at < len(main) and b.text == main[at]
            at += is_main
            label.append(float(is_main))
        if at != len(main):
            raise AssertionError("a made-up page lost a main block")
        parsed.append((blocks, np.array(label, np.float32)))
        on_pages.update({_word_hash(w) for b in blocks for w in b.text.split()})
    known = frozenset(h for h, k in on_pages.items() if k >= KNOWN_PAGES)
    return [(vectors(blocks, known), label) for blocks, label in parsed], known


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> BlockLabeller:
    """The labeller that all queries use; trained once per driver process."""
    model = BlockLabeller(seed)
    examples, model.known = training_pages(pages, seed)
    model.train(examples, EPOCHS, RATE, seed)
    return model


def main_texts(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """The main text of each page; pages of like length are labelled together."""
    parsed = [parse(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 128 and (end - at + 1) * len(parsed[order[end]]) <= 8192:
            end += 1
        own = order[at:end]
        scores = model.scores([parsed[k] for k in own])
        first = 0
        for k in own:
            blocks = parsed[k]
            out[k] = "\n\n".join(b.text for b, s in zip(blocks, scores[first : first + len(blocks)]) if s > 0)
            first += len(blocks)
        at = end
    return out


def _extractor(model: BlockLabeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = main_texts(part.column("html").to_pylist(), model)
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract_main_text(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a map over the rows, no shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extractor(model or trained()), "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_columns(spark, sf_dir, "pages", "page_id", "url", "html"))
