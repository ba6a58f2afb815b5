"""Language-model scores of documents by logistic context mixing (see mixing_model).

Learning takes all words of all training documents, those whose crc32 of the doc_id's text
has remainder other than HELD_OUT by FOLDS:

1. every task reads its documents in chunks and counts, per chunk, the occurrences in training of
   each word, word pair and word triple.  These go, as sorted hashes with their counts, to buckets
   of the hash range, where the counts of all chunks are added up, and each chunk's totals
   go back to it.  What is gathered so grows with the corpus, a bucket has a bounded number of
   n-grams, and an n-gram takes one entry a chunk however often it occurs, so none is hot.  A chunk has a row for each bucket
   where it has n-grams: fewer, longer rows than one an n-gram, which they are at most, so rows are linear in the corpus;
2. every task reads its training documents again, in order, with the totals, and counts the bits of the mixer's
   contexts, which are added up by ranges of cells.  They have a fixed size: they hold no words but how words are met;
3. every task reads its training documents a third time, with these cells, for the sums of a Newton step over all
   training documents, a few thousand numbers, which give the mixer's weights;
4. every task reads its documents once more and scores them.

All that is learnt is a sum over documents, so scores do not depend on files, partitions or chunks but for
the rounding of sums.

N-grams are told apart by hashes, words by 64 bits, pairs and triples by so many bits that two of
the corpus are taken for one with a chance of about 2^-SPARE_BITS each.

The steps meet by (input partition, chunk), so ``docs`` must give the same rows in the same
partitions each time that it is read, as a table does; checksums of the hashes refuse anything else.

Defined cases: a null text is empty and scores its end token; a null doc_id counts as the
empty string and is a training document; rows that repeat count each, and each is scored by
the counts without itself; without training tokens every word is spelled, N and V are 0; an empty
table gives an empty table; further columns are left out.  Words and texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing_model import (
    END, Mixer, Moments, Reading, Tokens, count_decisions, count_spelling, decision_mixer, decision_scores, scramble, some_texts, spelling_mixer, spelling_scores, weigh_decisions, weigh_spelling,
)
from .store import fresh_path, materialise, read_columns
from .token_store import file_system

FOLDS, HELD_OUT = 7, 2
SEED = 42
CHUNK_BYTES = 3 << 20  # text of a chunk; a longer text is a chunk of its own
BUCKET_BYTES = 16 << 20  # text for each bucket of n-grams: some 3 million of each order
PLAIN = 16  # numbers that are not worth compressing
ROWS = 4096  # of a batch
SPARE_BITS = 20  # of a hash beyond what numbers the corpus's n-grams
BLOCK = 1 << 14  # cells of the model in a row
FEW = 512  # of the Newton step's sums in a row
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double"
_PAIR, _TRIPLE = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), then the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


_WHITE = b"\t\n\v\f\r "
_LOWER = bytes(32 if b in _WHITE else b + 32 if 65 <= b <= 90 else b for b in range(256))


def all_tokens(texts: list[bytes | None]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The ``tokens`` of all texts one after the other, and each text's number of them."""
    data = b" ".join((t or b"").translate(_LOWER) + b" \n" for t in texts)  # an end stands as a word of its own
    data = np.frombuffer(data, np.uint8)
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first, data = np.flatnonzero(begins[inside]), data[inside]  # where words begin, among the bytes of words
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)])
    return words, np.diff(np.flatnonzero(data[first] == END[0]), prepend=-1)  # no other word holds an END


class Chunk:
    """Some whole documents, their tokens, and the hashes of n-grams that end at each token."""

    def __init__(self, rows: list[tuple[int | None, bool, bytes | None]], bits: int):
        from xxhash import xxh64_intdigest

        self.doc_id, self.held_out = [r[0] for r in rows], np.array([r[1] for r in rows], bool)
        words, self.sizes = all_tokens([r[2] for r in rows])
        coded = words.dictionary_encode()
        self.number = coded.indices.to_numpy()
        self.words, self.lengths = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), pc.binary_length(coded.dictionary).to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.fromiter(map(xxh64_intdigest, self.words, repeat(SEED)), np.uint64, len(self.words))
        self.word = self.hashes[self.number]
        one, two = self._back(self.word, 1), self._back(self.word, 2)
        pair = scramble(one * _PAIR + self.word)
        triple = scramble(scramble(two * _TRIPLE + one) * _PAIR + self.word)
        self.bits = (64, bits, bits)
        self.grams = [self.word, pair >> np.uint64(64 - bits), triple >> np.uint64(64 - bits)]

    def _back(self, word: np.ndarray, n: int) -> np.ndarray:
        """The word so many places before, nought before the text."""
        out = np.zeros(len(word), np.uint64)
        out[n:] = word[:-n]
        for k in range(n):
            at = self.first + k
            out[at[k < self.sizes]] = 0
        return out

    def training(self) -> np.ndarray:
        """Whether each token is of a training document."""
        return np.repeat(~self.held_out, self.sizes)

    def word_bytes(self) -> np.ndarray:
        """Bytes of each document's words with a space after each, and its end."""
        return np.add.reduceat((self.lengths + 1)[self.number], self.first) - 1

    def in_buckets(self, k: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of order ``k``, the place of each token's, the buckets that have any, and where each begins."""
        if k == 0:  # the distinct words are known already
            keys, place = np.unique(self.hashes, return_inverse=True)
            place = place[self.number]
        else:
            keys, place = np.unique(self.grams[k], return_inverse=True)
        return keys, place, *np.unique(bucket_of(keys, self.bits[k], n_buckets), return_index=True)


def bucket_of(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """The buckets, equal ranges of hashes of so many bits; n_buckets < 2^32."""
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return (top * np.uint64(n_buckets)) >> np.uint64(32)


def _chunks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, Chunk]]:
    """Numbered chunks of (doc_id, held_out, text) rows; cut by the texts' bytes alone."""
    rows, size, number = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            for row in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts):
                rows.append(row)
                size += len(row[2] or b"") + 1
                if size >= CHUNK_BYTES:
                    yield number, Chunk(rows, bits)
                    rows, size, number = [], 0, number + 1
    if rows:
        yield number, Chunk(rows, bits)


# ---- exchange of n-gram counts -------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as their byte planes, compressed: planes of small numbers are all noughts.  A few are kept as they are."""
    if len(values) <= PLAIN:
        return values.astype("<u8").tobytes()
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    if n <= PLAIN:
        return np.frombuffer(data, "<u8").astype(np.uint64, copy=False)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel().astype(np.uint64, copy=False)


GRAMS = "bucket int, gram int, part int, chunk int, n int, grams binary, counts binary"
TOTALS = "part int, chunk int, gram int, bucket int, n int, check long, totals binary"


def _count(bits: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, chunk in _chunks(batches, bits):
            weight, rows = chunk.training().astype(np.float64), []
            for k in range(3):
                keys, place, buckets, firsts = chunk.in_buckets(k, n_buckets)
                counts = np.bincount(place, weight, len(keys)).astype(np.int64)
                for b, low, high in zip(buckets.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(keys)]):
                    rows.append((b, k, part, number, high - low, packed(np.diff(keys[low:high], prepend=np.uint64(0))), packed(counts[low:high])))
                    if len(rows) == ROWS:
                        yield _batch(rows, GRAMS)
                        rows = []
            if rows:
                yield _batch(rows, GRAMS)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.strip().split() for f in schema.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _checksum(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(scramble(keys)).astype(np.int64))


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, gram): adds up a group's counts and answers each of its rows.

    Each group of single words also gives a row of part -1 with its distinct words and tokens of training.
    """
    group: list[tuple] = []

    def answers() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.cumsum(unpacked(r[5], r[4]), dtype=np.uint64) for r in group])
        counts = np.concatenate([unpacked(r[6], r[4]) for r in group]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        totals = np.empty(len(keys), np.int64)
        totals[order] = sums[np.cumsum(new) - 1]
        bucket, gram = group[0][:2]
        rows, at = [], 0
        for _, _, part, chunk, n, _, _ in group:
            rows.append((part, chunk, gram, bucket, n, _checksum(keys[at : at + n]), packed(totals[at : at + n])))
            at += n
        if gram == 0:
            rows.append((-1, bucket, 0, bucket, int((sums > 0).sum()), int(sums.sum()), b""))
        group.clear()
        for at in range(0, len(rows), 256):
            yield _batch(rows[at : at + 256], TOTALS)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "gram", "part", "chunk", "n", "grams", "counts"))):
            if group and row[:2] != group[0][:2]:
                yield from answers()
            group.append(row)
    if group:
        yield from answers()


class Totals:
    """The totals of one input partition's n-grams, as they came back."""

    def __init__(self, path: str, part: int):
        files, where = file_system(f"{path}/part={part}")
        table = pads.dataset(where, filesystem=files, format="parquet").to_table(columns=["chunk", "gram", "bucket", "n", "check", "totals"])
        table = table.sort_by([("chunk", "ascending"), ("gram", "ascending"), ("bucket", "ascending")])
        self.rows: dict[tuple[int, int], list[tuple]] = {}
        for r in zip(*(table.column(c).to_pylist() for c in table.column_names)):
            self.rows.setdefault(r[:2], []).append(r[2:])

    def of(self, number: int, chunk: Chunk, n_buckets: int, training_tokens: int, training_texts: int) -> Tokens:
        counts = []
        for k in range(3):
            keys, place, buckets, firsts = chunk.in_buckets(k, n_buckets)
            got, ends = self.rows.get((number, k), []), [*firsts[1:].tolist(), len(keys)]
            totals = np.concatenate([unpacked(r[3], r[1]) for r in got]) if got else np.zeros(0, np.uint64)
            same = [r[0] for r in got] == buckets.tolist() and len(totals) == len(keys)
            if not same or any(_checksum(keys[low:high]) != r[2] for r, low, high in zip(got, firsts.tolist(), ends)):
                raise ValueError(f"chunk {number} does not have the n-grams that were counted: its rows have changed")
            counts.append(totals[place].astype(np.int64))
        return Tokens(chunk.word, chunk.first, ~chunk.held_out, *counts, training_tokens, training_texts)


# ---- learning and scoring ------------------------------------------------------------------


SUMS = "which int, block int, part int, cells binary"


def _learn(path: str, bits: int, n_buckets: int, n: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mixers, totals = (decision_mixer(), spelling_mixer()), None
        for number, chunk in _chunks(batches, bits):
            totals = totals or Totals(path, part)
            reading = Reading(totals.of(number, chunk, n_buckets, n, texts))
            own = chunk.training()
            count_decisions(mixers[0], reading, own)
            count_spelling(mixers[1], [chunk.words[i] for i in chunk.number[(reading.found == 0) & own].tolist()])
        for which, m in enumerate(mixers):
            cells = m.cells.ravel().astype(np.float64)
            rows = [(which, at // BLOCK, part, cells[at : at + BLOCK].tobytes()) for at in range(0, len(cells), BLOCK) if cells[at : at + BLOCK].any()]
            for at in range(0, len(rows), 8):
                yield _batch(rows[at : at + 8], SUMS)

    return run


def _weigh(path: str, model: str, bits: int, n_buckets: int, n: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, totals, sums = TaskContext.get().partitionId(), None, None
        for number, chunk in _chunks(batches, bits):
            totals = totals or Totals(path, part)
            if chunk.held_out.all():
                continue
            mixers = _counted(model)
            sums = sums or [Moments(m) for m in mixers]
            reading = Reading(some_texts(totals.of(number, chunk, n_buckets, n, texts), ~chunk.held_out))
            weigh_decisions(mixers[0], reading, sums[0])
            new = chunk.number[chunk.training()][reading.found == 0]
            weigh_spelling(mixers[1], [chunk.words[i] for i in new.tolist()], sums[1])
        if sums:
            flat = [(which, m.sums.ravel()) for which, m in enumerate(sums)]
            yield _batch([(which, at // FEW, part, x[at : at + FEW].tobytes()) for which, x in flat for at in range(0, len(x), FEW)], SUMS)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of equal (which, block) that follow one another, in the order of their parts."""
    last: tuple[int, int] | None = None
    total = np.zeros(0)
    for batch in batches:
        for which, block, cells in zip(batch.column("which").to_pylist(), batch.column("block").to_pylist(), batch.column("cells")):
            got = np.frombuffer(cells.as_buffer(), np.float64)
            if (which, block) != last:
                if last is not None:
                    yield _batch([(*last, 0, total.tobytes())], SUMS)
                last, total = (which, block), got.copy()
            else:
                total += got
    if last is not None:
        yield _batch([(*last, 0, total.tobytes())], SUMS)


@lru_cache(maxsize=1)
def _counted(path: str) -> tuple[Mixer, Mixer]:
    """The mixers with the counts of a model of the shared folder, a few megabytes."""
    mixers = decision_mixer(), spelling_mixer()
    files, where = file_system(path)
    for b in pads.dataset(where, filesystem=files, format="parquet").scanner(columns=["which", "block", "cells"], batch_size=256).to_reader():
        for which, block, cells in zip(b.column("which").to_pylist(), b.column("block").to_pylist(), b.column("cells")):
            got, m = np.frombuffer(cells.as_buffer(), np.float64), mixers[which]
            flat = m.cells.reshape(-1)[block * BLOCK : (block + 1) * BLOCK]
            flat[:] = np.minimum(got, np.iinfo(np.int32).max)
    return mixers


@lru_cache(maxsize=1)
def _model(path: str, weights: tuple[bytes, bytes]) -> tuple[Mixer, Mixer]:
    """The mixers as they score."""
    mixers = _counted(path)
    for m, w in zip(mixers, weights):
        m.weights = np.frombuffer(w, np.float32).reshape(m.weights.shape)
        m.freeze()
    return mixers


def _score(path: str, model: str, weights: tuple[bytes, bytes], bits: int, n_buckets: int, n: int, distinct: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, totals = TaskContext.get().partitionId(), None
        for number, chunk in _chunks(batches, bits):
            totals = totals or Totals(path, part)
            t = totals.of(number, chunk, n_buckets, n, texts)
            reading = Reading(t)
            decisions, spelling = _model(model, weights)
            logs = decision_scores(decisions, reading)
            new = np.flatnonzero(reading.found == 0)
            words = chunk.number[new]
            distinct_words, place = np.unique(words, return_inverse=True)
            logs[new] += spelling_scores(spelling, [chunk.words[i] for i in distinct_words.tolist()])[place]
            base = np.log10((t.c0 + 1) / (n + distinct + 1))
            sums = [np.add.reduceat(x, chunk.first) for x in (t.c0 > 0, base, logs)]
            yield pa.record_batch(
                [
                    pa.array(chunk.doc_id, pa.int64()), pa.array(chunk.held_out), pa.array(chunk.sizes), pa.array(sums[0].astype(np.int64)),
                    pa.array(chunk.word_bytes()), pa.array(sums[1]), pa.array(sums[2]),
                ],
                names=[f.split()[0] for f in SCORES.split(", ")],
            )

    return run


def _weights(sums: dict[tuple[int, int], bytes]) -> tuple[bytes, bytes]:
    """The weights after the Newton step; without sums, as they start."""
    out = []
    for which, m in enumerate((decision_mixer(), spelling_mixer())):
        moments = Moments(m)
        if own := b"".join(x for _, x in sorted((block, x) for (w, block), x in sums.items() if w == which)):
            moments.sums = np.frombuffer(own, np.float64).reshape(moments.sums.shape)
        out.append(moments.step(m.weights).tobytes())
    return out[0], out[1]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    size = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("held_out")).alias("training"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // BUCKET_BYTES))
    bits = min(64, SPARE_BITS + (size.bytes + size.n).bit_length())
    grams = rows.mapInArrow(_count(bits, n_buckets), GRAMS)
    answers = grams.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "gram").mapInArrow(_total, TOTALS)
    path = fresh_path(spark, "ngrams")
    answers.repartition(F.col("part")).write.partitionBy("part").parquet(path)
    counted = spark.read.schema(TOTALS).parquet(path).where("part = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.sum("check"), F.lit(0)).alias("n")).first()
    learned = fresh_path(spark, "learned")
    rows.mapInArrow(_learn(path, bits, n_buckets, counted.n, size.training), SUMS).write.partitionBy("which").parquet(learned)
    dealt = spark.read.schema(SUMS).parquet(learned).repartition(F.col("which"), F.col("block")).sortWithinPartitions("which", "block", "part")
    model = fresh_path(spark, "model")
    dealt.mapInArrow(_add, SUMS).write.parquet(model)
    weighed = rows.mapInArrow(_weigh(path, model, bits, n_buckets, counted.n, size.training), SUMS)
    sums = weighed.repartition(F.col("which"), F.col("block")).sortWithinPartitions("which", "block", "part").mapInArrow(_add, SUMS)
    weights = _weights({(r.which, r.block): bytes(r.cells) for r in sums.collect()})  # a few thousand numbers
    scored = materialise(rows.mapInArrow(_score(path, model, weights, bits, n_buckets, counted.n, counted.v, size.training), SCORES), "scores")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counted.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
