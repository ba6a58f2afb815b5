"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Files, below one folder of a file system that all executors share:

``shard-00000.ids``  16-byte header (magic, bytes per id), then the raw little-endian ids
    of all documents of the shard, one after the other, in ascending doc_id order (null
    ids first).  Two bytes per id if the vocabulary allows it, else four.
``index-00000.mph``  the keys that hash to this index part: bit arrays of a minimal
    perfect hash function by levels, and per slot a stored fingerprint of the key, shard,
    offset and length.  A look-up takes a few bit tests, one fingerprint comparison and
    one ranged read; a key that was never stored is refused by its fingerprint, up to a
    chance of 2^-32.
``manifest.json``  widths, numbers of parts, and the ids before each shard.

Keys are (doc_id, occurrence): rows that repeat a doc_id count from 0 within a shard, plus
shard << 40 in the rare case that one doc_id fills more than one shard.

Every file is written under another name and then moved, so a task that is run again, or
twice, leaves one whole file.  Shards are ranges of doc_id, one per input split but MAX_SHARDS at most, between
quantiles of a sample of BOUND_SAMPLE ids a shard, so what the driver gets and every task is sent is bounded
(2 million sampled ids, 65,535 bounds); an id so frequent that it spans several quantiles is
dealt over all the shards between them, which keeps the order and bounds a shard.

Defined cases: a null text is empty and stores its end id alone; null doc_ids are keys
too; an empty table gives no shards and no rows; further columns are left out.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import default_path, encoder, slices
from .store import fresh_path, materialise, read_columns

END_ID = 2
MAGIC_SHARD, MAGIC_INDEX = b"TLTOKEN1", b"TLINDEX1"
HEADER = 16
GAMMA = 2.0  # bits per key and level of the hash function
KEYS_PER_INDEX = 1 << 17
MAX_SHARDS = 1 << 16  # beyond, shards grow: 1.5 GB of text each at 100 TB, written as a stream
BOUND_SAMPLE = 30  # sampled ids a shard, for the bounds of shards
NULL_ID = -(1 << 63)  # where null ids sort
SLICE, SLICE_BYTES = 2048, 64 << 20  # documents, and bytes of their texts, encoded at once: more repeats of a piece per look-up


# ---- files -------------------------------------------------------------------------------


def file_system(folder: str):
    """(file system, path) of a folder URI or absolute path."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_whole(folder: str, name: str, parts: Iterator[bytes]) -> int:
    """Writes a file under another name, then moves it into place; returns its bytes."""
    files, path = file_system(folder)
    other, n = f"{path}/.{name}-{uuid.uuid4().hex}", 0
    with files.open_output_stream(other) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    files.move(other, f"{path}/{name}")
    return n


def read_whole(folder: str, name: str) -> bytes:
    files, path = file_system(folder)
    with files.open_input_file(f"{path}/{name}") as f:
        return f.read()


# ---- minimal perfect hashing ---------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the splitmix64 finaliser; fixed values)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, is_null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys (int64, bool, int64)."""
    return _mix(_mix(doc_id.view(np.uint64)) ^ ((occurrence.astype(np.uint64) << np.uint64(1)) | is_null.astype(np.uint64)))


class PerfectHash:
    """Maps n distinct 64-bit hashes to 0 .. n-1: at each level, keys alone at their bit keep it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        before = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.ranks = [b + np.cumsum(c) - c for b, c in zip(before, counts)]
        self.size = int(before[-1])

    @staticmethod
    def _place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (_mix(hashes ^ np.uint64(level * 0x5851F42D4C957F2D & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = hashes, []
        while len(left):
            words = -(-int(GAMMA * len(left)) // 64) or 1
            at = cls._place(left, len(levels), 64 * words)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level has its bit."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._place(hashes[left], k, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def index_bytes(hashes: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """An index part: hash levels, then fingerprint, shard, offset and length by slot."""
    mph = PerfectHash.build(hashes)
    slot = mph.slots(hashes)
    columns = []
    for values, kind in ((_fingerprint(hashes), "<u4"), (shard, "<u4"), (offset, "<u8"), (length, "<u8")):
        column = np.zeros(len(hashes), kind)
        column[slot] = values
        columns.append(column.tobytes())
    head = np.array([len(hashes), len(mph.levels), *map(len, mph.levels)], "<u8").tobytes()
    return b"".join([MAGIC_INDEX, head, *(x.astype("<u8").tobytes() for x in mph.levels), *columns])


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class IndexPart:
    """One index file; ``find`` gives (found, shard, offset, length) of key hashes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC_INDEX:
            raise ValueError("not an index file")
        n, k = map(int, np.frombuffer(data, "<u8", 2, 8))
        sizes, at, levels = np.frombuffer(data, "<u8", k, 24), 24 + 8 * k, []
        for size in map(int, sizes):
            levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        self.mph = PerfectHash(levels)
        self.fingerprint = np.frombuffer(data, "<u4", n, at)
        self.shard = np.frombuffer(data, "<u4", n, at + 4 * n)
        self.offset = np.frombuffer(data, "<u8", n, at + 8 * n)
        self.length = np.frombuffer(data, "<u8", n, at + 16 * n)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        slot = self.mph.slots(hashes)
        if not len(self.fingerprint):
            none = np.zeros(len(hashes), np.int64)
            return none.astype(bool), none, none, none
        at = np.maximum(slot, 0)
        found = (slot >= 0) & (self.fingerprint[at] == _fingerprint(hashes))
        return found, *(x[at].astype(np.int64) for x in (self.shard, self.offset, self.length))


@lru_cache(maxsize=8)
def _index_part(folder: str, part: int) -> IndexPart:
    return IndexPart(read_whole(folder, f"index-{part:05d}.mph"))


class TokenReader:
    """Keyed access to a store: ``reader.ids(doc_id)``."""

    def __init__(self, folder: str):
        self.folder = folder
        self.manifest = json.loads(read_whole(folder, "manifest.json"))

    def ids(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document with its end id; None if the key was never stored."""
        if not self.manifest["n_index"]:
            return None
        h = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]))
        found, shard, offset, length = _index_part(self.folder, int(h[0] % np.uint64(self.manifest["n_index"]))).find(h)
        if not found[0]:
            return None
        width = self.manifest["width"]
        files, path = file_system(self.folder)
        with files.open_input_file(f"{path}/shard-{shard[0]:05d}.ids") as f:
            data = f.read_at(int(length[0]) * width, HEADER + int(offset[0]) * width)
        return np.frombuffer(data, f"<u{width}").astype(np.uint32)


# ---- writing and reading with Spark ----------------------------------------------------------


def _encode(path: str, end_id: int, width: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(path), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_BYTES):
                ids, lengths = coder.encode(part.column("text"))
                n, total = len(lengths), int(lengths.sum())
                out = np.full(total + n, end_id, f"<u{width}")
                out[np.arange(total) + np.repeat(np.arange(n), lengths)] = ids
                ends = np.concatenate([[0], np.cumsum((lengths + 1) * width)])
                payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
                key = part.column("sort_id").to_numpy()
                low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
                shard = low + (row + np.arange(n)) % (high - low + 1)
                row += n
                yield pa.record_batch(
                    [pa.array(shard.astype(np.int32)), part.column("doc_id"), part.column("sort_id"), pa.array((high > low)), payload.cast(pa.binary())],
                    names=["shard", "doc_id", "sort_id", "spread", "payload"],
                )

    return run


def _write_shard(folder: str, width: int, n_index: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        state = {"shard": None, "offset": 0, "id": None, "seen": 0}

        def parts() -> Iterator[bytes]:
            yield MAGIC_SHARD + np.array([width, 0], "<u4").tobytes()
            batch = first
            while batch is not None:
                payload = batch.column("payload")
                lengths = pc.binary_length(payload).to_numpy().astype(np.int64) // width
                ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
                null = np.asarray(batch.column("doc_id").is_null())
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
                new[0] = state["id"] != (ids[0], null[0])
                start = np.flatnonzero(new)
                run_start = np.repeat(np.concatenate([[0], start])[: len(start) + 1], np.diff(np.concatenate([[0], start, [len(ids)]])))
                seen = np.arange(len(ids)) - run_start
                seen[: start[0] if len(start) else len(ids)] += state["seen"]
                occurrence = seen + np.where(np.asarray(batch.column("spread")), state["shard"] << 40, 0)
                offsets = state["offset"] + np.cumsum(lengths) - lengths
                part = key_hash(np.where(null, 0, ids), null, occurrence) % np.uint64(n_index)
                rows.append(
                    pa.record_batch(
                        [pa.array(np.full(len(ids), state["shard"], np.int32)), batch.column("doc_id"), pa.array(occurrence), pa.array(offsets), pa.array(lengths), pa.array(part.astype(np.int32))],
                        names=["shard", "doc_id", "occurrence", "offset", "length", "part"],
                    )
                )
                state.update(offset=int(offsets[-1] + lengths[-1]), id=(ids[-1], null[-1]), seen=int(seen[-1]) + 1)
                buffers = payload.buffers()
                ends = np.frombuffer(buffers[1], np.int32, len(ids) + 1, 4 * payload.offset)
                yield memoryview(buffers[2])[ends[0] : ends[-1]]
                batch = next((b for b in batches if b.num_rows), None)

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            state["shard"] = first.column("shard")[0].as_py()
            write_whole(folder, f"shard-{state['shard']:05d}.ids", parts())
            yield from rows

    return run


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            null = np.asarray(t["doc_id"].is_null())
            h = key_hash(t["doc_id"].fill_null(0).to_numpy(), null, t["occurrence"].to_numpy())
            part = t["part"][0].as_py()
            n = write_whole(folder, f"index-{part:05d}.mph", iter([index_bytes(h, *(t[c].to_numpy() for c in ("shard", "offset", "length")))]))
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([t.num_rows], pa.int64()), pa.array([n], pa.int64())], names=["part", "keys", "bytes"])

    return run


def shard_bounds(rows: DataFrame, n_docs: int, n_shards: int) -> list[int]:
    """n_shards - 1 ids that cut the rows into about equal parts, from a sample of a few ids a shard."""
    if n_shards < 2 or not n_docs:
        return []
    share = min(1.0, BOUND_SAMPLE * n_shards / n_docs)
    ids = np.sort(rows.select("sort_id").sample(share, seed=1).toArrow().column(0).to_numpy())
    return ids[np.arange(1, n_shards) * len(ids) // n_shards].tolist() if len(ids) else []


def write_token_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store and returns its keys: (doc_id, occurrence, part), one row per document."""
    spark = docs.sparkSession
    path = path or default_path("word_bpe_49k.json")
    width = 2 if max(encoder(path).vocab_size - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("sort_id"))
    n_shards = min(MAX_SHARDS, max(1, rows.rdd.getNumPartitions()))
    n_docs = rows.count()
    bounds = shard_bounds(rows, n_docs, n_shards)
    n_index = -(-n_docs // KEYS_PER_INDEX)
    files, where = file_system(folder)
    files.create_dir(where, recursive=True)
    manifest = {"width": width, "end_id": end_id, "n_index": n_index, "n_shards": n_shards, "starts": []}
    coded = rows.mapInArrow(_encode(path, end_id, width, bounds), "shard int, doc_id long, sort_id long, spread boolean, payload binary")
    dealt = coded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("sort_id", "doc_id", "payload")
    directory = dealt.mapInArrow(_write_shard(folder, width, max(1, n_index)), "shard int, doc_id long, occurrence long, offset long, length long, part int")
    directory = materialise(directory, "directory")
    totals = dict(directory.groupBy("shard").agg(F.sum("length")).collect())  # one row a shard
    starts = np.concatenate([[0], np.cumsum([totals.get(s, 0) for s in range(n_shards)])])
    manifest["starts"] = [int(x) for x in starts[:-1]]
    if n_index:
        directory.repartitionById(n_index, F.col("part")).mapInArrow(_write_index(folder), "part int, keys long, bytes long").write.format("noop").mode("overwrite").save()
    write_whole(folder, "manifest.json", iter([json.dumps(manifest).encode()]))
    return directory.select("doc_id", "occurrence", "part")


def _look_up(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part").to_numpy()
            h = key_hash(b.column("doc_id").fill_null(0).to_numpy(), np.asarray(b.column("doc_id").is_null()), b.column("occurrence").to_numpy())
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                found, shard, offset, length = _index_part(folder, int(p)).find(h[at])
                if not found.all():
                    raise ValueError(f"index part {p} lacks {int((~found).sum())} keys")
                yield pa.record_batch([b.column("doc_id").take(pa.array(at)), pa.array(shard.astype(np.int32)), pa.array(offset), pa.array(length)], names=["doc_id", "shard", "offset", "length"])

    return run


def _read_shard(folder: str, width: int, starts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        name, f = None, None
        try:
            for b in batches:
                out = []
                for doc_id, shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("doc_id", "shard", "offset", "length"))):
                    if shard != name:
                        if f is not None:
                            f.close()
                        name, f = shard, files.open_input_file(f"{path}/shard-{shard:05d}.ids")
                        if f.read_at(8, 0) != MAGIC_SHARD:
                            raise ValueError(f"shard {shard} is not a shard file")
                    ids = np.frombuffer(f.read_at(length * width, HEADER + offset * width), f"<u{width}")
                    out.append((doc_id, starts[shard] + offset, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        finally:
            if f is not None:
                f.close()

    return run


def read_token_store(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the keys, each found by the index and read from its shard."""
    m = TokenReader(folder).manifest
    if not m["n_index"]:
        return keys.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = keys.repartition(F.col("part")).mapInArrow(_look_up(folder), "doc_id long, shard int, offset long, length long")
    dealt = found.repartitionById(m["n_shards"], F.col("shard")).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(_read_shard(folder, m["width"], m["starts"]), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    keys = write_token_store(read_columns(spark, sf_dir, "documents", "doc_id", "text"), folder)
    return read_token_store(keys, folder)
