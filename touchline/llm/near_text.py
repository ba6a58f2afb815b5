"""Near-duplicate texts: SimHash components, then 5-word shingles with a Jaccard similarity of SIMILARITY or more.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text of fewer than
SHINGLE words is one shingle.  Candidates share a key:

* the component of their SimHash fingerprints, found as simhash does: all texts whose fingerprints differ in
  2 bits or fewer, none of which is missed;
* a min-hash band.  At such similarities fingerprints of 64 bits differ in up to some 11 bits, for which no
  pigeonhole keys select, so BANDS keys of ROWS min-hashes each find those beyond 2 bits; two texts of
  similarity s miss all of them with probability (1 - s**ROWS)**BANDS (0.8: 0.0007).

Candidates are confirmed by their whole shingle sets.

Equal sets are one row first.  Of the pairs that share a key no more are formed than needed:

1. each set is held against one other of each of its keys, the key's leader, which is drawn anew for
   each key, so large groups are mostly joined through their leaders;
2. a key of three or more sets that are not in one component by then is compared whole.  Its sets
   that are not of its largest component meet all others, in groups of bounded size: parts
   of these sets by parts of all sets of the key, each pair of parts a group of its own.
   Within a group, overlaps are counted by one look-up of each hash.  Only a forest of the links
   between components leaves a group.

So every pair of sets that share a key is linked, or found below SIMILARITY, or joined already
by other links; none is left out for the size of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import component_labels, forest
from .encoding import ragged
from .simhash import HOT_SHARE, fingerprint, fingerprint_links, near_duplicates, one_of_each
from .store import materialise

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 24
SALTS = 16
PART_BYTES = 8 << 20  # of the shingle sets of a key that one group takes
_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, (1, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = _random.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    own = {w: xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _POWERS[k]
    total = (total ^ (total >> np.uint64(32))) * _POWERS[0]
    return np.unique((total >> np.uint64(32)).astype(np.uint32))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024, None].astype(np.uint64) + np.uint64(1)) * _FACTORS
        low = np.minimum(low, (mixed >> np.uint64(32)).astype(np.uint32).min(0))
    return np.array([xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            sets = [shingle_set(t) for t in texts]
            ids, marks = (np.array(x, np.uint64).view(np.int64) for x in ([set_id(s) for s in sets], [fingerprint(t or b"") for t in texts]))
            keys = [band_keys(s).view(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.record_batch([part.column("doc_id"), pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.array(marks)], names=["doc_id", "fp", "keys", "mark"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: id of the shingle set, keys, mark: SimHash fingerprint) of every row; a map, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_signatures, "doc_id long, fp long, keys array<long>, mark long")


def _sets(needed: np.ndarray):
    """Whole sets of the texts whose ids may be in the filter ``needed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t) for t in batch.column("text").slice(at, 256).cast(pa.large_binary()).to_pylist()]
                ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                own = bloom.holds(needed, ids)
                yield pa.record_batch([pa.array(ids[own]), pa.array([s.tobytes() for s, k in zip(sets, own) if k], pa.binary())], names=["fp", "hashes"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
        near = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= SIMILARITY for x, y in zip(a, b)]
        yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))


def overlaps(probe: np.ndarray, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``probe`` in each of n sets, given as all their hashes in order, each with its owner."""
    low, high = np.searchsorted(hashes, probe, "left"), np.searchsorted(hashes, probe, "right")
    return np.bincount(owner[ragged(low, high - low)], minlength=n)


def label_links(probes: list[bytes], probe_label: np.ndarray, others: list[bytes], other_label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): a forest of links between labels, by all pairs of a probe and another set of similarity SIMILARITY or more."""
    sets = [np.frombuffer(x, np.uint32) for x in others]
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    us, vs = [], []
    for own, label in zip(probes, probe_label.tolist()):
        probe = np.frombuffer(own, np.uint32)
        both = overlaps(probe, hashes, owner, len(sets))
        near = np.unique(other_label[(both > 0) & (both >= SIMILARITY * (len(probe) + sizes - both)) & (other_label != label)])
        us.append(np.full(len(near), label, np.int64))
        vs.append(near)
    u, v = np.concatenate(us), np.concatenate(vs)
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = nodes[forest(place[: len(u)], place[len(u) :], len(nodes))] if len(nodes) else nodes
    child = np.flatnonzero(root != nodes)
    return nodes[child], root[child]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, probe, label, hashes) sorted by group: probes of a group meet its other sets."""
    group: tuple | None = None
    sides: tuple[list, list] = ([], [])

    def links() -> pa.RecordBatch:
        (probes, a), (others, b) = (([x[1] for x in side], np.array([x[0] for x in side], np.int64)) for side in sides)
        u, v = label_links(probes, a, others, b) if probes and others else (a[:0], a[:0])
        for side in sides:
            side.clear()
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        for key, i, j, probe, label, hashes in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "probe", "label", "hashes"))):
            if (key, i, j) != group:
                if group is not None:
                    yield links()
                group = (key, i, j)
            sides[0 if probe else 1].append((label, hashes))
    if group is not None:
        yield links()


def _with_leader(keyed: DataFrame, leaders: DataFrame, most: int) -> DataFrame:
    """``keyed`` rows whose key has a leader, with leader and n.

    Keys of more than 1/HOT_SHARE of at most ``most`` rows, so fewer than HOT_SHARE of them, are sent to every
    task; their rows stay where they are, and no task gets a hot key's rows.
    """
    leaders = materialise(leaders, "leaders")
    hot = leaders.where(F.col("n") * HOT_SHARE > most).select("key", F.col("leader").alias("hot_leader"), F.col("n").alias("hot_n"))
    marked = keyed.join(F.broadcast(hot), "key", "left")
    away = F.when(F.col("hot_n").isNotNull(), F.xxhash64("fp", "key")).otherwise(F.col("key"))
    found = marked.withColumn("meet", away).join(leaders.withColumnRenamed("key", "meet"), "meet", "left")
    found = found.select("fp", "key", F.coalesce("hot_leader", "leader").alias("leader"), F.coalesce("hot_n", "n").alias("n"))
    return found.where("leader is not null")


def simhash_keys(rows: DataFrame) -> DataFrame:
    """(fp, key) of every set: the SimHash components of its texts; texts of one set may have several fingerprints."""
    marks = materialise(rows.select("fp", "mark").distinct(), "marks")
    label = component_labels(fingerprint_links(marks.select(F.col("mark").alias("fp")).distinct()))
    linked = marks.join(label.withColumnRenamed("node", "mark"), "mark", "left")
    return linked.select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("label", "mark")).alias("key")).distinct()


def set_links(rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(u, v): links between different shingle sets of ``docs``, or between components of such links; rows: their signatures.

    Whole sets are only kept of the texts that share a key with another one.
    """
    banded = rows.groupBy("fp").agg(F.first("keys").alias("keys")).select("fp", F.explode("keys").alias("key"))
    keyed = banded.union(materialise(simhash_keys(rows), "simhash"))
    drawn = F.struct(F.xxhash64("key", "fp").alias("h"), F.col("fp").alias("x"))
    leaders = keyed.groupBy("key").agg(F.min(drawn)["x"].alias("leader"), F.count("*").alias("n")).where("n > 1")
    keyed = materialise(_with_leader(keyed, leaders, rows.count() * (BANDS + 1)), "keyed")
    # few texts are needed: a filter of bounded size spares nearly all others the shuffle at any input size, the join is exact
    needed = materialise(keyed.select("fp").distinct(), "needed")
    sieve = bloom.build(needed, needed.count())
    sets = docs.select(F.col(text_col).alias("text")).mapInArrow(_sets(sieve), "fp long, hashes binary").join(needed, "fp", "left_semi")
    sets = materialise(sets.groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")
    pairs = keyed.where("fp <> leader").select(F.least("fp", "leader").alias("u"), F.greatest("fp", "leader").alias("v")).distinct()
    a, b = (sets.select(F.col("fp").alias(end), F.col("hashes").alias(x)) for end, x in (("u", "a"), ("v", "b")))
    led = materialise(pairs.join(a, "u").join(b, "v").mapInArrow(_confirm, "u long, v long"), "led")
    label = component_labels(led)
    # keys whose sets are not all in one component yet; with two sets, the leader has met the other
    sizes = sets.select("fp", F.octet_length("hashes").cast("long").alias("size"))
    of = keyed.where("n > 2").select("fp", "key").join(label.withColumnRenamed("node", "fp"), "fp", "left").join(sizes, "fp")
    of = materialise(of.select("key", "fp", "size", F.coalesce("label", "fp").alias("label")), "labelled")
    by_label = of.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    most = F.max(F.struct("n", "label"))
    open_keys = by_label.groupBy("key").agg(most["label"].alias("major"), F.sum("bytes").alias("all"), (F.sum("bytes") - F.max(F.struct("n", "label", "bytes"))["bytes"]).alias("minor"), F.count("*").alias("labels"))
    open_keys = open_keys.where("labels > 1").select("key", "major", F.expr(f"minor div {PART_BYTES} + 1").alias("p"), F.expr(f"all div {PART_BYTES} + 1").alias("q"))
    # a key's rows are dealt over SALTS tasks; each open key is one short row
    salted = open_keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = of.withColumn("h", F.xxhash64("fp")).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    others = dealt.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("i"), F.pmod("h", "q").alias("j"), F.lit(False).alias("probe"), "label", "fp")
    probes = dealt.where("label <> major").select("key", F.pmod("h", "p").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"), F.lit(True).alias("probe"), "label", "fp")
    groups = others.union(probes).join(sets.select("fp", "hashes"), "fp").drop("fp")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = groups.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "u long, v long")
    return led.union(materialise(rest, "rest"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; fp: id of its shingle set."""
    rows = materialise(signatures(docs, id_col, text_col), "signatures")
    return near_duplicates(docs, id_col, text_col, rows.select("doc_id", "fp"), lambda _: set_links(rows, docs, text_col))


def one_near_text(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts: the one with its smallest doc_id."""
    return one_of_each(docs, near_texts, lambda text: set_id(shingle_set(text)))
