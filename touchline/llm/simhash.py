"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: texts are lower-cased (A-Z), cut into words at ASCII white space and hashed
as 3-word shingles, repeats included; bit i of the fingerprint is 1 if it is set in over
half of the hashes.  Fingerprints that differ in RADIUS bits or fewer are linked, and the
connected components of links are the duplicate groups.

Search: equal fingerprints are one row first, so copies never meet in pairs.  A
fingerprint is cut into BANDS parts; two that differ in 2 bits agree in at least
BANDS - 2 of them, so each choice of BANDS - 2 parts is a key and candidates share a key.
All fingerprints of one key are compared bit-sliced: bit planes are stored vertically (one
machine word holds bit i of 64 fingerprints), a query is held against whole words by
exclusive-or, carry-save counters (ones, twos, over) add up the differing bits of 64
lanes at once, and a block of lanes is abandoned once all of them exceed the radius.
A key with more than BLOCK fingerprints is dealt by hash to blocks, and each pair of its
blocks is a group of its own, so that no task gets an unbounded key and none is capped.

Only a forest of the links within a group leaves a group (at most one row per member);
it has the same components as all links.

Defined cases: null and wordless texts have fingerprint nought and are linked like any
other; null doc_ids keep their rows and never name a component that has another id (if
all are null, the component is null); repeated rows are copies; an empty table gives an
empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import component_labels, forest
from .store import materialise, read_columns, unused

SEED = 42
SHINGLE = 3
RADIUS = 2
BANDS = 4  # six keys of 32 bits
BLOCK = 2048  # fingerprints of one key that are compared in one group
WORDS = 8  # machine words (of 64 lanes) that are abandoned together
HOT_SHARE = 1000  # a fingerprint of over 1/HOT_SHARE of all rows is hot, so fewer than HOT_SHARE are


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    shingles = [b" ".join(words)] if n < 1 else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, n))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a map, no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: row i holds bit i of all values, 64 of them in a machine word."""
    lanes = -(-len(values) // 64) * 64
    bits = np.unpackbits(np.pad(values, (0, lanes - len(values))).view(np.uint8), bitorder="little").reshape(lanes, 64)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All (query index, value index) that differ in at most ``radius`` (0 to 2) bits, bit-sliced."""
    if not 0 <= radius <= 2:
        raise ValueError("the counters hold radius 0, 1 or 2")
    flat = planes(values)
    n_words = flat.shape[1]
    valid = np.full(n_words, ~np.uint64(0))
    if len(values) % 64:
        valid[-1] = np.uint64((1 << (len(values) % 64)) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, n_words, WORDS):
        part = flat[:, at : at + WORDS]
        live = np.arange(len(queries))
        shape = (len(queries), part.shape[1])
        ones, twos, over = (np.zeros(shape, np.uint64) for _ in range(3))
        for bit in range(64):
            wanted = (~np.uint64(0)) * ((queries[live] >> np.uint64(bit)) & np.uint64(1))
            differ = part[bit][None, :] ^ wanted[:, None]
            carry = ones & differ  # carry-save: ones + 2 twos, then over for good
            ones ^= differ
            if radius < 2:
                over |= carry if radius == 1 else differ
            else:
                over |= twos & carry
                twos ^= carry
                over |= ones & twos
            if bit % 8 == 7:  # abandon the block for queries none of whose lanes can match
                going = (over != ~np.uint64(0)).any(1)
                if not going.all():
                    live, ones, twos, over = live[going], ones[going], twos[going], over[going]
                    if not len(live):
                        break
        if len(live):
            hit = ~over & valid[at : at + WORDS][None, :]
            q, w = np.nonzero(hit)
            lanes = np.unpackbits(hit[q, w].view(np.uint8), bitorder="little").reshape(-1, 64)
            k, lane = np.nonzero(lanes)
            found.append((live[q[k]], (at + w[k]) * 64 + lane))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def group_links(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links among sorted runs of equal ``groups``; values are distinct within a run.

    Runs of few members are put in one vertical block and told apart by their number; a
    longer run is a block of its own.
    """
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    run = np.repeat(np.arange(len(starts)), sizes)
    us, vs = [], []
    small = np.flatnonzero((sizes > 1) & (sizes <= 32))
    member = np.flatnonzero(np.isin(run, small))
    at = 0
    while at < len(member):  # blocks of whole small runs
        end = min(len(member), at + 512)
        if end < len(member):
            while end > at and run[member[end - 1]] == run[member[end]]:
                end -= 1
        rows = member[at:end]
        q, k = within(values[rows], values[rows])
        ok = (run[rows[q]] == run[rows[k]]) & (q < k)
        us.append(rows[q[ok]])
        vs.append(rows[k[ok]])
        at = end
    for r in np.flatnonzero(sizes > 32):
        rows = np.arange(starts[r], starts[r] + sizes[r])
        for first in range(0, len(rows), 256):
            q, k = within(values[rows[first : first + 256]], values[rows])
            ok = q + first < k
            us.append(rows[q[ok] + first])
            vs.append(rows[k[ok]])
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = forest(np.concatenate(us), np.concatenate(vs), len(values)) if len(us) else np.arange(len(values))
    child = np.flatnonzero(root != np.arange(len(values)))
    return values[child], values[root[child]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g1, g2, fp) sorted by group; whole groups are compared, a part of one waits for its rest."""
    rest: tuple[np.ndarray, ...] | None = None

    def links(values: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
        u, v = group_links(values, np.cumsum(new))
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        got = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "g1", "g2"))
        if not len(got[0]):
            continue
        if rest is not None:
            got = tuple(np.concatenate(x) for x in zip(rest, got))
        last = np.flatnonzero((got[1] != got[1][-1]) | (got[2] != got[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = tuple(x[cut:] for x in got)
        if cut:
            yield links(np.ascontiguousarray(got[0][:cut]).view(np.uint64), got[1][:cut], got[2][:cut])
    if rest is not None:
        yield links(np.ascontiguousarray(rest[0]).view(np.uint64), rest[1], rest[2])


def _band_keys(fp: str = "fp") -> list[F.Column]:
    """A key per choice of BANDS - RADIUS parts: the fingerprint with the other parts cleared."""
    width = 64 // BANDS
    out = []
    for kept in combinations(range(BANDS), BANDS - RADIUS):
        mask = sum(((1 << width) - 1) << (width * b) for b in kept)
        out.append(F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return out


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links of a forest of distinct fingerprints (column fp) within RADIUS."""
    keys = F.posexplode(F.array(*_band_keys()))
    rows = distinct.select("fp", keys.alias("table", "masked")).select("fp", F.xxhash64("table", "masked").alias("key"))
    # two keys that collide only share a group: distances decide
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks"))
    dealt = rows.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.least(o, F.col("own")).cast("long") * (1 << 31) + F.greatest(o, F.col("own")))
    grouped = dealt.select(F.col("key").alias("g1"), F.explode(pairs).alias("g2"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: DataFrame | None = None, links: Callable[[DataFrame], DataFrame] = fingerprint_links) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: smallest doc_id reachable by links.

    ``rows``, stored (doc_id, fp) of all docs, and ``links`` of distinct fps put another likeness in place of fingerprints.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints") if rows is None else rows
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    labels = component_labels(links(distinct.select("fp")))
    own = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    # the least id of each component: a minimum per label, given back to its fingerprints
    least = own.where("label <> fp").groupBy("label").agg(F.min("first").alias("low"))
    heads = own.alias("o").join(least.alias("l"), F.col("o.label") == F.col("l.label"), "left")
    named = heads.select("fp", "n", F.col("o.label").alias("label"), F.least("first", "low").alias("id"))
    linked = named.where("label <> fp").select("fp", "n", "label")
    roots = named.where("label = fp").select("label", "id")
    ids = materialise(named.where("label = fp").select("fp", "n", "id").union(linked.join(roots, "label").select("fp", "n", "id")), "components")
    total = ids.agg(F.sum("n")).first()[0] or 0
    hot = ids.where(F.col("n") * HOT_SHARE > total).select("fp", "id")  # fewer than HOT_SHARE rows
    is_hot = rows.join(F.broadcast(hot.select("fp", F.lit(True).alias("hot"), F.col("id").alias("hot_id"))), "fp", "left")
    some = is_hot.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    others = is_hot.where("hot is null").select("doc_id", "fp").join(ids.select("fp", F.col("id").alias("component_id")), "fp", "left")
    return some.unionByName(others.select("doc_id", "fp", "component_id"))


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates, mark: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """``docs`` with one row of each component of ``groups``: the one with its smallest doc_id; ``mark``: the fp of a text.

    Rows whose doc_id is unique and not null go by one anti-join against the ids that go.  Rows that repeat a
    doc_id, or have none, cannot be told apart by it: they alone are reduced by a pre-aggregated
    minimum over (no id, doc_id, text), unless a unique id is less than theirs in their component.
    """
    found = materialise(groups(docs), "near")
    repeated = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    gone = found.where("doc_id <> component_id").select("doc_id")
    plain = docs.where(F.col("doc_id").isNotNull()).join(gone.unionByName(repeated), "doc_id", "left_anti").select(*docs.columns)
    odd_found = found.where("doc_id is null").unionByName(found.join(repeated, "doc_id", "left_semi"))
    if odd_found.isEmpty():
        return plain
    # the least id of a component that has a unique one less than all repeated ones
    led = odd_found.select("component_id").where("component_id is not null").distinct().join(repeated.withColumnRenamed("doc_id", "component_id"), "component_id", "left_anti")
    kinds = odd_found.select("doc_id", "fp", "component_id").distinct().join(led, "component_id", "left_anti")
    own = unused(docs, "fp")
    odd = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    marked = odd.mapInArrow(_with_fingerprint(own, mark), docs.select("*", F.lit(0).cast("long").alias(own)).schema)
    marked = marked.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(own).alias("fp"))
    joined = marked.alias("d").join(kinds.alias("k"), F.col("d.row.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.fp") == F.col("k.fp")))
    order = F.struct(F.col("d.row.doc_id").isNull(), F.col("d.row.doc_id"), F.col("d.row.text").isNull(), F.col("d.row.text"))
    group = F.coalesce(F.col("k.component_id").cast("string"), F.concat(F.lit("fp"), F.col("k.fp").cast("string")))
    one = joined.groupBy(group.alias("g")).agg(F.min_by("d.row", order).alias("row")).select("row.*")
    return plain.unionByName(one)


def _with_fingerprint(own: str, mark: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [mark(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(np.array(got, np.uint64).view(np.int64))], names=[*batch.schema.names, own])

    return run


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
