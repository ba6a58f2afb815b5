"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a keyed pseudo-random order and cut into blocks of
``block_docs``.  A source of weight w = m / SLOTS has, for its i-th block (i from 1), the
release time floor((i - 1) / w) and the deadline ceil(i / w).  At every slot the
released block with the earliest deadline goes next (ties: earlier release, then source), which
for weights that sum to 1 meets every deadline, so that after any number of slots each
source's count is within less than one block of weight times slots.

Weights are multiples of 1/slots, so the schedule repeats after that many slots: SLOTS, or
four times the number of sources where that is more.  One period is computed on the driver
(at most 4 MAX_SOURCES steps); the slot of any block then is ``period * slots + slot in the
period``, a plain expression for every row: nothing is sequential in the number of documents.
Sources beyond the MAX_SOURCES - 1 with the most documents are scheduled together, as one
source (REST); their documents all keep a place.

Ranks within a source are exact and need no task to see a whole source: rows are counted by
(source, hash bucket), the counts are summed in two levels, over spans of buckets and
then within a span, and ranks are taken within a bucket.  A bucket that holds far more rows than
chance would give it, since an id is repeated very often, is dealt again by the rows' places.

Every document of a source with a weight is in the schedule.  A source that runs out only
ends itself: its later slots stay empty and the others go on in the order of their slots.
A partial last block is a block.  Slots before ``horizon``, the least slot that lacks its
block, hold all weights exactly (``exact``).  ``mix`` gives every document its block,
release, deadline and slot; ``mixed`` and op5_mixing keep every document that has a slot.

Defined cases: a null source is a source of its own ("\\x00none"); sources without a target,
or of weight nought, are outside the schedule and have null slots; null and repeated
doc_ids are ranked like any other rows; equal rows are told apart by their place; an
empty table gives an empty table; all other columns are kept, whatever their names: the
schedule is one struct column with a name of the caller's choice.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise, read_columns, unused

SLOTS = 1000
BLOCK_DOCS = 8
TEMPERATURE = 0.8
BUCKET_ROWS = 1024  # rows of a hash bucket, about
HASH_DIGITS = 15  # hexadecimal digits of the md5 of an id that order it
SPAN = 1024  # buckets that are summed together first
MAX_SOURCES = 20_000  # sources scheduled one by one
NONE, REST = "\x00none", "\x00rest"


def integer_weights(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Multiples of 1/slots next to the weights' shares (largest remainders); they sum to ``slots``.

    Sources of positive weight keep at least one slot, taken from the largest.
    """
    if any(not w >= 0 for w in weights.values()):
        raise ValueError("weights must be numbers from nought on")
    total = sum(weights.values())
    if not total > 0:
        return dict.fromkeys(weights, 0)
    if sum(w > 0 for w in weights.values()) > slots:
        raise ValueError(f"more than {slots} sources have a weight")
    exact = {s: w / total * slots for s, w in weights.items()}
    out = {s: max(int(x), 1 if x > 0 else 0) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s)):
        if sum(out.values()) < slots and exact[s] > 0:
            out[s] += 1
    while sum(out.values()) != slots:
        s = max(out, key=lambda s: (out[s], s))
        out[s] += 1 if sum(out.values()) < slots else -1
    return out


@lru_cache(maxsize=16)
def pfair_period(shares: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """For each source the slots of its blocks in one period of sum(shares) slots."""
    slots = sum(shares)
    order: list[list[int]] = [[] for _ in shares]
    # (release, source, i) until released, then (deadline, release, source, i)
    future = [(0, s, 1) for s, m in enumerate(shares) if m]
    heapq.heapify(future)
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(slots):
        while future and future[0][0] <= slot:
            release, s, i = heapq.heappop(future)
            heapq.heappush(ready, (-(-i * slots // shares[s]), release, s, i))
        deadline, _, s, i = heapq.heappop(ready)
        assert deadline > slot, "a deadline is missed"
        order[s].append(slot)
        if i < shares[s]:
            heapq.heappush(future, (i * slots // shares[s], s, i + 1))
    return tuple(map(tuple, order))


def _source(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(NONE))


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Documents of each source: the MAX_SOURCES - 1 largest by name, all others as REST, so the result is small."""
    sizes = docs.groupBy(_source(source_col).alias("s")).agg(F.count("*").alias("n"))
    rows = sizes.orderBy(F.desc("n"), "s").limit(MAX_SOURCES).collect()
    if len(rows) < MAX_SOURCES:
        return {r.s: r.n for r in rows}
    named = {r.s: r.n for r in rows[:-1]}
    return named | {REST: docs.count() - sum(named.values())}


def period_slots(counts: dict[str, int], slots: int | None = None) -> int:
    """The length of a period: every source can have a slot or more."""
    return slots or max(SLOTS, 4 * len(counts))


def tempered(counts: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Target weights that favour small sources: counts to a power below 1."""
    return {s: n**temperature for s, n in counts.items()}


def schedule(counts: dict[str, int], weights: dict[str, float] | None, slots: int) -> tuple[dict[str, int], dict[str, tuple[int, ...]]]:
    """Shares of all sources, and the slots in a period of those that have one."""
    shares = integer_weights(tempered(counts) if weights is None else weights, slots)
    names = sorted(s for s in shares if shares[s])
    return shares, dict(zip(names, pfair_period(tuple(shares[s] for s in names)))) if names else {}


def mix(docs: DataFrame, into: str, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS, slots: int | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with a struct column ``into``: rank (in the source, from 0), block (from 1), release, deadline, slot, exact.

    slot is null only for sources without a weight; exact: before the first slot that lacks its block.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table already has a column {into}")
    spark = docs.sparkSession
    counts = source_counts(docs, source_col) if counts is None else counts
    slots = period_slots(counts, slots)
    shares, period = schedule(counts, weights, slots)
    # the slot that would hold the block after a source's last one
    horizon = min((_slot(period[s], _blocks(counts.get(s, 0), block_docs), slots) for s in period), default=0)
    # the given columns are one struct from here on, so that no name can clash
    source = _source(source_col)
    if REST in counts:
        named = spark.createDataFrame([(s,) for s in counts if s != REST], "name string")  # fewer than MAX_SOURCES rows
        docs_in = docs.select(F.struct("*").alias("row"), source.alias("name")).join(F.broadcast(named.withColumn("own", F.lit(True))), "name", "left")
        rows = docs_in.select("row", F.when(F.col("own"), F.col("name")).otherwise(F.lit(REST)).alias("source"))
    else:
        rows = docs.select(F.struct("*").alias("row"), source.alias("source"))
    # ids order the rows; rows that have none are spread by their place
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    name = F.coalesce(F.col("row").getField(id_col).cast("string"), F.concat(F.lit("p"), F.col("place").cast("string")))
    rows = rows.withColumn("hash", F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long"))
    # buckets are ranges of hashes, so ranks are by the hash alone, however many buckets there are
    n_buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.expr(f"hash div {-(-(1 << 4 * HASH_DIGITS) // n_buckets)}"))
    sizes = materialise(rows.groupBy("source", "bucket").agg(F.count("*").alias("n")), "buckets")
    full = sizes.where(F.col("n") > 16 * BUCKET_ROWS)
    if full.isEmpty():
        rows, sizes = rows.withColumn("part", F.lit(0).cast("long")), sizes.withColumn("part", F.lit(0).cast("long"))
    else:
        rows = rows.join(full, ["source", "bucket"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("place"), F.expr(f"n div {BUCKET_ROWS}")), F.lit(0))).drop("n")
        sizes = materialise(rows.groupBy("source", "bucket", "part").agg(F.count("*").alias("n")), "buckets")
    span = F.expr(f"bucket div {SPAN}").alias("span")
    spans = sizes.groupBy("source", span).agg(F.sum("n").alias("m"))
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("source", "span", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "span").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("*", span).select("source", "bucket", "part", "span", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("in_span"))
    firsts = firsts.join(spans, ["source", "span"]).select("source", "bucket", "part", (F.col("earlier") + F.col("in_span")).alias("first"))
    within = Window.partitionBy("source", "bucket", "part").orderBy("hash", "place")
    ranked = rows.withColumn("in_bucket", F.row_number().over(within)).join(firsts, ["source", "bucket", "part"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("in_bucket") - 1)
    ranked = ranked.withColumn("block", F.expr(f"rank div {int(block_docs)} + 1"))
    table = spark.createDataFrame([(s, shares[s], list(p)) for s, p in period.items()], "source string, share long, places array<int>")  # as many places as slots
    ranked = ranked.join(F.broadcast(table), "source", "left")
    release = F.expr(f"((block - 1) * {slots}) div share")
    deadline = F.expr(f"(block * {slots} + share - 1) div share")
    slot = F.expr(f"((block - 1) div share) * {slots}") + F.get("places", F.pmod(F.col("block") - 1, F.col("share")).cast("int"))
    out = ranked.withColumns({"release": release, "deadline": deadline, "slot": slot.cast("long")})
    out = out.withColumn("exact", F.coalesce(F.col("slot") < F.lit(horizon), F.lit(False)))
    return out.select("row.*", F.struct("rank", "block", "release", "deadline", "slot", "exact").alias(into))


def _blocks(n_docs: int, block_docs: int) -> int:
    return -(-n_docs // block_docs)


def _slot(places: tuple[int, ...], block: int, slots: int) -> int:
    """The slot of block number ``block`` (from 0)."""
    return block // len(places) * slots + places[block % len(places)]


def slot_cuts(blocks: dict[str, int], period: dict[str, tuple[int, ...]], slots: int, n: int) -> np.ndarray:
    """n - 1 slots that cut the schedule into n parts of equally many blocks (within one)."""
    own = [(blocks[s], np.array(period[s])) for s in period if blocks.get(s)]
    wanted = -(-np.arange(1, n, dtype=np.int64) * sum(b for b, _ in own) // n)
    low = np.zeros(n - 1, np.int64)
    high = np.full(n - 1, max((_slot(period[s], blocks[s] - 1, slots) + 1 for s in period if blocks.get(s)), default=0))
    while (low < high).any():  # the least slot that has so many blocks before it
        middle = (low + high) // 2
        before = np.zeros(n - 1, np.int64)
        for b, places in own:
            before += np.minimum(b, middle // slots * len(places) + np.searchsorted(places, middle % slots))
        enough = before >= wanted
        high, low = np.where(enough, middle, high), np.where(enough, low, np.minimum(middle + 1, high))
    return low


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS, slots: int | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """All documents that have a slot, in the order of the schedule, with their own columns.

    The rows are dealt to files by ranges of slots and sorted in each, so that files read
    one after the other give the interleaving.
    """
    counts = source_counts(docs, source_col) if counts is None else counts
    slots = period_slots(counts, slots)
    _, period = schedule(counts, weights, slots)
    own = unused(docs, "schedule")
    placed = mix(docs, own, weights, source_col, id_col, block_docs, slots, counts).where(F.col(own)["slot"].isNotNull())
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = slot_cuts({s: _blocks(c, block_docs) for s, c in counts.items()}, period, slots, n)

    @F.arrow_udf("int")
    def part(slot: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, slot.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    ordered = placed.repartitionById(n, part(F.col(own)["slot"])).sortWithinPartitions(F.col(own)["slot"], F.col(own)["rank"])
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source, block, window and slot; in_mix: it has a slot; targets: tempered shares of the sources."""
    s = F.col("s")
    return mix(read_columns(spark, sf_dir, "documents", "doc_id", "source"), "s").select(
        "doc_id", "source", s["block"].alias("block"), s["release"].alias("release_time"),
        s["deadline"].alias("deadline"), s["slot"].alias("slot"), s["slot"].isNotNull().alias("in_mix"),
    )
