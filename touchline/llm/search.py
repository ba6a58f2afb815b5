"""Ranked lexical search: compressed postings by shard, document-at-a-time merges, a bounded heap of results.

``build_index`` cuts the documents, as they lie in their partitions, into shards of about SHARD_BYTES of text
(a longer text is a shard of its own) and writes, without any shuffle, for each shard

* a row for each term: its documents, by place in the shard's order of doc_id, and how often each holds
  it, as gaps and counts in variable-length bytes;
* a row (term NULL) with the shard's doc_ids in that order and their numbers of terms.

``search`` takes the queries in blocks of about BLOCK_PAIRS (query, term) pairs.  A block's terms are broadcast where
they are no more than that, meet the index by a join in the JVM, and go with their postings to one task a
shard.  There each query's postings are merged document at a time by a heap of cursors; the k best are held in
a heap keyed by score, then doc_id.  Lists that together cannot lift a document over the
least of these leave the merge and are only looked up (their bound is exact, so no result is lost): most of
what frequent terms would cost falls away.  The k best of the shards are then ranked in two levels.

Scores are those of ``op12``'s contract: whole numbers, but for a term's weight floor(1000 ln((2N+2) / (2df+1))).

Defined cases: a null text or one without terms is no document and no result; a query without terms has no results;
repeated documents are ranked each; equal scores go by doc_id, a null one last; queries with equal id and text
are one query, null ids included; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import slices
from .licenses import LOWER, UPPER
from .store import fresh_path, materialise, read_columns

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8
NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same, of characters
SPAN = 4 << 20  # bytes of one text whose terms are held at once
SHARD_BYTES = 16 << 20
BLOCK_PAIRS = 200_000
ROWS = 1 << 16  # of a batch
K = 10
INDEX = "shard long, term string, df long, postings binary, doc_ids array<long>, lengths array<long>"


# ---- postings ------------------------------------------------------------------------------


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of 7 bits, the last of each below 128; and how many bytes each takes."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[at[own] + k] = (values[own] >> 7 * k & 127) | ((sizes[own] > k + 1) << 7)
    return out, sizes


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127) << 7 * place, starts)


class Numbers(dict):
    """Numbers its keys in the order in which they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _spans(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SPAN bytes that cut no term."""
    at = 0
    while at < len(text):
        cut = NO_TERM.search(text, at + SPAN) if at + SPAN < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shard_rows(shard: int, doc_ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard."""
    order = sorted(range(len(texts)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0))
    terms, parts, lengths = Numbers(), [], np.zeros(len(texts), np.int64)
    number = terms.__getitem__
    for place, k in enumerate(order):
        for span in _spans(texts[k]):
            own = np.fromiter(map(number, TERM.findall(span.lower())), np.int64)
            lengths[place] += len(own)
            # counted by span: a long text's terms are few next to its words
            found, n = np.unique(own, return_counts=True)
            parts.append((found * len(texts) + place, n))
    keys, which = np.unique(np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
    tf = np.bincount(which, np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)]), len(keys)).astype(np.int64)
    term, place = np.divmod(keys, len(texts))
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=-1)
    gaps[first] = place[first] + 1
    data, sizes = pack_numbers(np.column_stack([gaps, tf]).ravel())
    ends = np.concatenate([[0], np.cumsum(sizes.reshape(-1, 2).sum(1))])
    first = np.append(first, len(term))
    raw, offsets, df, names = data.tobytes(), ends[first], np.diff(first), list(terms)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    yield pa.record_batch([pa.array([shard]), pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([[doc_ids[k] for k in order]], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64()))], schema=schema)
    for at in range(0, len(df), ROWS):
        end = min(at + ROWS, len(df))
        some = range(at, end)
        postings = pa.array([raw[offsets[k] : offsets[k + 1]] for k in some], pa.binary())
        lists = pa.nulls(end - at, pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(np.full(end - at, shard)), pa.array([names[term[first[k]]] for k in some], pa.binary()).cast(pa.string()), pa.array(df[at:end]), postings, lists, lists], schema=schema)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for part in slices(batch, "text", 1 << 20, SHARD_BYTES):
            ids += part.column("doc_id").to_pylist()
            texts += [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            size += part.column("text").nbytes
            if size >= SHARD_BYTES:
                yield from shard_rows(head + n, ids, texts)
                n, ids, texts, size = n + 1, [], [], 0
    if texts:
        yield from shard_rows(head + n, ids, texts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the index of all documents in the shared folder (or at ``path``) and reads it; no shuffle."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "postings")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_index, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


# ---- queries -------------------------------------------------------------------------------


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(PATTERN), F.lit(0)))


def top_k(lists: list[tuple[list[int], list[int], int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place) of lists of (places, scores, greatest score, k-th greatest score or 0); ties by place.

    ``first`` lists, those of the least greatest scores, are out of the merge: their bounds add up to no more than
    ``least``, which a result must exceed.
    """
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    bounds = list(accumulate(x[2] for x in lists))
    least = max([0, *(x[3] - 1 for x in lists)])  # k documents score at least the k-th greatest of a list
    first = bisect_left(bounds, least + 1)
    cursors = [0] * len(lists)
    heads = [(x[0][0], j) for j, x in enumerate(lists) if j >= first]
    heapq.heapify(heads)
    best: list[tuple[int, int]] = []  # (score, -place), the worst at the head
    while heads:
        place, score = heads[0][0], 0
        while heads and heads[0][0] == place:
            j = heads[0][1]
            places, scores = lists[j][0], lists[j][1]
            score += scores[cursors[j]]
            cursors[j] += 1
            if cursors[j] < len(places):
                heapq.heapreplace(heads, (places[cursors[j]], j))
            else:
                heapq.heappop(heads)
        for j in range(first - 1, -1, -1):
            if score + bounds[j] <= least:
                break
            places = lists[j][0]
            cursors[j] = at = bisect_left(places, place, cursors[j])
            if at < len(places) and places[at] == place:
                score += lists[j][1][at]
        if score <= least:
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -place))
        else:
            heapq.heapreplace(best, (score, -place))
        if len(best) == k and best[0][0] > least:
            least, before = best[0][0], first
            first = bisect_left(bounds, least + 1)
            if first > before:  # what leaves the merge is looked up from where it stands
                heads = [x for x in heads if x[1] >= first]
                heapq.heapify(heads)
    return sorted(((s, -p) for s, p in best), key=lambda x: (-x[0], x[1]))


def _searcher(n_docs: int, n_terms: int, k: int):
    """Ranks one shard's documents for each query of a block."""

    def run(hits: pa.Table, docs: pa.Table) -> pa.Table:
        lengths = np.asarray(docs.column("lengths")[0].values, np.int64)
        doc_ids = docs.column("doc_ids")[0].as_py()
        shard = docs.column("own")[0].as_py()
        m = 10 + 90 * lengths * n_docs // n_terms
        of_query: dict[int, list] = {}
        for data, weight, queries in zip(hits.column("postings").to_pylist(), hits.column("weight").to_pylist(), hits.column("queries").to_pylist()):
            numbers = unpack_numbers(data)
            places, tf = np.cumsum(numbers[::2]) - 1, numbers[1::2]
            scores = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            own = (places.tolist(), scores.tolist(), int(scores.max()), kth)
            for q in queries:
                of_query.setdefault(q, []).append(own)
        rows = [(q, shard, doc_ids[place], score) for q, lists in of_query.items() for score, place in top_k(lists, k)]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["q", "shard", "doc_id", "score"])

    return run


def _block_results(index: DataFrame, pairs: DataFrame, n_docs: int, n_terms: int, k: int, small: bool) -> DataFrame:
    """(q, shard, doc_id, score): the k best of every shard for the queries of one block of (q, term)."""
    send = F.broadcast if small else lambda df: df  # a block with more pairs than it may have is left to the optimiser
    wanted = pairs.groupBy("term").agg(F.collect_list("q").alias("queries"))  # as many rows as the block has pairs at most
    df = index.select("term", "df").join(send(wanted.select("term")), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = materialise(wanted.join(df, "term").select("term", "queries", weight.alias("weight")).where("weight > 0"), "block")
    hits = index.select("shard", "term", "postings").join(send(weighed), "term").select("shard", "postings", "weight", "queries")
    docs = index.where("term is null").select(F.col("shard").alias("own"), "doc_ids", "lengths")
    return hits.groupBy("shard").cogroup(docs.groupBy("own")).applyInArrow(_searcher(n_docs, n_terms, k), "q long, shard long, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for every row of ``queries``, rank from 1."""
    spark = index.sparkSession
    each = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    items = materialise(each.select(F.monotonically_increasing_id().alias("q"), "item_id", terms_of(F.col("text")).alias("terms")).where(F.size("terms") > 0), "queries")
    sums = index.where("term is null").select(F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("t"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.count("*").alias("shards")).first()
    n_pairs = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    if not total.n or not n_pairs:
        return items.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    n_blocks = -(-n_pairs // BLOCK_PAIRS)
    pairs = items.select("q", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("block"), F.explode("terms").alias("term"))
    largest = pairs.groupBy("block").count().agg(F.max("count")).first()[0]
    parts = [_block_results(index, pairs.where(F.col("block") == b), total.n, total.t, k, largest <= 2 * BLOCK_PAIRS) for b in range(n_blocks)]
    found = reduce(DataFrame.unionByName, parts).withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(max(1, int(total.shards**0.5)))))
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*by, "shard"))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*by, "shard"))).where(F.col("rank") <= k)
    return best.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's ten best documents."""
    index = build_index(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    return search(index, read_columns(spark, sf_dir, "benchmark", "item_id", "text"))
