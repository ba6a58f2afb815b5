"""Exact length histogram of encoded documents, and suffix sums over it.

Every text is encoded whole; documents are aggregated by their number of ids (partial
sums before the shuffle, one row per length after it).  Suffix sums over the histogram
then answer every question about a context limit: how many documents and ids are at or
over it, how many ids remain if texts are truncated to it, and which share is kept.

The histogram has one row per distinct length, so its size is bounded by the longest
text, not by the number of documents; the running sums use two levels (chunks of
lengths), so that no task takes all rows even with very many distinct lengths.

Defined cases: a null text is empty and has length 0; repeated rows count each; an empty
table gives an empty histogram, and totals of nought; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import default_path, encoder, slices
from .store import materialise, read_columns

CHUNK = 4096  # lengths of one chunk of the histogram
SLICE, SLICE_BYTES = 2048, 64 << 20  # documents, and bytes of their texts, encoded at once: more repeats of a piece per look-up


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_BYTES):
                yield pa.record_batch([pa.array(coder.encode(part.column("text"))[1])], names=["length"])

    return run


def encoded_lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The number of ids of every text (column length)."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(path or default_path("byte_bpe_50k.json")), "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length with its documents and suffix sums.

    n_docs: of exactly this length; docs_from, tokens_from: of at least it; docs_to:
    of at most it; truncated_tokens: ids kept if every text is cut to ``length`` ids;
    quantile: share of documents at or below it.
    """
    hist = materialise(lengths.groupBy("length").agg(F.count("*").alias("n_docs")).withColumn("chunk", F.expr(f"length div {CHUNK}")), "histogram")
    # chunk totals are few: one row per CHUNK lengths
    chunks = hist.groupBy("chunk").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = chunks.select(
        "chunk", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
    )
    within = Window.partitionBy("chunk").orderBy(F.desc("length"))
    out = hist.withColumn("dw", F.sum("n_docs").over(within)).withColumn("tw", F.sum(F.col("n_docs") * F.col("length")).over(within))
    docs_from, tokens_from = F.col("dw") + F.col("d"), F.col("tw") + F.col("t")
    docs_to = F.col("all_docs") - docs_from + F.col("n_docs")
    return out.join(chunks, "chunk").select(
        "length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), docs_to.alias("docs_to"),
        (F.col("all_tokens") - tokens_from + docs_from * F.col("length")).alias("truncated_tokens"),
        (docs_to / F.col("all_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: documents longer than it, ids kept under truncation, and all ids.

    A limit between two lengths of the histogram uses the suffix sums of the next longer one.
    """
    if not limits:
        raise ValueError("no context limit is given")
    nought = F.lit(0).cast("long")
    size = F.col("length")
    answers = []
    for limit in limits:
        suffix = F.min_by(F.struct("docs_from", "tokens_from"), F.when(size > limit, size))
        docs, tokens = F.coalesce(suffix["docs_from"], nought), F.coalesce(suffix["tokens_from"], nought)
        answers.append(F.struct(F.lit(int(limit)).cast("long").alias("context_limit"), docs.alias("longer_docs"), (docs * limit - tokens).alias("cut")))
    all_docs, all_tokens = F.coalesce(F.sum("n_docs"), nought), F.coalesce(F.sum(F.col("n_docs") * size), nought)
    one = histogram.agg(F.array(*answers).alias("a"), all_docs.alias("docs"), all_tokens.alias("tokens"))
    return one.select(F.explode("a").alias("x"), "docs", "tokens").select(
        "x.context_limit", "x.longer_docs", (F.col("tokens") + F.col("x.cut")).alias("truncated_tokens"), "docs", "tokens",
    )


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least the share ``q`` of documents does not exceed; None if there are none."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(read_columns(spark, sf_dir, "documents", "text")))
