"""What the operators share: tables of the shared folder, columns of a table, unused names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import fresh_path, materialise, shared_folder

__all__ = ["fresh_path", "materialise", "read_columns", "shared_folder", "unused"]


def read_columns(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken, k = {c.lower() for c in df.columns}, 0
    while (own := f"__{name}{k or ''}").lower() in taken:
        k += 1
    return own
