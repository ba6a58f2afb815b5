"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_extract import op1_html_text
from .licenses import op13_licenses
from .lm_scoring import op4_lm_scoring
from .media import op10_media_columns
from .mixing import op5_mixing
from .oracles import ORACLES
from .packing import op9_packing
from .pii import op7_pii
from .quality import op6_quality_rules
from .search import op12_lexical_search
from .simhash import op2_simhash
from .token_counts import op8_token_counts
from .token_store import op3_token_store
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_media_columns": op10_media_columns,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_licenses": op13_licenses,
}

__all__ = ["ORACLES", "QUERIES"]
