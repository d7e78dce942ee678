"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, html, langid, mixing, neardup, pii, quality, search, secrets
from lodestone.llm.tokens import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_quality": quality.op4_quality,
    "op5_personal_data": pii.op5_personal_data,
    "op6_language_id": langid.op6_language_id,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_search": search.op8_search,
    "op9_token_counts": op9_token_counts,
    "op10_html_extract": html.op10_html_extract,
}

ORACLE: dict[str, str] = {
    "op3_secret_scan": secrets.SQL,
    "op8_search": search.SQL,
}
