"""The queries of this subpackage: opN_<name> -> callable, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater import session
from tidewater.llm import curriculum, decontaminate, licenses, neardup, quality, secrets, substrings, tokens, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[..., DataFrame], *more: str) -> Query:
    """Apply the operator to whole tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.tune(spark)
        return operator(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in (name, *more)))

    return run


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": _over("documents", licenses.digest),
        "op2_url_filter": _over("pages", urls.digest),
        "op3_quality_rules": _over("documents", quality.digest),
        "op4_source_mix": _over("documents", curriculum.digest),
        "op5_substring_dedup": _over("documents", substrings.digest),
        "op6_token_files": _over("documents", tokens.digest),
        "op7_decontaminate": _over("documents", decontaminate.digest, "benchmark"),
        "op8_secret_scan": _over("documents", secrets.digest),
        "op9_near_dedup": _over("documents", neardup.digest),
        "op10_warc": _over("pages", warc.digest),
        "op3_quality_ablations": _over("documents", quality.ablation_digest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.ORACLE,
        "op3_quality_ablations": quality.ABLATION_ORACLE,
        "op4_source_mix": curriculum.ORACLE,
        "op5_substring_dedup": substrings.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op10_warc": warc.ORACLE,
    }
