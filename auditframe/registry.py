"""All registered queries but those of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditframe.plans import cases, catalogue, more, packs, programs, scalars  # noqa: F401  (register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents by language, rule and severity."""
    return catalogue.pii_findings_by_lang(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)
