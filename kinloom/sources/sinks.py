"""Writers of the outputs; each is one distributed write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def tsv(df: DataFrame, path: str) -> None:
    """Tab separated with a header; empty strings stay empty, nothing is quoted."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def quoted_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """Snappy Parquet, partitioned by a column of few values if one is named."""
    out = df.write.mode("overwrite").option("compression", "snappy")
    (out.partitionBy(by) if by else out).parquet(path)


def thresholds(values: dict[str, float], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2)


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)


def report(summary: DataFrame, path: str) -> None:
    """A feature summary as one text column; it has a row for each feature."""
    from pyspark.sql import functions as F

    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns]
    summary.select(F.concat_ws(" | ", *cells).alias("value")).write.mode("overwrite").text(path)
