"""Sinks: legends, measurements and monthly tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def legend_csv(legend: DataFrame, path: str) -> None:
    """Columns result, class and detail, every value in quotes, inner quotes doubled."""
    legend.select("result", "class", "detail").write.csv(path, header=True, quoteAll=True, escape='"')


def legend_json(legend: DataFrame) -> DataFrame:
    """One JSON object a result: its name and its classes in order."""
    return legend.groupBy("result").agg(F.array_sort(F.collect_list(F.struct("class", "detail"))).alias("legend")).select("result", F.to_json(F.struct("result", "legend")).alias("json"))


def measurements(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns, blanks where a table has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_months(table: DataFrame, path: str, month: str = "month") -> None:
    """Writes the months of ``table``; others stay as they are."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)
