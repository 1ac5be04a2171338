"""Table operators: renames, null-keeping filters, overrides, least rows, heads, summaries."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F


def rename_id(df: DataFrame, to: str = "osm_id") -> DataFrame:
    """`id`, or else `osmid`, renamed; a warning if neither is there."""
    for name in ("id", "osmid"):
        if name in df.columns:
            return df.withColumnRenamed(name, to)
    warnings.warn("no id column to rename", stacklevel=2)
    return df


def not_equal(c: Column | str, value) -> Column:
    """True for nulls too, as comparisons of objects are."""
    return ~F.col(c).eqNullSafe(value) if isinstance(c, str) else ~c.eqNullSafe(value)


def override(df: DataFrame, overrides: DataFrame, key: str, column: str, drop_null: bool = False) -> DataFrame:
    """`column` from `overrides` (key, column) where it has the key; rows left without a value go on request."""
    new = overrides.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    out = df.join(new, F.col(key) == F.col("_key"), "left")
    value = F.coalesce("_new", column) if column in df.columns else F.col("_new")
    out = out.withColumn(column, value).drop("_key", "_new")
    return out.where(F.col(column).isNotNull()) if drop_null else out


def prepare_hospitals(df: DataFrame, overrides: DataFrame, excluded: str, key: str = "name", position: str = "position") -> DataFrame:
    """Emergency hospitals but for one of a name, with overridden positions, and without those that have none."""
    return override(df.where("emergency = 'yes'").where(not_equal(key, excluded)), overrides, key, position, drop_null=True)


def least_rows(df: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """Of each group the row with the least value; nulls and NaN are passed over, ties go by the tie columns."""
    rest = [c for c in df.columns if c not in (*by, value, *ties)]
    low = F.min(F.struct(value, *ties, *rest)).alias("_m")
    got = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(low)
    return got.select(*[F.col(c) if c in by else F.col(f"_m.{c}").alias(c) for c in df.columns])


def head_per_group(df: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, the exact quartiles, max."""
    c = F.col(column)
    q = [F.percentile(c, p).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"), *q, F.max(c).alias("max"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """bin (from 0), n. The last bin holds its upper end, as plotted histograms do."""
    width = (high - low) / bins
    c = F.col(column)
    of = F.least(F.floor((c - low) / width).cast("int"), F.lit(bins - 1))
    return df.where(c.between(low, high)).groupBy(of.alias("bin")).agg(F.count("*").alias("n"))


def share(df: DataFrame, flag: Column) -> DataFrame:
    """percentage of rows whose flag is true."""
    return df.agg((F.avg(flag.cast("int")) * 100).alias("percentage"))


def in_list(df: DataFrame, column: str, values: list[str] | None, default: tuple[str, ...]) -> DataFrame:
    """Rows whose value is one of the list; an empty or missing list means the default."""
    return df.where(F.col(column).isin(*(values or default)))


def filtered_with_warning(before: DataFrame, after: DataFrame) -> tuple[int, int]:
    """Counts before and after a filter, with a warning if rows went."""
    n, m = before.count(), after.count()
    if m < n:
        warnings.warn(f"{n - m} of {n} rows are outside", stacklevel=2)
    return n, m
