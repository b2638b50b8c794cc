"""Column profiles: frequencies, top values, summaries and null maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUARTILES = (0.25, 0.5, 0.75)
# Rank error of the sketch: one part in this many.
_ACCURACY = 10_000


def long_values(df: DataFrame, cols: Sequence[str], as_type: str = "string") -> DataFrame:
    """``(column, value)`` for several columns in one pass over the table."""

    def value(c: str) -> Column:
        cast = F.col(c).cast(as_type)
        # As in a data frame of numbers, NaN is a missing value.
        return F.when(~F.isnan(cast), cast) if as_type == "double" else cast

    pairs = [F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs)))


def value_counts(
    df: DataFrame, cols: Sequence[str], keep_null: bool = False, as_type: str = "string"
) -> DataFrame:
    """``(column, value, n)``: how often each value occurs in each column."""
    values = long_values(df, cols, as_type)
    if not keep_null:
        values = values.where("value is not null")
    return values.groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column; ties go by value.

    The rank filter keeps ``k`` rows per column in each task before the shuffle.
    """
    window = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, cols).withColumn("place", F.row_number().over(window))
    return ranked.where(F.col("place") <= k)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value)``, null included as a value."""
    return long_values(df, cols).distinct()


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, n_rows, n_null)`` for every column, in one scan."""
    counts = df.agg(
        F.count("*").alias("__rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("__rows").alias("n_rows"), F.col(f"`{c}`").alias("n_null")
        )
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def null_matrix(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One boolean per cell: is it null? ``keep`` columns pass through."""
    flags = [F.col(f"`{c}`").isNull().alias(c) for c in df.columns if c not in keep]
    return df.select(*keep, *flags)


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Scalar column names grouped as text, float, int, bool, date or other."""
    kinds: dict[str, list[str]] = {k: [] for k in ("text", "float", "int", "bool", "date", "other")}
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.StringType):
            kinds["text"].append(field.name)
        elif isinstance(kind, T.FractionalType):
            kinds["float"].append(field.name)
        elif isinstance(kind, T.IntegralType):
            kinds["int"].append(field.name)
        elif isinstance(kind, T.BooleanType):
            kinds["bool"].append(field.name)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds["date"].append(field.name)
        else:
            kinds["other"].append(field.name)
    return kinds


def table_shape(df: DataFrame) -> DataFrame:
    """``(column, type, non_null, n_rows)``, the table's outline."""
    types = F.create_map(
        *[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]
    )
    return null_counts(df).select(
        "column",
        types[F.col("column")].alias("type"),
        (F.col("n_rows") - F.col("n_null")).alias("non_null"),
        "n_rows",
    )


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probabilities: Sequence[float] = QUARTILES
) -> DataFrame:
    """``(column, p, quantile)`` with linear interpolation, exact at any size.

    A sketch with a guaranteed rank error brackets each quantile. Values below the
    bracket are only counted, values above it dropped, and just the values inside
    are sorted: a few ten-thousandths of the table. A bracket that missed its rank
    would raise an error instead of giving a wrong number.
    """
    values = long_values(df, cols, "double").where("value is not null")
    margin = 2.0 / _ACCURACY
    points = [
        min(max(p + side * margin, 0.0), 1.0) for p in probabilities for side in (-1, 1)
    ]
    sketches = values.groupBy("column").agg(
        F.percentile_approx("value", points, _ACCURACY).alias("at"), F.count("*").alias("total")
    )
    # In a short column the margin is less than one rank: all its values count as inside.
    short = F.col("total") < 2 * _ACCURACY
    brackets = [
        F.struct(
            F.lit(float(p)).alias("p"),
            F.when(short, F.lit(float("-inf"))).otherwise(F.get("at", F.lit(2 * i))).alias("low"),
            F.when(short, F.lit(float("inf"))).otherwise(F.get("at", F.lit(2 * i + 1))).alias("high"),
        )
        for i, p in enumerate(probabilities)
    ]
    # One row per profiled column.
    marked = values.join(F.broadcast(sketches), "column").select(
        "column", "value", "total", F.inline(F.array(*brackets))
    )
    # All values below a bracket fall into one group, so the map side adds them up.
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counts = (
        marked.where(F.col("value") <= F.col("high"))
        .groupBy("column", "p", "total", inside.alias("value"))
        .agg(F.count("*").alias("n"))
    )
    running = Window.partitionBy("column", "p").orderBy(F.asc_nulls_first("value"))
    ends = counts.withColumn("end", F.sum("n").over(running))
    rank = F.col("p") * (F.col("total") - 1)

    def value_at(position: Column) -> Column:
        here = (position < F.col("end")) & (position >= F.col("end") - F.col("n"))
        return F.max(F.when(here, F.col("value")))

    found = ends.groupBy("column", "p").agg(
        value_at(F.floor(rank)).alias("low"),
        value_at(F.ceil(rank)).alias("high"),
        F.max(rank - F.floor(rank)).alias("share"),
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    missed = F.raise_error(F.lit("the sketch missed a quantile")).cast("double")
    return found.select("column", "p", F.coalesce(value, missed).alias("quantile"))


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    moments = (
        long_values(df, cols, "double")
        .groupBy("column")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    wide = (
        exact_quantiles(df, cols)
        .groupBy("column")
        .agg(
            *[
                F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(f"p{int(p * 100)}")
                for p in QUARTILES
            ]
        )
    )
    return moments.join(F.broadcast(wide), "column", "left").select(
        "column", "n", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count, distinct values, the commonest value and its frequency."""
    counts = value_counts(df, cols)
    most = counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.count("*").alias("unique"), F.max("n").alias("freq")
    )
    # Ties for the commonest value go to the smallest one.
    peak = counts.select("column", "value", F.col("n").alias("freq"))
    return (
        peak.join(F.broadcast(most), ["column", "freq"])
        .groupBy("column", "freq", "n", "unique")
        .agg(F.min("value").alias("top"))
        .select("column", "n", "unique", "top", "freq")
    )
