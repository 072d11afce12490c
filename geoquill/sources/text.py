"""Coordinates in text: white space between elements, `#` for comments, sexagesimal angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(word: Column) -> Column:
    """d, d:m or d:m:s with a sign or a trailing N, S, E, W; NaN where it is none."""
    body = F.regexp_replace(word, "[nNeEsSwW]$", "")
    turned = F.when(word.rlike("[sSwW]$"), F.lit(-1.0)).otherwise(1.0)
    part = lambda k: F.try_element_at(F.split(body, ":"), F.lit(k))
    value = lambda k: part(k).try_cast("double")
    size = F.abs(value(1)) + F.coalesce(value(2), F.lit(0.0)) / 60 + F.coalesce(value(3), F.lit(0.0)) / 3600
    sign = F.when(F.startswith(body, F.lit("-")), F.lit(-1.0)).otherwise(1.0)
    return F.coalesce(sign * turned * size, F.lit(float("nan")))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """c1 to c4 and the number of elements given; missing ones are 0, 0, 0 and NaN. Empty lines are left out."""
    bare = F.trim(F.regexp_replace(F.split_part(F.col(column), F.lit("#"), F.lit(1)), r"[\s,]+", " "))
    words = F.split(bare, " ")
    rows = lines.select(words.alias("w")).filter(F.col("w")[0] != "")
    blank = [0.0, 0.0, 0.0, float("nan")]
    pick = lambda k: F.when(F.size("w") > k, number(F.try_element_at("w", F.lit(k + 1)))).otherwise(F.lit(blank[k]))
    return rows.select(*[pick(k).alias(f"c{k + 1}") for k in range(4)], F.least(F.size("w"), F.lit(4)).alias("dimension"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def stream(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.readStream.text(path))


def lines(df: DataFrame, columns: list[str], decimals: int | None = None) -> DataFrame:
    """One column of text; decimals are 5 for rows that begin with a number over 1000, else 10."""
    first = F.col(columns[0])
    text = lambda n: F.concat_ws(" ", *[F.format_string(f"%.{n}f", F.col(c)) for c in columns])
    value = text(decimals) if decimals is not None else F.when(F.abs(first) > 1000, text(5)).otherwise(text(10))
    return df.select(value.alias("value"))


def write(df: DataFrame, path: str, columns: list[str], decimals: int | None = None) -> None:
    lines(df, columns, decimals).write.text(path)
