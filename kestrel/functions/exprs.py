"""Column expressions shared by operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.fixed import WARN_LATENCY_MS


def col_or_null(df, name: str, dtype: str = "double") -> Column:
    """The column if present, else a typed NULL (absent column = NULL column)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """Coerce to double; unparsable text and NaN become NULL."""
    text = F.trim(c.cast("string"))
    d = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))       # a bare cast also takes 12d and 12f
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def error_flag(level: Column) -> Column:
    """1 when the level is ERROR, else 0."""
    return F.when(level == "ERROR", 1).otherwise(0).cast("int")


def derive_level(error: Column, latency: Column) -> Column:
    """ERROR when errored, WARN above the latency threshold, else INFO."""
    return (F.when(error >= 1, "ERROR")
            .when(latency > WARN_LATENCY_MS, "WARN").otherwise("INFO"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ."""
    return F.unix_micros(ts.cast("timestamp"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, accumulated in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 - cosine distance; NULL when either vector has zero length."""
    return F.try_divide(dot(a, b), norm2(a) * norm2(b))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic.

    Uses the Abramowitz-Stegun 26.2.17 approximation of the normal tail
    (absolute error below 7.5e-8); Spark has no built-in normal CDF.
    """
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
               + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) / 2.5066282746310002 * poly
    return 2.0 * tail
