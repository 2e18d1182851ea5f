"""Null-safe scalar expressions (NULL = missing everywhere; NaN never survives ingest)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """``to_numeric(errors='coerce')``: bad text -> NULL, NaN -> NULL (ANSI-safe)."""
    x = col(c)
    if dtype is None or isinstance(dtype, T.StringType):
        x = x.try_cast("double")
    else:
        x = x.cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def to_long(c: str | Column, dtype: T.DataType | None = None) -> Column:
    x = col(c)
    if dtype is None or isinstance(dtype, T.StringType):
        # '1234.0' style keys parse through double first, as a numeric coercion would
        return F.coalesce(x.try_cast("long"), x.try_cast("double").try_cast("long"))
    return x.cast("long")


def coerce(df: DataFrame, doubles: Iterable[str] = (), longs: Iterable[str] = ()) -> DataFrame:
    """Coerce the listed columns that exist; text goes through ``try_cast``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in doubles:
        if c in types:
            out[c] = to_double(F.col(c), types[c])
    for c in longs:
        if c in types:
            out[c] = to_long(F.col(c), types[c])
    return df.withColumns(out) if out else df


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b with a zero or missing denominator -> NULL (never +-inf, never an ANSI error)."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(c: str | Column, lo: Column, hi: Column) -> Column:
    """pandas ``clip``: missing stays missing (``least``/``greatest`` alone skip NULLs)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def positive_or_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(x >= 0, x)


def tier(rate: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Chained ``rate < cut -> label``; used for quality and balance labels."""
    out = None
    for cut, label in cuts:
        out = (F.when(rate < cut, F.lit(label)) if out is None
               else out.when(rate < cut, F.lit(label)))
    return out.otherwise(F.lit(otherwise))


# Fixed value: rounding offset shared with the SQL oracle. Decimal ties (x.xxxx5) are common
# in money ratios and engines break them differently; an offset just under one half moves
# every rounding boundary off those ties, so equal doubles give equal text in any engine.
ROUND_OFFSET = 0.4999999937


def rnd(c: str | Column, digits: int) -> Column:
    """Round for compared outputs: ``floor(x * 10^d + offset) / 10^d`` in plain IEEE double
    (values beyond 1e15 after scaling are left as they are)."""
    scale = F.lit(float(10 ** digits))
    y = col(c).cast("double") * scale
    r = F.when(F.abs(y) < F.lit(1e15), F.floor(y + F.lit(ROUND_OFFSET)).cast("double")).otherwise(y)
    return r / scale


def rnd_sig(c: str | Column, sig: int) -> Column:
    """Round to ``sig`` significant digits with the same IEEE steps as the oracle (for values
    whose magnitude is unbounded, e.g. drawdowns of a running product)."""
    x = col(c).cast("double")
    e = F.floor(F.log10(F.abs(x)))
    d = F.lit(sig - 1) - e
    up = F.pow(F.lit(10.0), d.cast("double"))
    down = F.pow(F.lit(10.0), (-d).cast("double"))
    r = (F.when(d >= 0, F.floor(x * up + F.lit(ROUND_OFFSET)).cast("double") / up)
         .otherwise(F.floor(x / down + F.lit(ROUND_OFFSET)).cast("double") * down))
    return F.when(x == 0, F.lit(0.0)).when(F.abs(d) <= 22, r).otherwise(x)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """Keep only the listed columns that exist, in list order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def draw_key(*cols: str, seed: int = 42) -> Column:
    """Text key of a seeded draw: md5 of the columns as text, so every engine draws alike."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))).cast("binary"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a ``draw_key``."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)
