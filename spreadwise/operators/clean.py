"""Step 3: coerce, clean and de-duplicate the raw tables; wide spreads to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, coerce, count_if, positive_or_null, to_double
from ..functions.stats import quantile_row
from ..schemas import FUND_NUMERIC, FUND_POSITIVE, PRICE_NUMERIC, PRICE_WINSOR, SPREAD_CAP


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str = "ingest_id") -> DataFrame:
    """``drop_duplicates(keys, keep='first')``: the row with the smallest ``order`` per key.

    An aggregate (``min_by`` over a struct), not a window: the partial aggregate keeps one row
    per key and task before the shuffle, so a key holding a third of the rows costs one row.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.min_by(packed, F.col(order)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
            .select(*df.columns))


def coerce_fundamentals(raw: DataFrame) -> DataFrame:
    return coerce(raw, doubles=FUND_NUMERIC).withColumn("datadate", F.to_date("datadate"))


def clean_fundamentals(raw: DataFrame) -> DataFrame:
    """Negative must-be-positive values -> NULL, ``seqq = atq - ltq`` (negative -> NULL),
    first row per ``(gvkey, datadate)``."""
    df = coerce_fundamentals(raw)
    df = df.withColumns({c: positive_or_null(c) for c in FUND_POSITIVE if c in df.columns})
    if "atq" in df.columns and "ltq" in df.columns:
        df = df.withColumn("seqq", positive_or_null(F.col("atq") - F.col("ltq")))
    return dedupe_first(df, ["gvkey", "datadate"])


def coerce_prices(raw: DataFrame) -> DataFrame:
    return coerce(raw, doubles=PRICE_NUMERIC).withColumn("datadate", F.to_date("datadate"))


def valid_prices(raw: DataFrame) -> DataFrame:
    """Rows with a positive price (NULL drops by itself)."""
    return coerce_prices(raw).filter(F.col("prccm") > 0)


def price_bounds(valid: DataFrame) -> DataFrame:
    """p1 / p99 of return and shares after the price filter, before de-duplication."""
    cols = [c for c in PRICE_WINSOR if c in valid.columns]
    return quantile_row(valid, cols, [0.01, 0.99], names=["p1", "p99"])


def clean_prices(raw: DataFrame) -> DataFrame:
    """Drop invalid prices, winsorise return and shares at p1 / p99, first row per key."""
    valid = valid_prices(raw)
    cols = [c for c in PRICE_WINSOR if c in valid.columns]
    b = valid.crossJoin(F.broadcast(price_bounds(valid)))
    b = b.withColumns({c: clip(c, F.col(f"{c}_p1"), F.col(f"{c}_p99")) for c in cols})
    return dedupe_first(b.select(*valid.columns), ["gvkey", "datadate"])


def unpivot_spreads(wide: DataFrame, id_col: str | None = None) -> DataFrame:
    """Wide matrix (first column = instrument, other headers = ``dd.MM.yy``) to
    ``iqt, date_str, cds_spread`` with the value still as read (text)."""
    id_col = id_col or wide.columns[0]
    vals = [c for c in wide.columns if c != id_col]
    cells = F.array(*[F.struct(F.lit(c).alias("date_str"), F.col(f"`{c}`").cast("string").alias("value")) for c in vals])
    return wide.select(F.col(id_col).alias("iqt"), F.explode(cells).alias("r")).select("iqt", "r.*")


def parse_spread_cells(cells: DataFrame, latest_year: int = 2099) -> DataFrame:
    """Parse ``dd.MM.yy`` (bad header -> NULL date) and the value (bad -> NULL).

    Two-digit years lie in 2000-2099; those after ``latest_year`` (T11) belong to the century before.
    """
    date = F.to_date(F.try_to_timestamp(F.col("date_str"), F.lit("dd.MM.yy")))
    if latest_year < 2099:
        date = F.when(F.year(date) > latest_year, F.add_months(date, -1200)).otherwise(date)
    return cells.select(
        "iqt", "date_str", date.alias("date"),
        to_double(F.col("value")).alias("cds_spread"))


def spreads_long(wide: DataFrame) -> DataFrame:
    """``transform_cds``: melt, parse, keep spreads > 0, cap at 10,000 bps."""
    p = parse_spread_cells(unpivot_spreads(wide))
    return (p.filter(F.col("cds_spread") > 0)
            .select("iqt", "date", F.least(F.col("cds_spread"), F.lit(SPREAD_CAP)).alias("cds_spread")))


def lineage_fundamentals(raw: DataFrame) -> DataFrame:
    """Rows in, removed as duplicates, rows out — one aggregation."""
    df = coerce_fundamentals(raw)
    k = df.groupBy("gvkey", "datadate").agg(F.count(F.lit(1)).alias("c"))
    return k.agg(F.sum("c").alias("initial"), F.lit(0).cast("long").alias("removed_rule"),
                 (F.sum("c") - F.count(F.lit(1))).alias("removed_duplicate"),
                 F.count(F.lit(1)).alias("final"))


def lineage_prices(raw: DataFrame) -> DataFrame:
    df = coerce_prices(raw).withColumn("_ok", F.col("prccm") > 0)
    k = df.groupBy("gvkey", "datadate").agg(F.count(F.lit(1)).alias("c"),
                                            count_if(F.col("_ok")).alias("v"))
    return k.agg(F.sum("c").alias("initial"), (F.sum("c") - F.sum("v")).alias("removed_rule"),
                 (F.sum("v") - count_if(F.col("v") > 0)).alias("removed_duplicate"),
                 count_if(F.col("v") > 0).alias("final"))


def lineage_spreads(wide: DataFrame) -> DataFrame:
    p = parse_spread_cells(unpivot_spreads(wide))
    return p.agg(F.count(F.lit(1)).alias("initial"),
                 count_if(~(F.col("cds_spread") > 0) | F.col("cds_spread").isNull()).alias("removed_rule"),
                 F.lit(0).cast("long").alias("removed_duplicate"),
                 count_if(F.col("cds_spread") > 0).alias("final"))


def link_cusip(master: DataFrame) -> DataFrame:
    """Step 0: firm -> CUSIP link table (drop missing cusip, trim, 6-char prefix, first per firm)."""
    df = master.select("gvkey", "tic", "cusip", "sic", "ingest_id").filter(F.col("cusip").isNotNull())
    df = df.withColumn("cusip", F.trim(F.col("cusip").cast("string")))
    df = df.withColumn("cusip6", F.substring("cusip", 1, 6))
    return dedupe_first(df, ["gvkey"]).drop("ingest_id")
