"""Test panel derived from the provided TPC-H-style tables (see FIXTURES.md section 3).

The reference reads fundamentals, monthly prices, a wide spread matrix and a firm mapping
from files that are not shipped. Here the same four inputs are derived from ``lineitem`` and
``supplier`` with Spark aggregations, so every query's work grows with the given tables:

* firm ``gvkey`` = ``l_suppkey``; dates are ``l_shipdate`` moved forward 15 years;
* money is summed exactly and only the sum, a DECIMAL, is cast to double (the same in any engine);
* missing, negative, duplicate and unmapped values are injected by key arithmetic.

Line items are read and dealt out once, by firm and month (``firm_months``): a firm that holds a third of them
is spread over its months. All inputs are derived from the sums of a firm and month; the decimals are exact, so a
quarter is the sum of its months.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the fixture recipe (FIXTURES.md section 3).
SHIFT_MONTHS = 180          # l_shipdate + 15 years
DUP_MOD = 19                # (gvkey + k) % 19 = 0 -> duplicate fundamentals row
SPREAD_HOLE_MOD = 17        # whole quarter of zero spreads
MAP_DROP_MOD, MAP_DROP_REM = 11, 3
SPREAD_FIRM_MOD = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(x: float) -> Column:
    return F.lit(str(x)).cast("decimal(4,2)")


def _dsum(c: Column) -> Column:
    """Exact DECIMAL sum, cast to double once."""
    return F.sum(c).cast("double")


def hundredths(name: str, digits: int) -> Column:
    """``CAST(name AS DECIMAL(digits, 2))`` in hundredths. Only values near a tie or out of range need the cast itself."""
    x = F.col(name).cast("double") * 100
    near = F.rint(x)
    return F.when((F.abs(x - near) < 0.4) & (F.abs(near) < 10 ** digits), near.cast("long")).otherwise(
        (F.col(name).cast(f"decimal({digits},2)") * 100).cast("long"))


def lineitem_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their amounts in hundredths."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("gvkey"),
        F.add_months(F.to_date("l_shipdate"), SHIFT_MONTHS).alias("d"),
        hundredths("l_extendedprice", 12).alias("ep"),
        hundredths("l_quantity", 12).alias("qy"),
        hundredths("l_discount", 4).alias("dc"),
        hundredths("l_tax", 4).alias("tx"),
        F.col("l_returnflag").alias("rf"),
        F.col("l_linestatus").alias("ls"),
    )


def firm_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a firm and month: the sums from which every input is made, as DECIMAL.

    Rows are dealt out before they are summed. Sums made ahead of the shuffle would hold nearly a row for every line
    item where a firm's items lie scattered, each several times as wide as the item. A term is a whole number below
    2^63; it is summed in two parts, so that no sum can leave 64 bits.
    """
    b = lineitem_base(spark, sf_dir).select(
        "gvkey", F.trunc("d", "month").alias("ms"), "ep", "qy", "dc", "tx", (F.col("rf") == "R").alias("returned"),
        (F.col("rf") != "A").alias("sold"), (F.col("ls") == "O").alias("open"))
    ep, qy, dc, tx = F.col("ep"), F.col("qy"), F.col("dc"), F.col("tx")
    # name: (term, digits after its point)
    terms = {
        "s_ep": (ep, 2),
        "s_lt": (ep * (40 + 3 * tx), 4),
        "s_ni": (F.when(F.col("returned"), -50).otherwise(40) * ep * dc, 6),
        "s_sale": (F.when(F.col("sold"), ep), 2),
        "s_che": (F.when(F.col("open"), ep * tx), 4),
        "s_epdc": (ep * dc, 4),
        "s_eptx": (ep * tx, 4),
        "s_lct": (ep * (10 + tx), 4),
        "s_qy": (qy, 2),
        "s_dctx": (dc * tx, 4),
    }
    rows = b.repartition("gvkey", "ms").select("gvkey", "ms", "returned", *[t.alias(c) for c, (t, _) in terms.items()])
    parts = [x for c in terms for x in (F.sum(F.shiftright(c, 20)).alias(f"{c}_high"), F.sum(F.col(c).bitwiseAND((1 << 20) - 1)).alias(f"{c}_low"))]
    sums = rows.groupBy("gvkey", "ms").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("returned"), 1)).alias("n_r"), *parts)
    whole = lambda c: F.col(f"{c}_high").cast("decimal(20,0)") * F.lit(1 << 20) + F.col(f"{c}_low").cast("decimal(20,0)")
    return sums.select("gvkey", "ms", "n", "n_r", *[(whole(c) * F.lit(Decimal(1).scaleb(-k))).alias(c) for c, (_, k) in terms.items()])


def fx_fundamentals(months: DataFrame, duplicates: bool = True) -> DataFrame:
    """Quarterly fundamentals per firm; columns as the raw quarterly file + ``ingest_id``."""
    g = months.withColumn("qs", F.trunc("ms", "quarter")).groupBy("gvkey", "qs").agg(
        F.sum("n").alias("n"),
        F.sum("s_ep").cast("decimal(22,2)").alias("s_ep"),
        *[_dsum(F.col(c)).alias(c) for c in ("s_lt", "s_ni", "s_sale", "s_che", "s_epdc", "s_eptx", "s_lct")],
        F.sum("s_qy").alias("s_qy"),
    )
    k = F.year("qs") * 4 + F.quarter("qs")
    n, gv = F.col("n"), F.col("gvkey")
    s_ep = F.col("s_ep")
    out = g.select(
        gv,
        F.date_sub(F.add_months("qs", 3), 1).alias("datadate"),
        s_ep.cast("double").alias("atq"),
        F.when(n % 11 == 0, None)
         .when((gv * 3 + k) % 31 == 0, (s_ep * _dec(1.2)).cast("double"))
         .otherwise(F.col("s_lt")).alias("ltq"),
        F.when(n % 7 == 0, None).otherwise(F.col("s_ni")).alias("niq"),
        F.when(n % 13 == 0, None).otherwise(F.col("s_sale")).alias("saleq"),
        F.when((gv + k) % 23 == 0, -F.col("s_che")).otherwise(F.col("s_che")).alias("cheq"),
        F.col("s_epdc").alias("dlttq"),
        F.when(n % 5 == 0, None).otherwise(F.col("s_eptx")).alias("dlcq"),
        (s_ep * _dec(0.5)).cast("double").alias("actq"),
        F.col("s_lct").alias("lctq"),
        F.col("s_qy").cast("double").alias("cshoq"),
        (s_ep.cast("double") / F.col("s_qy").cast("double")).alias("prccq"),
        F.col("s_epdc").alias("oibdpq"),
        F.col("s_eptx").alias("rectq"),
        (s_ep * _dec(0.1)).cast("double").alias("invtq"),
        (gv * 1000000 + k * 10).cast("long").alias("ingest_id"),
        k.alias("_k"),
    )
    if duplicates:
        # a duplicate comes out of the same scan as its original
        copies = F.when((F.col("gvkey") + F.col("_k")) % DUP_MOD == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        out = out.withColumn("_copy", F.explode(copies))
        out = out.withColumns({"atq": F.col("atq") * (F.col("_copy") + 1), "ingest_id": F.col("ingest_id") + F.col("_copy")}).drop("_copy")
    return out.drop("_k")


def fx_prices(months: DataFrame) -> DataFrame:
    """Monthly prices per firm: ``gvkey, datadate, prccm, trt1m (percent), cshom, ingest_id``."""
    m = F.year("ms") * 12 + F.month("ms")
    p = F.col("s_ep").cast("double") / F.col("s_qy").cast("double")
    w = Window.partitionBy("gvkey").orderBy("ms")
    gv = F.col("gvkey")
    return months.select(
        gv,
        F.col("ms").alias("datadate"),
        F.when(F.col("n") % 9 == 0, None)
         .when((gv * 5 + m) % 61 == 0, F.lit(-1.0))
         .otherwise(p).alias("prccm"),
        (F.lit(100.0) * (p / F.lag(p).over(w) - 1)).alias("trt1m"),
        F.col("s_qy").cast("double").alias("cshom"),
        (gv * 1000000 + m).cast("long").alias("ingest_id"),
    )


def fx_spread_cells(months: DataFrame, sf_dir: str) -> DataFrame:
    """Long spread cells ``iqt, date (month start), spread`` before the wide pivot."""
    spark = months.sparkSession
    g = months.filter(F.col("gvkey") % SPREAD_FIRM_MOD != 0)
    sup = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("gvkey"), F.col("s_name").alias("iqt"))
    gv, n = F.col("gvkey"), F.col("n")
    m = F.year("ms") * 12 + F.month("ms")
    r97 = (gv * 7 + m) % 97
    cell = (F.when((gv + F.year("ms") * 4 + F.quarter("ms")) % SPREAD_HOLE_MOD == 0, F.lit(0.0))
            .when(n % 10 == 0, F.lit(0.0))
            .when(r97 == 0, F.lit(12000.0))
            .when(r97 == 1, F.lit(5.0))
            .otherwise(F.lit(20.0) + F.lit(2500.0) * F.col("s_dctx").cast("double") / n
                       + F.lit(400.0) * F.col("n_r") / n.cast("double")))
    return g.join(sup, "gvkey").select("iqt", F.col("ms").alias("date"), cell.alias("spread"))


def spread_header(date_col: Column) -> Column:
    """Column name of a month in the wide matrix: ``dd.MM.yy``."""
    return F.date_format(date_col, "dd.MM.yy")


def fx_spreads_wide(months: DataFrame, sf_dir: str) -> DataFrame:
    """Wide spread matrix as the raw file delivers it: all text, dates as headers, newest first,
    plus one column ``notes`` whose header is not a date."""
    cells = fx_spread_cells(months, sf_dir)
    # The header list is the file's schema: one entry per month of the date range, newest first.
    first, last = months.agg(F.min("ms"), F.max("ms")).first()
    span = [] if first is None else range(last.year * 12 + last.month - 1, first.year * 12 + first.month - 2, -1)
    headers = [f"01.{m % 12 + 1:02d}.{m // 12 % 100:02d}" for m in span]
    # Cells are dealt out by instrument before the pivot: its rows are as wide as the matrix. They are numbers until
    # then: Spark pivots text by as many aggregates as there are headers.
    wide = (cells.select("iqt", spread_header(F.col("date")).alias("hdr"), "spread").repartition("iqt")
            .groupBy("iqt").pivot("hdr", headers).agg(F.first("spread", ignorenulls=True)))
    wide = wide.select("iqt", *[F.col(f"`{h}`").cast("string").alias(h) for h in headers])
    sup = read_table(months.sparkSession, sf_dir, "supplier").select(
        F.col("s_name").alias("iqt"), (F.col("s_nationkey") + 1).cast("string").alias("notes"))
    return wide.join(sup, "iqt", "left").select("iqt", *[F.col(f"`{h}`") for h in headers], "notes")


def fx_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless mapping file: ``gvkey, iqt, company_name, extra`` (+ ``ingest_id`` = line)."""
    s = read_table(spark, sf_dir, "supplier")
    return (s.filter(F.col("s_suppkey") % MAP_DROP_MOD != MAP_DROP_REM)
            .select(F.col("s_suppkey").cast("string").alias("gvkey"),
                    F.col("s_name").alias("iqt"),
                    F.col("s_name").alias("company_name"),
                    F.lit(None).cast("string").alias("extra"),
                    F.col("s_suppkey").alias("ingest_id")))


def fx_firm_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm master list: ``gvkey, tic, cusip, sic`` as text (+ ``ingest_id``)."""
    s = read_table(spark, sf_dir, "supplier")
    cusip = F.when(F.col("s_suppkey") % 6 == 0, None).otherwise(
        F.concat(F.lit(" "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" ")))
    return s.select(F.col("s_suppkey").cast("string").alias("gvkey"),
                    F.col("s_name").alias("tic"), cusip.alias("cusip"),
                    F.col("s_nationkey").cast("string").alias("sic"),
                    F.col("s_suppkey").alias("ingest_id"))
