"""Steps 6 and 7: accounting ratios (row-local) and market features (firm windows).

All step-7 windows share one ``partitionBy(gvkey).orderBy(date)`` spec, so they run on one
sort of the firm partitions. Frames count rows, as the reference's rolling windows do (T15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..schemas import VOL_MIN_PERIODS, WINDOWS
from .prep import firm, firm_to_date


def leverage_ratios(df: DataFrame) -> DataFrame:
    td = F.col("dlttq") + F.col("dlcq")
    return df.withColumns({
        "total_debt": td,
        "debt_to_equity": safe_div(td, "seqq"),
        "debt_to_assets": safe_div(td, "atq"),
        "leverage": safe_div("atq", "seqq"),
        "lt_debt_ratio": safe_div("dlttq", "atq"),
    })


def liquidity_ratios(df: DataFrame, use_inventory: bool | None = None) -> DataFrame:
    """Quick ratio subtracts inventory only when ``invtq`` exists (it does not after the
    step-4 projection, so by default quick ratio equals current ratio)."""
    if use_inventory is None:
        use_inventory = "invtq" in df.columns
    quick = (safe_div(F.col("actq") - F.col("invtq"), "lctq") if use_inventory
             else safe_div("actq", "lctq"))
    return df.withColumns({
        "current_ratio": safe_div("actq", "lctq"),
        "quick_ratio": quick,
        "cash_ratio": safe_div("cheq", "lctq"),
        "working_capital_ratio": safe_div(F.col("actq") - F.col("lctq"), "atq"),
    })


def profitability_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "roa": safe_div("niq", "atq"),
        "roe": safe_div("niq", "seqq"),
        "profit_margin": safe_div("niq", "saleq"),
        "asset_turnover": safe_div("saleq", "atq"),
    })


def accounting_features(df: DataFrame) -> DataFrame:
    return profitability_ratios(liquidity_ratios(leverage_ratios(df)))


def _rows(w: int) -> Window:
    return firm().rowsBetween(-(w - 1), Window.currentRow)


def size_features(df: DataFrame) -> DataFrame:
    mc = F.col("price") * F.col("shares_out")
    return df.withColumns({"market_cap": mc}).withColumns({
        "log_market_cap": F.when(F.col("market_cap") + 1 > 0, F.log(F.col("market_cap") + 1))})


def momentum_features(df: DataFrame) -> DataFrame:
    """Rolling sum of the return over 3 / 6 / 12 rows, at least one value."""
    return df.withColumns({f"momentum_{w}m": F.sum("return_1m").over(_rows(w)) for w in WINDOWS})


def volatility_features(df: DataFrame) -> DataFrame:
    """Rolling sample std over 3 / 6 / 12 rows with at least 2 / 3 / 6 values."""
    out: dict[str, Column] = {}
    for w in WINDOWS:
        out[f"volatility_{w}m"] = F.when(F.count("return_1m").over(_rows(w)) >= VOL_MIN_PERIODS[w],
                                         F.stddev_samp("return_1m").over(_rows(w)))
    return df.withColumns(out)


def drawdown_features(df: DataFrame, return_unit: str = "as_is") -> DataFrame:
    """Running product of ``1 + r`` and its drop from the rolling max over 3 / 6 / 12 rows.

    ``return_unit='as_is'`` keeps the reference's use of percent returns as fractions (T8);
    ``'percent'`` divides by 100 first.
    """
    r = F.col("return_1m") / 100.0 if return_unit == "percent" else F.col("return_1m")
    d = df.withColumn("cum_return", F.product(F.lit(1.0) + r).over(firm_to_date()))
    d = d.withColumns({f"max_drawdown_{w}m": safe_div("cum_return", F.max("cum_return").over(_rows(w))) - 1
                       for w in WINDOWS})
    return d.drop("cum_return")


def market_features(df: DataFrame) -> DataFrame:
    return drawdown_features(volatility_features(momentum_features(size_features(df))))
