"""Exact quantiles that stay distributed and read their input twice.

``percentile`` (exact) keeps every distinct value of a column in one aggregation buffer on one
reducer, which does not survive a panel of 10^10 rows. This operator gives the **same** value
(linear interpolation between the order statistics at ``floor`` and ``ceil`` of ``p*(n-1)``,
as pandas ``quantile`` / NumPy / DuckDB ``quantile_cont``), at any size by the same plan, for all
columns and probabilities at once:

1. first read: a row a column with ``count``, least, greatest and a ``percentile_approx`` sketch, asked at
   ``STEPS`` + 1 points from ``p - delta`` to ``p + delta``. They bracket the wanted ranks (error of the sketch
   <= n/accuracy ranks, bracket margin 5x that) and cut the bracket into bins of about as many rows each,
   however the values are spread;
2. second read: rows inside a bracket counted by ``(column, p, bin, value)``, plus one ``below`` group that only
   counts. Ties collapse map-side, so a value held by a third of all rows is one row after the partial aggregate.
   The counts (about ``10 n / accuracy`` distinct values for each column and probability) are a staged table;
3. the bins' totals tell which one or two bins hold the ranks; a running count over the values of those bins alone
   (about ``n / accuracy`` of them) locates the two order statistics.

What reaches the driver is bounded by columns x probabilities x ``STEPS``. The result is a small local table:
plans that use it hold values and read nothing again. A bracket that should miss a rank raises an error; it never
yields NULL, which later steps would take for "no bound".
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

STEPS = 10


def _value(c: str) -> Column:
    """The column as a double; NaN counts as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _sketches(df: DataFrame, cols: Sequence[str], asked: Sequence[float], accuracy: int) -> DataFrame:
    """Count, least, greatest and approximate quantiles of each column that has values, by its number. The sketches of
    a column that tasks make meet in a task of their own, not all columns' in one."""
    values = F.array_compact(F.array(*[F.when(_value(c).isNotNull(), F.struct(F.lit(i).alias("i"), _value(c).alias("x"))) for i, c in enumerate(cols)]))
    return df.select(F.explode(values).alias("r")).select("r.*").groupBy("i").agg(
        F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", list(asked), accuracy).alias("ap"))


def _targets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int, margin: float) -> list[dict]:
    """First read: for each column and probability, n, the wanted ranks and the edges of the bins."""
    delta = margin / accuracy
    points = [[min(1.0, max(0.0, p + delta * (2 * i / STEPS - 1))) for i in range(STEPS + 1)] for p in probs]
    asked = sorted({x for own in points for x in own})
    found = {r.i: r for r in _sketches(df, cols, asked, accuracy).collect()}              # a row a column
    out = []
    for i, c in enumerate(cols):
        row = found.get(i)
        n = row.n if row else 0
        for k, p in enumerate(probs):
            t = {"var": c, "col": i, "k": k, "p": p, "n": n, "edges": []}
            if n:
                at = p * (n - 1)
                t |= {"lo": floor(at), "hi": ceil(at), "frac": at - floor(at)}
                # the margin must hold the sketch's error and the step between the two order statistics
                few = n * delta < 2 and margin > 0
                edges = sorted({float(row.ap[asked.index(x)]) for x in points[k]})
                t["edges"] = [float(row.least), *(edges[1:-1] if len(edges) > 2 else []), float(row.most)] if few else edges
            out.append(t)
    return out


def _cells(df: DataFrame, cols: Sequence[str], targets: list[dict]) -> DataFrame:
    """Second read: ``(t, bin, x, c)``; bin i holds the values above edge i - 1 up to edge i (bin 0: edge 0 itself), bin -1 is all below."""
    entries = []
    for t, target in enumerate(targets):
        if target["n"]:
            x, edges = F.col(f"x{target['col']}"), target["edges"]
            bin_ = F.when(x < edges[0], -1)
            for i, e in enumerate(edges):
                bin_ = bin_.when(x <= e, i)
            entries.append(F.when(x <= edges[-1], F.struct(F.lit(t).alias("t"), bin_.alias("bin"), F.when(x >= edges[0], x).alias("x"))))
    if not entries:
        return df.sparkSession.createDataFrame([], "t int, bin int, x double, c long")
    values = df.select(*[_value(c).alias(f"x{i}") for i, c in enumerate(cols)])
    return values.select(F.explode(F.array_compact(F.array(*entries))).alias("r")).groupBy("r.t", "r.bin", "r.x").agg(F.count(F.lit(1)).alias("c"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10000, margin: float = 5.0) -> list[dict]:
    """``var, k, p, n, q`` of each column and probability: the exact linear quantile, None for a column without values.

    ``margin``: half width of the bracket in units of the sketch's error.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    targets = _targets(df, cols, probs, accuracy, margin)
    cells = stage_table(_cells(df, cols, targets), "quantile_cells")
    start: dict[int, dict[int, int]] = {}
    total: dict[int, int] = {}
    for r in cells.groupBy("t", "bin").agg(F.sum("c").alias("c")).orderBy("t", "bin").collect():     # targets x (STEPS + 2) rows
        start.setdefault(r.t, {})[r.bin] = total.get(r.t, 0)
        total[r.t] = total.get(r.t, 0) + r.c
    wanted, ranks = [], []
    for t, target in enumerate(targets):
        if not target["n"]:
            continue
        for rank in {target["lo"], target["hi"]}:
            held = [b for b, s in start.get(t, {}).items() if s <= rank and b >= 0]
            if rank >= total.get(t, 0) or not held:
                raise ValueError(f"the bracket of a quantile misses its rank: {target['var']}")
            wanted.append((t, max(held)))
            ranks.append((t, rank - start[t][max(held)]))
    found: dict[tuple[int, int], float] = {}
    if wanted:
        spark = df.sparkSession
        # at most two rows a target on either table
        near = cells.join(F.broadcast(spark.createDataFrame(sorted(set(wanted)), "t int, bin int")), ["t", "bin"])
        asked = spark.createDataFrame([(t, b, r, r + start[t][b]) for (t, b), (_, r) in zip(wanted, ranks, strict=True)], "t int, bin int, rank long, whole long")
        upto = Window.partitionBy("t", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        near = near.withColumn("end", F.sum("c").over(upto))
        hit = near.join(F.broadcast(asked), ["t", "bin"]).filter((F.col("end") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("end")))
        found = {(r.t, r.whole): r.x for r in hit.select("t", "whole", "x").collect()}
    out = []
    for t, target in enumerate(targets):
        q = None
        if target["n"]:
            a, b = found[t, target["lo"]], found[t, target["hi"]]
            q = a if a == b else a + (b - a) * target["frac"]
        out.append({k: target[k] for k in ("var", "k", "p", "n")} | {"q": q})
    return out


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10000, margin: float = 5.0) -> DataFrame:
    """Long result ``(var, k, p, n, q)`` of ``quantiles``."""
    rows = [(r["var"], r["k"], r["p"], r["n"], r["q"]) for r in quantiles(df, cols, probs, accuracy, margin)]
    return df.sparkSession.createDataFrame(rows, "var string, k int, p double, n long, q double")


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                 names: Sequence[str] | None = None, **kw) -> DataFrame:
    """One row, one column per (col, prob): ``{col}_{name}`` (name defaults to ``q{k}``).

    A single row of values, so it is broadcast back onto the data it came from.
    """
    names = list(names) if names else [f"q{k}" for k in range(len(probs))]
    found = {(r["var"], r["k"]): r["q"] for r in quantiles(df, cols, probs, **kw)}
    one = df.sparkSession.range(1, numPartitions=1)
    return one.select(*[F.lit(found[c, k]).cast("double").alias(f"{c}_{nm}") for c in cols for k, nm in enumerate(names)])
