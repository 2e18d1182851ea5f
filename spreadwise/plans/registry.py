"""Query registry: each query = Spark builder + output spec + (optional) DuckDB oracle text.

The spec fixes names, types and rounding of the output on **both** sides:
``"k"`` integer -> BIGINT, ``"s"`` text, ``"d"`` date, ``"b"`` flag -> BIGINT 0/1,
an ``int`` = DOUBLE rounded to that many decimals (and -0.0 -> 0.0).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ROUND_OFFSET, rnd, rnd_sig
from ..session import fingerprint
from .oracle import q
from .pipeline import Stages

Spec = list[tuple[str, object]]


@dataclass
class Query:
    name: str
    build: Callable[[Stages], DataFrame]
    spec: Spec
    sql: str | None        # final select over the oracle CTEs; None = rows-only check
    extra_ctes: str = ""


REGISTRY: dict[str, Query] = {}
_STAGES: dict[tuple[str, str], tuple[str, Stages]] = {}
#: the tables that stages are derived from
INPUTS = ("lineitem", "supplier")


def stages_for(spark: SparkSession, sf_dir: str) -> Stages:
    """One ``Stages`` per (application, data dir): stage tables are cut once and shared, as long as the files
    they are derived from are the same. Stages of files that have changed since are dropped."""
    sf_dir = sf_dir.rstrip("/")
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in INPUTS])
    then, st = _STAGES.get(key, (None, None))
    if st is None or st.spark is not spark or then != now:
        if st is not None and then != now:
            st.drop()
        st = Stages(spark, sf_dir)
        _STAGES[key] = (now, st)
    return st


def refresh(spark: SparkSession, sf_dir: str) -> None:
    """Drop the stage tables, scores and models made from ``sf_dir``; the next query derives them anew."""
    _, st = _STAGES.pop((spark.sparkContext.applicationId, sf_dir.rstrip("/")), (None, None))
    if st is not None:
        st.drop()


def finalize(df: DataFrame, spec: Spec) -> DataFrame:
    out = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "k" or kind == "b":
            out.append(c.cast("long").alias(name))
        elif kind == "s":
            out.append(c.cast("string").alias(name))
        elif kind == "d":
            out.append(c.cast("date").alias(name))
        elif isinstance(kind, str) and kind.startswith("g"):
            out.append(rnd_sig(c, int(kind[1:])).alias(name))
        else:
            out.append(rnd(c.cast("double"), int(kind)).alias(name))
    return df.select(*out)


def finalize_sql(inner: str, spec: Spec) -> str:
    out = []
    for name, kind in spec:
        if kind in ("k", "b"):
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "s":
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        elif kind == "d":
            out.append(f"CAST({name} AS DATE) AS {name}")
        elif isinstance(kind, str) and kind.startswith("g"):
            out.append(f"{sql_rnd_sig(name, int(kind[1:]))} AS {name}")
        else:
            out.append(f"{sql_rnd(name, int(kind))} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{inner}\n) AS final_rows"


def sql_rnd(expr: str, digits: int) -> str:
    """The oracle's twin of ``functions.exprs.rnd``."""
    scale = f"CAST({float(10 ** digits)!r} AS DOUBLE)"
    y = f"(CAST({expr} AS DOUBLE) * {scale})"
    return (f"(CASE WHEN abs({y}) < CAST(1e15 AS DOUBLE) THEN floor({y} + CAST('{ROUND_OFFSET}' AS DOUBLE)) "
            f"ELSE {y} END / {scale})")


def sql_rnd_sig(expr: str, sig: int) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    d = f"({sig - 1} - floor(log10(abs({x}))))"
    up = f"pow(CAST(10.0 AS DOUBLE), CAST({d} AS DOUBLE))"
    down = f"pow(CAST(10.0 AS DOUBLE), CAST(-{d} AS DOUBLE))"
    off = f"CAST('{ROUND_OFFSET}' AS DOUBLE)"
    return (f"(CASE WHEN {x} = 0 THEN CAST(0.0 AS DOUBLE) WHEN abs({d}) > 22 THEN {x} "
            f"WHEN {d} >= 0 THEN floor({x} * {up} + {off}) / {up} "
            f"ELSE floor({x} / {down} + {off}) * {down} END)")


def query(name: str, spec: Spec, sql: str | None = None, extra_ctes: str = ""):
    def deco(fn: Callable[[Stages], DataFrame]):
        REGISTRY[name] = Query(name, fn, spec, sql, extra_ctes)
        return fn
    return deco


def spark_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    qy = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finalize(qy.build(stages_for(spark, sf_dir)), qy.spec)
    run.__name__ = name
    return run


def oracle_text(name: str) -> str | None:
    qy = REGISTRY[name]
    if qy.sql is None:
        return None
    return q(finalize_sql(qy.sql, qy.spec), qy.extra_ctes)
