"""DuckDB SQL oracle: the same pipeline written independently as one chain of CTEs.

Every oracle query is ``WITH <all stage CTEs> <final select>``; DuckDB inlines only the CTEs
the final select reaches. Conventions shared with the Spark side: integers are BIGINT,
reals are DOUBLE rounded in the final select only, dates are DATE.
"""

from __future__ import annotations

from .. import schemas as S


def _dec(x: str) -> str:
    return f"CAST('{x}' AS DECIMAL(4,2))"


def _cols(cols, prefix=""):
    return ", ".join(f"{prefix}{c}" for c in cols)


def _ffill(c):
    return (f"last_value({c} IGNORE NULLS) OVER (PARTITION BY gvkey ORDER BY date "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}")


def _clip(c, lo, hi):
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo}), {hi}) END"


def _div(a, b):
    return f"({a}) / NULLIF({b}, 0)"


def _rows(w):
    return f"OVER (PARTITION BY gvkey ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


FIRM = "OVER (PARTITION BY gvkey ORDER BY date)"


def _build_ctes() -> list[tuple[str, str]]:
    ctes: list[tuple[str, str]] = []
    add = lambda name, body: ctes.append((name, body))

    # ---------------- fixture inputs ----------------
    add("li", """SELECT l_suppkey AS gvkey,
        CAST(CAST(l_shipdate AS DATE) + INTERVAL 180 MONTH AS DATE) AS d,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS ep, CAST(l_quantity AS DECIMAL(12,2)) AS qy,
        CAST(l_discount AS DECIMAL(4,2)) AS dc, CAST(l_tax AS DECIMAL(4,2)) AS tx,
        l_returnflag AS rf, l_linestatus AS ls FROM lineitem""")
    add("fq", f"""SELECT gvkey, qs, n, s_ep, s_lt, s_ni, s_sale, s_che, s_epdc, s_eptx, s_lct, s_qy,
        year(qs) * 4 + quarter(qs) AS k FROM (
        SELECT gvkey, CAST(date_trunc('quarter', d) AS DATE) AS qs, count(*) AS n, sum(ep) AS s_ep,
        CAST(sum(ep * ({_dec('0.4')} + {_dec('3')} * tx)) AS DOUBLE) AS s_lt,
        CAST(sum(CASE WHEN rf = 'R' THEN {_dec('-0.5')} ELSE {_dec('0.4')} END * ep * dc) AS DOUBLE) AS s_ni,
        CAST(sum(CASE WHEN rf <> 'A' THEN ep END) AS DOUBLE) AS s_sale,
        CAST(sum(CASE WHEN ls = 'O' THEN ep * tx END) AS DOUBLE) AS s_che,
        CAST(sum(ep * dc) AS DOUBLE) AS s_epdc, CAST(sum(ep * tx) AS DOUBLE) AS s_eptx,
        CAST(sum(ep * ({_dec('0.1')} + tx)) AS DOUBLE) AS s_lct, sum(qy) AS s_qy
        FROM li GROUP BY 1, 2)""")
    add("fund0", f"""SELECT gvkey, CAST(qs + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS datadate,
        CAST(s_ep AS DOUBLE) AS atq,
        CASE WHEN n % 11 = 0 THEN NULL WHEN (gvkey * 3 + k) % 31 = 0
             THEN CAST(s_ep * {_dec('1.2')} AS DOUBLE) ELSE s_lt END AS ltq,
        CASE WHEN n % 7 = 0 THEN NULL ELSE s_ni END AS niq,
        CASE WHEN n % 13 = 0 THEN NULL ELSE s_sale END AS saleq,
        CASE WHEN (gvkey + k) % 23 = 0 THEN -s_che ELSE s_che END AS cheq,
        s_epdc AS dlttq, CASE WHEN n % 5 = 0 THEN NULL ELSE s_eptx END AS dlcq,
        CAST(s_ep * {_dec('0.5')} AS DOUBLE) AS actq, s_lct AS lctq, CAST(s_qy AS DOUBLE) AS cshoq,
        CAST(s_ep AS DOUBLE) / CAST(s_qy AS DOUBLE) AS prccq, s_epdc AS oibdpq, s_eptx AS rectq,
        CAST(s_ep * {_dec('0.1')} AS DOUBLE) AS invtq, gvkey * 1000000 + k * 10 AS ingest_id, k
        FROM fq""")
    fund_cols = ["gvkey", "datadate"] + S.FUND_NUMERIC + ["ingest_id"]
    add("fund_raw", f"""SELECT {_cols(fund_cols)} FROM fund0 UNION ALL
        SELECT gvkey, datadate, atq * 2, {_cols(S.FUND_NUMERIC[1:])}, ingest_id + 1
        FROM fund0 WHERE (gvkey + k) % 19 = 0""")
    add("fmo", """SELECT gvkey, CAST(date_trunc('month', d) AS DATE) AS ms, count(*) AS n,
        sum(ep) AS s_ep, sum(qy) AS s_qy, sum(dc * tx) AS s_dctx,
        count(CASE WHEN rf = 'R' THEN 1 END) AS n_r FROM li GROUP BY 1, 2""")
    add("price_raw", """SELECT gvkey, ms AS datadate,
        CASE WHEN n % 9 = 0 THEN NULL WHEN (gvkey * 5 + year(ms) * 12 + month(ms)) % 61 = 0
             THEN CAST(-1.0 AS DOUBLE) ELSE p END AS prccm,
        CAST(100.0 AS DOUBLE) * (p / lag(p) OVER (PARTITION BY gvkey ORDER BY ms) - 1) AS trt1m,
        CAST(s_qy AS DOUBLE) AS cshom, gvkey * 1000000 + year(ms) * 12 + month(ms) AS ingest_id
        FROM (SELECT *, CAST(s_ep AS DOUBLE) / CAST(s_qy AS DOUBLE) AS p FROM fmo)""")
    add("cells", """SELECT s.s_name AS iqt, f.ms AS date,
        CASE WHEN (f.gvkey + year(f.ms) * 4 + quarter(f.ms)) % 17 = 0 THEN CAST(0 AS DOUBLE)
             WHEN f.n % 10 = 0 THEN CAST(0 AS DOUBLE)
             WHEN (f.gvkey * 7 + year(f.ms) * 12 + month(f.ms)) % 97 = 0 THEN CAST(12000 AS DOUBLE)
             WHEN (f.gvkey * 7 + year(f.ms) * 12 + month(f.ms)) % 97 = 1 THEN CAST(5 AS DOUBLE)
             ELSE CAST(20 AS DOUBLE) + CAST(2500 AS DOUBLE) * CAST(f.s_dctx AS DOUBLE) / f.n
                  + CAST(400 AS DOUBLE) * f.n_r / CAST(f.n AS DOUBLE) END AS spread
        FROM fmo f JOIN supplier s ON s.s_suppkey = f.gvkey WHERE f.gvkey % 5 <> 0""")
    # the dense wide matrix read back as cells (NULL where a firm had no month), plus `notes`
    add("wide_cells", """SELECT i.iqt, m.date, strftime(m.date, '%d.%m.%y') AS date_str, c.spread
        FROM (SELECT DISTINCT iqt FROM cells) i CROSS JOIN (
            SELECT CAST(unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)), INTERVAL 1 MONTH)) AS DATE) AS date FROM li) m
        LEFT JOIN cells c ON c.iqt = i.iqt AND c.date = m.date
        UNION ALL
        SELECT i.iqt, CAST(NULL AS DATE), 'notes', CAST(s.s_nationkey + 1 AS DOUBLE)
        FROM (SELECT DISTINCT iqt FROM cells) i LEFT JOIN supplier s ON s.s_name = i.iqt""")
    add("map_raw", """SELECT CAST(s_suppkey AS VARCHAR) AS gvkey, s_name AS iqt, s_name AS company_name,
        CAST(NULL AS VARCHAR) AS extra, s_suppkey AS ingest_id FROM supplier WHERE s_suppkey % 11 <> 3""")
    add("master_raw", """SELECT CAST(s_suppkey AS VARCHAR) AS gvkey, s_name AS tic,
        CASE WHEN s_suppkey % 6 = 0 THEN NULL
             ELSE ' ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' ' END AS cusip,
        CAST(s_nationkey AS VARCHAR) AS sic, s_suppkey AS ingest_id FROM supplier""")

    # ---------------- step 3: cleaning ----------------
    pos = {c: f"CASE WHEN {c} >= 0 THEN {c} END AS {c}" for c in S.FUND_POSITIVE}
    sel = ", ".join(pos.get(c, c) for c in S.FUND_NUMERIC)
    add("fund_pos", f"SELECT gvkey, datadate, {sel}, ingest_id FROM fund_raw")
    add("fund_clean", f"""SELECT gvkey, datadate, {_cols(S.FUND_NUMERIC)}, ingest_id, seqq FROM (
        SELECT *, CASE WHEN atq - ltq >= 0 THEN atq - ltq END AS seqq,
        row_number() OVER (PARTITION BY gvkey, datadate ORDER BY ingest_id) AS rn FROM fund_pos)
        WHERE rn = 1""")
    add("price_valid", "SELECT * FROM price_raw WHERE prccm > 0")
    add("price_b", """SELECT quantile_cont(trt1m, 0.01) AS t1, quantile_cont(trt1m, 0.99) AS t99,
        quantile_cont(cshom, 0.01) AS c1, quantile_cont(cshom, 0.99) AS c99 FROM price_valid""")
    add("price_clean", f"""SELECT gvkey, datadate, prccm, trt1m, cshom, ingest_id FROM (
        SELECT gvkey, datadate, prccm, {_clip('trt1m', 't1', 't99')} AS trt1m,
        {_clip('cshom', 'c1', 'c99')} AS cshom, ingest_id,
        row_number() OVER (PARTITION BY gvkey, datadate ORDER BY ingest_id) AS rn
        FROM price_valid, price_b) WHERE rn = 1""")
    add("spreads_long", f"""SELECT iqt, date, least(spread, {S.SPREAD_CAP}) AS cds_spread
        FROM wide_cells WHERE spread > 0""")
    add("link", """SELECT gvkey, tic, cusip, sic, cusip6 FROM (
        SELECT gvkey, tic, trim(cusip) AS cusip, sic, substring(trim(cusip), 1, 6) AS cusip6,
        row_number() OVER (PARTITION BY gvkey ORDER BY ingest_id) AS rn
        FROM master_raw WHERE cusip IS NOT NULL) WHERE rn = 1""")

    # ---------------- step 4: merge ----------------
    add("map_iqt", """SELECT iqt, max_by(TRY_CAST(gvkey AS BIGINT), ingest_id) AS gvkey
        FROM map_raw WHERE iqt IS NOT NULL GROUP BY iqt""")
    add("map_name", """SELECT TRY_CAST(gvkey AS BIGINT) AS gvkey, max_by(company_name, ingest_id) AS company_name
        FROM map_raw WHERE TRY_CAST(gvkey AS BIGINT) IS NOT NULL GROUP BY 1""")
    add("q_price", """SELECT gvkey, year(datadate) AS year, quarter(datadate) AS quarter,
        max_by(prccm, CASE WHEN prccm IS NOT NULL THEN datadate END) AS price,
        max_by(trt1m, CASE WHEN trt1m IS NOT NULL THEN datadate END) AS return_1m,
        max_by(cshom, CASE WHEN cshom IS NOT NULL THEN datadate END) AS shares_out
        FROM price_clean WHERE gvkey IS NOT NULL AND datadate IS NOT NULL GROUP BY 1, 2, 3""")
    add("spreads_mapped", """SELECT s.iqt, s.date, s.cds_spread, m.gvkey FROM spreads_long s
        JOIN map_iqt m ON m.iqt = s.iqt WHERE m.gvkey IS NOT NULL""")
    add("q_spread", """SELECT gvkey, year(date) AS year, quarter(date) AS quarter, avg(cds_spread) AS cds_spread
        FROM spreads_mapped WHERE date IS NOT NULL GROUP BY 1, 2, 3""")
    fcols = ["atq", "ltq", "niq", "saleq", "cheq", "dlttq", "dlcq", "actq", "lctq", "seqq", "cshoq", "prccq"]
    add("merged", f"""SELECT f.gvkey, n.company_name, f.datadate AS date, year(f.datadate) AS year,
        quarter(f.datadate) AS quarter, {_cols(fcols, 'f.')}, p.price, p.return_1m, p.shares_out,
        s.cds_spread
        FROM fund_clean f
        JOIN q_price p ON p.gvkey = f.gvkey AND p.year = year(f.datadate) AND p.quarter = quarter(f.datadate)
        LEFT JOIN map_name n ON n.gvkey = f.gvkey
        LEFT JOIN q_spread s ON s.gvkey = f.gvkey AND s.year = year(f.datadate) AND s.quarter = quarter(f.datadate)""")

    # ---------------- step 5: preprocessing ----------------
    merged_cols = S.MERGED_COLS
    add("ffilled", "SELECT " + ", ".join(_ffill(c) if c in S.FFILL_COLS else c for c in merged_cols)
        + " FROM merged")
    add("winsor_b", "SELECT " + ", ".join(
        f"quantile_cont({c}, 0.01) AS {c}_p1, quantile_cont({c}, 0.99) AS {c}_p99" for c in S.WINSOR_COLS)
        + " FROM ffilled")
    add("winsorized", "SELECT " + ", ".join(
        f"{_clip(c, c + '_p1', c + '_p99')} AS {c}" if c in S.WINSOR_COLS else c for c in merged_cols)
        + " FROM ffilled, winsor_b")
    add("required", "SELECT * FROM winsorized WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in S.REQUIRED_COLS))
    add("firm_filled", "SELECT " + ", ".join(
        f"coalesce({c}, median({c}) OVER (PARTITION BY gvkey)) AS {c}" if c in S.MEDIAN_FILL_COLS else c
        for c in merged_cols) + " FROM required")
    add("overall_med", "SELECT " + ", ".join(f"median({c}) AS {c}_med" for c in S.MEDIAN_FILL_COLS)
        + " FROM firm_filled")
    add("median_filled", "SELECT " + ", ".join(
        f"coalesce({c}, {c}_med) AS {c}" if c in S.MEDIAN_FILL_COLS else c for c in merged_cols)
        + " FROM firm_filled, overall_med")
    lags = [f"lag(cds_spread, {k}) {FIRM} AS cds_spread_lag{k}" for k in S.LAGS]
    lags += [f"lag(return_1m, {k}) {FIRM} AS return_lag{k}" for k in S.LAGS]
    lags += [f"{_div('atq', f'lag(atq, 1) {FIRM}')} - 1 AS atq_change",
             f"{_div('saleq', f'lag(saleq, 1) {FIRM}')} - 1 AS saleq_change",
             f"cds_spread - lag(cds_spread, 1) {FIRM} AS cds_change"]
    add("preprocessed", f"SELECT *, {', '.join(lags)} FROM median_filled")

    # ---------------- steps 6-7: features ----------------
    acc = ["dlttq + dlcq AS total_debt",
           f"{_div('dlttq + dlcq', 'seqq')} AS debt_to_equity",
           f"{_div('dlttq + dlcq', 'atq')} AS debt_to_assets",
           f"{_div('atq', 'seqq')} AS leverage",
           f"{_div('dlttq', 'atq')} AS lt_debt_ratio",
           f"{_div('actq', 'lctq')} AS current_ratio",
           f"{_div('actq', 'lctq')} AS quick_ratio",
           f"{_div('cheq', 'lctq')} AS cash_ratio",
           f"{_div('actq - lctq', 'atq')} AS working_capital_ratio",
           f"{_div('niq', 'atq')} AS roa",
           f"{_div('niq', 'seqq')} AS roe",
           f"{_div('niq', 'saleq')} AS profit_margin",
           f"{_div('saleq', 'atq')} AS asset_turnover"]
    add("features_accounting", f"SELECT *, {', '.join(acc)} FROM preprocessed")
    mk = ["price * shares_out AS market_cap",
          "CASE WHEN price * shares_out + 1 > 0 THEN ln(price * shares_out + 1) END AS log_market_cap"]
    mk += [f"sum(return_1m) {_rows(w)} AS momentum_{w}m" for w in S.WINDOWS]
    mk += [f"CASE WHEN count(return_1m) {_rows(w)} >= {S.VOL_MIN_PERIODS[w]} "
           f"THEN stddev_samp(return_1m) {_rows(w)} END AS volatility_{w}m" for w in S.WINDOWS]
    mk += [f"product(1 + return_1m) OVER (PARTITION BY gvkey ORDER BY date "
           f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_return"]
    add("features_mk0", f"SELECT *, {', '.join(mk)} FROM features_accounting")
    dd = [f"{_div('cum_return', f'max(cum_return) {_rows(w)}')} - 1 AS max_drawdown_{w}m" for w in S.WINDOWS]
    add("features_complete", f"SELECT {_cols(S.FEATURES_COMPLETE_COLS[:-3])}, {', '.join(dd)} FROM features_mk0")

    # ---------------- steps 8-10 ----------------
    add("ml_ready", f"SELECT {_cols(S.SELECTED_COLS)} FROM features_complete")
    add("ml_lead", f"""SELECT *, lead(cds_spread, {S.LEAD_QUARTERS}) {FIRM} AS cds_spread_lead_4q FROM ml_ready""")
    add("ml_chg", """SELECT *, cds_spread_lead_4q - cds_spread AS future_cds_change_abs,
        CASE WHEN cds_spread > 0 THEN (cds_spread_lead_4q - cds_spread) / cds_spread END AS future_cds_change_pct
        FROM ml_lead""")
    add("ml_dataset", f"""SELECT *, CAST(CASE WHEN cds_spread_lead_4q IS NULL THEN NULL
        WHEN coalesce(future_cds_change_abs >= {S.ABS_THRESHOLD} OR future_cds_change_pct >= {S.PCT_THRESHOLD}, false)
        THEN 1 ELSE 0 END AS INTEGER) AS distress_flag FROM ml_chg""")
    add("split_tbl", f"""SELECT *, CASE WHEN date < DATE '{S.SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split
        FROM ml_dataset WHERE distress_flag IS NOT NULL""")

    # flagship slice: label on the merged panel
    add("m_lead", f"SELECT *, lead(cds_spread, {S.LEAD_QUARTERS}) {FIRM} AS cds_spread_lead_4q FROM merged")
    add("m_target", f"""SELECT *, CAST(CASE WHEN cds_spread_lead_4q IS NULL THEN NULL
        WHEN coalesce(cds_spread_lead_4q - cds_spread >= {S.ABS_THRESHOLD}
             OR (CASE WHEN cds_spread > 0 THEN (cds_spread_lead_4q - cds_spread) / cds_spread END) >= {S.PCT_THRESHOLD}, false)
        THEN 1 ELSE 0 END AS INTEGER) AS distress_flag FROM m_lead""")
    return ctes


CTES = _build_ctes()
PREFIX = "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in CTES) + "\n"


def q(final_select: str, extra_ctes: str = "") -> str:
    """Full oracle text: all stage CTEs (+ optional extra ones) and the final select."""
    if extra_ctes:
        return PREFIX.rstrip("\n") + ",\n" + extra_ctes + "\n" + final_select
    return PREFIX + final_select
