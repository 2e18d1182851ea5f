"""Column lists of every stage table (FIXTURES.md section 2) and the variable groups of each step.

These are fixed values: they name the columns the reference reads, writes and selects.
"""

from __future__ import annotations

ID_COLS = ["gvkey", "company_name", "date", "year", "quarter"]

# raw inputs
FUND_NUMERIC = ["atq", "ltq", "niq", "saleq", "cheq", "dlttq", "dlcq",
                "actq", "lctq", "cshoq", "prccq", "oibdpq", "rectq", "invtq"]
FUND_POSITIVE = ["atq", "actq", "cheq", "cshoq", "prccq"]
PRICE_NUMERIC = ["prccm", "trt1m", "cshom"]
PRICE_WINSOR = ["trt1m", "cshom"]
PRICE_RENAME = {"prccm": "price", "trt1m": "return_1m", "cshom": "shares_out"}
SPREAD_CAP = 10000.0

# step 4 output
MERGED_COLS = ID_COLS + ["atq", "ltq", "niq", "saleq", "cheq", "dlttq", "dlcq",
                         "actq", "lctq", "seqq", "cshoq", "prccq",
                         "price", "return_1m", "shares_out", "cds_spread"]

# step 5
FFILL_COLS = ["atq", "ltq", "niq", "saleq", "cheq", "dlttq", "dlcq",
              "actq", "lctq", "seqq", "cshoq", "prccq"]
WINSOR_COLS = ["atq", "ltq", "saleq", "cheq", "dlttq", "dlcq",
               "actq", "lctq", "seqq", "price", "return_1m", "cds_spread"]
REQUIRED_COLS = ["atq", "ltq", "price"]
MEDIAN_FILL_COLS = ["niq", "saleq", "cheq", "dlttq", "dlcq", "seqq", "return_1m"]
LAGS = [1, 2, 4]
PREP_NEW = ([f"cds_spread_lag{k}" for k in LAGS] + [f"return_lag{k}" for k in LAGS]
            + ["atq_change", "saleq_change", "cds_change"])
PREPROCESSED_COLS = MERGED_COLS + PREP_NEW

# step 6
ACCOUNTING_NEW = ["total_debt", "debt_to_equity", "debt_to_assets", "leverage", "lt_debt_ratio",
                  "current_ratio", "quick_ratio", "cash_ratio", "working_capital_ratio",
                  "roa", "roe", "profit_margin", "asset_turnover"]
RATIO_COLS = ACCOUNTING_NEW[1:]

# step 7
WINDOWS = [3, 6, 12]
VOL_MIN_PERIODS = {3: 2, 6: 3, 12: 6}
MARKET_NEW = (["market_cap", "log_market_cap"] + [f"momentum_{w}m" for w in WINDOWS]
              + [f"volatility_{w}m" for w in WINDOWS] + [f"max_drawdown_{w}m" for w in WINDOWS])
FEATURES_COMPLETE_COLS = PREPROCESSED_COLS + ACCOUNTING_NEW + MARKET_NEW

# step 8 selection
ACCOUNTING_FEATURES = ["atq", "ltq", "niq", "saleq", "seqq",
                       "debt_to_equity", "debt_to_assets", "leverage",
                       "current_ratio", "cash_ratio",
                       "roa", "roe", "profit_margin", "asset_turnover"]
MARKET_FEATURES = ["price", "return_1m", "log_market_cap", "momentum_3m", "momentum_12m",
                   "volatility_3m", "volatility_12m", "max_drawdown_12m"]
LAGGED_FEATURES = ["cds_spread_lag1", "cds_spread_lag4", "return_lag1", "return_lag4",
                   "atq_change", "saleq_change"]
TARGET_SOURCE = ["cds_spread"]
SELECTED_COLS = ID_COLS + ACCOUNTING_FEATURES + MARKET_FEATURES + LAGGED_FEATURES + TARGET_SOURCE

# step 9
TARGET_NEW = ["cds_spread_lead_4q", "future_cds_change_abs", "future_cds_change_pct", "distress_flag"]
TARGET_COLS = ID_COLS + ["cds_spread"] + TARGET_NEW
ML_DATASET_COLS = SELECTED_COLS + TARGET_NEW
LEAD_QUARTERS = 4
ABS_THRESHOLD = 50.0
PCT_THRESHOLD = 0.25

# step 10
LABEL = "distress_flag"
METADATA_COLS = ["cds_spread", "cds_spread_lead_4q", "future_cds_change_abs", "future_cds_change_pct"]
SPLIT_DATE = "2014-01-01"       # of the test panel; the operator has its own default

# step 12
THRESHOLD_GRID = [0.1 + i * 0.05 for i in range(16)]   # 0.10 ... 0.85, float error kept (T17)
