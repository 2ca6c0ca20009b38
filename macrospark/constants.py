"""Fixed values. These names, numbers and lists must stay exactly as they are:
stored panels, parameter tables and saved models refer to them."""

# The twelve indicators of the wide monthly panel.
INDICATORS = [
    "1_year_rate", "3_months_rate", "6_months_rate", "CPI", "INDPRO",
    "10_year_rate", "share_price", "unemployment_rate", "PPI",
    "OECD_CLI_index", "CSI_index", "gdp_per_capita",
]

# The four prediction targets, base first.
TARGETS = [
    "recession_probability",
    "1_month_recession_probability",
    "3_month_recession_probability",
    "6_month_recession_probability",
]

# Horizon in months of each shifted target.
TARGET_HORIZONS = {
    "1_month_recession_probability": 1,
    "3_month_recession_probability": 3,
    "6_month_recession_probability": 6,
}

# Indicators that get anomaly flags in the training features.
ANOMALY_INDICATORS = [
    "INDPRO", "CPI", "unemployment_rate", "PPI", "share_price",
    "1_year_rate", "3_months_rate", "6_months_rate", "10_year_rate",
]

# Indicators whose flags enter the regression row.
ROW_ANOMALY_INDICATORS = [
    "CPI", "unemployment_rate", "share_price",
    "3_months_rate", "6_months_rate", "10_year_rate",
]

# Provider series id -> panel column.
CATALOG = {
    "A939RX0Q048SBEA": "gdp_per_capita",
    "CPIAUCSL": "CPI",
    "DTB1YR": "1_year_rate",
    "DTB3": "3_months_rate",
    "DTB6": "6_months_rate",
    "INDPRO": "INDPRO",
    "IRLTLT01USM156N": "10_year_rate",
    "PCU3312103312100": "PPI",
    "RECPROUSM156N": "recession_probability",
    "SPASTT01USM661N": "share_price",
    "UMCSENT": "CSI_index",
    "UNRATE": "unemployment_rate",
    "USALOLITOAASTSAM": "OECD_CLI_index",
}

# Display label -> panel column, for what-if input.
INPUT_LABELS = {
    "1-Year Rate": "1_year_rate",
    "3-Month Rate": "3_months_rate",
    "6-Month Rate": "6_months_rate",
    "CPI": "CPI",
    "Industrial Production": "INDPRO",
    "10-Year Rate": "10_year_rate",
    "Share Price": "share_price",
    "Unemployment Rate": "unemployment_rate",
    "PPI": "PPI",
    "OECD CLI Index": "OECD_CLI_index",
    "CSI Index": "CSI_index",
}

# Display label -> source columns to try, in order.
LABEL_CANDIDATES = {
    "CPI": ["CPI", "cpi"],
    "PPI": ["PPI", "ppi"],
    "Industrial Production": ["INDPRO", "industrial_production", "indpro"],
    "Share Price": ["share_price", "SP500", "sharePrice"],
    "Unemployment Rate": ["unemployment_rate", "UNRATE", "unemploymentRate"],
    "3-Month Rate": ["3_months_rate", "3_month_rate", "DTB3"],
    "6-Month Rate": ["6_months_rate", "6_month_rate", "DTB6"],
    "1-Year Rate": ["1_year_rate", "DTB1YR"],
    "10-Year Rate": ["10_year_rate", "DGS10"],
}

# Tenors from short to long.
TENORS = [
    "1-Month Rate", "3-Month Rate", "6-Month Rate", "1-Year Rate",
    "2-Year Rate", "5-Year Rate", "10-Year Rate", "30-Year Rate",
]
SHORT_TENORS = ["1-Month Rate", "3-Month Rate", "6-Month Rate"]
LONG_TENORS = ["10-Year Rate", "30-Year Rate"]

# Indicator -> forecast family shown first.
PREFERRED_MODEL = {
    "1_year_rate": "prophet",
    "3_months_rate": "arima",
    "6_months_rate": "prophet",
    "CPI": "prophet",
    "INDPRO": "arima",
    "10_year_rate": "prophet",
    "share_price": "prophet",
    "unemployment_rate": "arima",
    "PPI": "arima",
    "OECD_CLI_index": "prophet",
    "CSI_index": "prophet",
    "gdp_per_capita": "prophet",
}

SPLIT_DATE = "2020-01-01"
OBSERVATION_START = "1967-02-01"
LAGS = [1, 3, 6]
WINDOWS = [3, 6, 12]
SEASON = 12

# Fourier group -> (pairs of terms, period in months, or quarters for the second).
FOURIER_GROUPS = {
    "monthly": (6, 12),
    "quarterly": (2, 4),
    "business": (3, 48),
    "longterm": (2, 120),
}

# Weights of the three base models in the weighted meta-feature.
BASE_WEIGHTS = [0.4, 0.35, 0.25]
META_ALPHAS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0]

# Decomposition columns every forecast frame carries.
REQUIRED_FEATURES = [
    "CSI_index_trend", "10_year_rate_trend", "3_months_rate_trend",
    "1_year_rate_trend", "unemployment_rate_trend", "6_months_rate_trend",
    "PPI_trend", "CPI_trend", "gdp_per_capita_trend", "gdp_per_capita_residual",
    "OECD_CLI_index_trend", "OECD_CLI_index_residual", "3_months_rate_residual",
    "INDPRO_trend", "share_price_trend", "6_months_rate_residual",
    "1_year_rate_residual", "10_year_rate_residual",
]

# The forty columns of the regression row, before the six flags.
ROW_FEATURES = [
    "share_price", "OECD_CLI_index", "CSI_index", "gdp_per_capita_residual",
    "gdp_per_capita_rollstd12", "PPI_diff1", "gdp_per_capita_diff1",
    "gdp_per_capita_diff3", "gdp_per_capita_pct_change1", "1_year_rate",
    "3_months_rate", "6_months_rate", "CPI", "INDPRO", "10_year_rate",
    "unemployment_rate", "PPI", "gdp_per_capita", "CSI_index_trend",
    "OECD_CLI_index_trend", "PPI_CPI_diff", "3_months_rate_rollmin12",
    "INDPRO_rollstd12", "PPI_rollstd12", "3_months_rate_diff3",
    "OECD_CLI_index_diff1", "CSI_index_rollmin12", "OECD_CLI_index_diff3",
    "OECD_CLI_index_residual", "share_price_trend", "CSI_index_lag6",
    "unemployment_rate_rollstd6", "PPI_rollstd6", "OECD_CLI_index_rollmax12",
    "CSI_index_rollmax6", "INDPRO_diff3", "unemployment_rate_diff3",
    "CSI_index_rollmin6", "OECD_CLI_index_pct_change1", "10_year_rate_residual",
]

# Dickey-Fuller 5 % critical value (constant, no trend).
DF_CRITICAL_5PCT = -2.86
