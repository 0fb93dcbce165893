"""Default dimension rows: series, regions, currency pair, tenors, markets, seed values.

Every operator takes such dimensions as DataFrames, so these rows are only the defaults.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenorline import schemas

# The registered series.
# series_id, category, provider, provider's id, label, region, frequency, unit
SERIES = [
    ("eurusd_spot_daily", "fx_spot", "ecb", "EXR.D.USD.EUR.SP00.A",
     "US dollar/Euro ECB reference exchange rate, Daily", "FX", "daily", "usd_per_eur"),
    ("eurusd_spot_monthly", "fx_spot", "ecb", "EXR.M.USD.EUR.SP00.A",
     "US dollar/Euro ECB reference exchange rate, Monthly", "FX", "monthly", "usd_per_eur"),
    ("us_cpi_index", "inflation", "fred", "CPIAUCSL",
     "Consumer Price Index for All Urban Consumers: All Items in U.S. City Average", "US", "monthly", "index"),
    ("ea_cpi_index", "inflation", "fred", "CP00MI15EA20M086NEST",
     "Harmonized Index of Consumer Prices: All-Items HICP for Euro Area (20 Countries)", "EU", "monthly", "index"),
    ("usd_3m_rate", "market_rate", "fred", "DTB3",
     "3-Month Treasury Bill Secondary Market Rate, Discount Basis", "US", "daily", "percent"),
    ("usd_6m_rate", "market_rate", "fred", "DTB6",
     "6-Month Treasury Bill Secondary Market Rate, Discount Basis", "US", "daily", "percent"),
    ("usd_12m_rate", "market_rate", "fred", "DTB1YR",
     "1-Year Treasury Bill Secondary Market Rate, Discount Basis", "US", "daily", "percent"),
    ("eur_3m_rate", "market_rate", "ecb", "EST.B.EU000A2QQF32.CR",
     "Compounded euro short-term average rate, 3 months tenor, Daily - businessweek", "EU", "daily", "percent"),
    ("eur_6m_rate", "market_rate", "ecb", "EST.B.EU000A2QQF40.CR",
     "Compounded euro short-term average rate, 6 months tenor, Daily - businessweek", "EU", "daily", "percent"),
    ("eur_12m_rate", "market_rate", "ecb", "EST.B.EU000A2QQF57.CR",
     "Compounded euro short-term average rate, 12 months tenor, Daily - businessweek", "EU", "daily", "percent"),
    ("us_policy_rate", "policy_rate", "fred", "DFEDTARU",
     "Federal Funds Target Range - Upper Limit", "US", "daily", "percent"),
    ("us_cpi_headline", "inflation", "fred", "CPIAUCSL",
     "Consumer Price Index for All Urban Consumers: All Items in U.S. City Average", "US", "monthly", "index"),
    ("us_cpi_core", "inflation", "fred", "CPILFESL",
     "Consumer Price Index for All Urban Consumers: All Items Less Food and Energy in U.S. City Average", "US",
     "monthly", "index"),
    ("us_market_real_rate", "market_rate", "fred", "DFII10",
     "10-Year Treasury Inflation-Indexed Security, Constant Maturity", "US", "daily", "percent"),
    ("us_real_gdp", "growth", "fred", "GDPC1", "Real Gross Domestic Product", "US", "quarterly", "level"),
    ("us_output_gap", "output_gap", "dbnomics", "USA.1.0.0.0.AVGDGP",
     "Gap between actual and potential gross domestic product at 2020 reference levels - United States", "US",
     "annual", "percent"),
    ("eu_policy_rate", "policy_rate", "ecb", "FM.D.U2.EUR.4F.KR.DFR.LEV", "ECB Deposit Facility Rate", "EU",
     "daily", "percent"),
    ("eu_hicp_headline", "inflation", "ecb", "HICP.M.U2.N.000000.4D0.ANR",
     "Harmonized Index of Consumer Prices: Total for Euro Area (20 Countries)", "EU", "monthly", "percent"),
    ("eu_hicp_core", "inflation", "ecb", "HICP.M.U2.N.XEF000.4D0.ANR",
     "HICP Inflation rate - Total excluding energy, food, alcohol and tobacco - Euro area", "EU", "monthly",
     "percent"),
    ("eu_market_real_rate", "market_rate", "ecb", "FM.M.U2.EUR.4F.BB.U2_10Y.YLD",
     "10-Year Government Bond Yield for Euro Area (19 Countries)", "EU", "monthly", "percent"),
    ("eu_real_gdp", "growth", "ecb", "MNA.Q.Y.I9.W2.S1.S1.B.B1GQ._Z._Z._Z.EUR.LR.N",
     "Real Gross Domestic Product for Euro Area (20 Countries)", "EU", "quarterly", "level"),
    ("eu_output_gap", "output_gap", "dbnomics", "EA20.1.0.0.0.AVGDGP",
     "Gap between actual and potential gross domestic product at 2020 reference levels - Euro area (20 countries)",
     "EU", "annual", "percent"),
]
# Substitute series, all from one provider.
# series_id -> provider's id, frequency, unit, label (null keeps the first label)
FALLBACK_PROVIDER = "fred"
FALLBACKS = {
    "eurusd_spot_daily": ("DEXUSEU", "daily", "usd_per_eur", None),
    "eurusd_spot_monthly": ("DEXUSEU", "daily", "usd_per_eur", None),
    "us_output_gap": ("USALORSGPRTSTSAM", "monthly", "ratio_to_trend_index",
                      "Composite Leading Indicators: Reference Series (GDP) Ratio to Trend for United States"),
    "eu_policy_rate": ("ECBDFR", "daily", "percent", None),
    "eu_hicp_headline": ("CP00MI15EA20M086NEST", "monthly", "index", None),
    "eu_hicp_core": ("00XEFDEZCCM086NEST", "monthly", "index", None),
    "eu_market_real_rate": ("IRLTLT01EZM156N", "monthly", "percent", None),
    "eu_real_gdp": ("CLV10MNACB1GQSCAEA20Q", "quarterly", "level", None),
    "eu_output_gap": ("EA19LORSGPRTSTSAM", "monthly", "ratio_to_trend_index",
                      "Leading Indicators OECD: Reference Series: Gross Domestic Product (GDP): Ratio to Trend for "
                      "the Euro Area (19 Countries)"),
}
# Series fetched together.
SERIES_GROUPS = {
    "us_macro": ["us_policy_rate", "us_cpi_headline", "us_cpi_core", "us_market_real_rate", "us_real_gdp",
                 "us_output_gap"],
    "eu_macro": ["eu_policy_rate", "eu_hicp_headline", "eu_hicp_core", "eu_market_real_rate", "eu_real_gdp",
                 "eu_output_gap"],
    "currency": ["eurusd_spot_daily", "eurusd_spot_monthly", "us_cpi_index", "ea_cpi_index", "eur_3m_rate",
                 "eur_6m_rate", "eur_12m_rate", "usd_3m_rate", "usd_6m_rate", "usd_12m_rate"],
}
# Which series plays which role in a region. The last flag marks a nominal yield that
# becomes a real rate only after headline inflation is taken off.
ROLES = [
    ("EU", "policy", "eu_policy_rate", False),
    ("EU", "headline", "eu_hicp_headline", False),
    ("EU", "core", "eu_hicp_core", False),
    ("EU", "market_real_rate", "eu_market_real_rate", True),
    ("EU", "gdp", "eu_real_gdp", False),
    ("EU", "output_gap", "eu_output_gap", False),
    ("US", "policy", "us_policy_rate", False),
    ("US", "headline", "us_cpi_headline", False),
    ("US", "core", "us_cpi_core", False),
    ("US", "market_real_rate", "us_market_real_rate", False),
    ("US", "gdp", "us_real_gdp", False),
    ("US", "output_gap", "us_output_gap", False),
]
# The currency pair and its tenors. Home is the quote currency (USD per EUR).
PAIRS = [("eurusd", "eurusd_spot_monthly", "us_cpi_index", "ea_cpi_index")]
TENORS = [
    ("eurusd", "3M", 0.25, "eurusd_spot_daily", "eur_3m_rate", "usd_3m_rate"),
    ("eurusd", "6M", 0.5, "eurusd_spot_daily", "eur_6m_rate", "usd_6m_rate"),
    ("eurusd", "12M", 1.0, "eurusd_spot_daily", "eur_12m_rate", "usd_12m_rate"),
]
# Equity markets and the funds that measure them (id, region, market, symbol, fund).
MARKETS = [
    ("us_total_market", "US", "United States Total Market", "VTI.US", "Vanguard Total Stock Market ETF"),
    ("us_large_cap", "US", "United States Large Cap", "SPY.US", "SPDR S&P 500 ETF Trust"),
    ("europe_developed", "Europe", "Europe Developed", "VGK.US", "Vanguard FTSE Europe ETF"),
    ("germany_large_cap", "Germany", "Germany Large Cap", "EWG.US", "iShares MSCI Germany ETF"),
    ("france_large_cap", "France", "France Large Cap", "EWQ.US", "iShares MSCI France ETF"),
    ("uk_large_cap", "United Kingdom", "United Kingdom Large Cap", "EWU.US", "iShares MSCI United Kingdom ETF"),
    ("finland_large_cap", "Finland", "Finland Large Cap", "EFNL.US", "iShares MSCI Finland ETF"),
    ("sweden_large_cap", "Sweden", "Sweden Large Cap", "EWD.US", "iShares MSCI Sweden ETF"),
    ("norway_large_cap", "Norway", "Norway Large Cap", "ENOR.US", "iShares MSCI Norway ETF"),
    ("denmark_large_cap", "Denmark", "Denmark Large Cap", "EDEN.US", "iShares MSCI Denmark ETF"),
    ("china_large_cap", "China", "China Large Cap", "MCHI.US", "iShares MSCI China ETF"),
    ("japan_large_cap", "Japan", "Japan Large Cap", "EWJ.US", "iShares MSCI Japan ETF"),
    ("south_korea_large_cap", "South Korea", "South Korea Large Cap", "EWY.US", "iShares MSCI South Korea ETF"),
    ("taiwan_large_cap", "Taiwan", "Taiwan Large Cap", "EWT.US", "iShares MSCI Taiwan ETF"),
]
MARKET_TYPE, MARKET_PROVIDER = "etf", "yahoo_finance"
# Seed observations.
SEEDS = [("cpi_yoy", 2.9, date(2026, 5, 1)), ("fed_funds_upper", 5.50, date(2026, 5, 1))]


def local_frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """Small driver-side rows as a local relation, whose size the optimizer knows exactly."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(column), type=field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed frame with no rows: what a reader gets before anything has been loaded."""
    return local_frame(spark, [], schema)


def source_address(provider: str, external_id: str) -> str:
    """Public page of a provider's series."""
    if provider == "ecb":
        return f"https://data.ecb.europa.eu/data/datasets/{external_id.split('.')[0]}/{external_id}"
    if provider == "dbnomics":
        return f"https://db.nomics.world/AMECO/{external_id.split('.')[-1]}/{external_id}"
    return f"https://fred.stlouisfed.org/series/{external_id}"


def series_dim(spark: SparkSession, group: str | None = None) -> DataFrame:
    """Series catalog, whole or one fetch group."""
    rows = []
    for series_id, category, provider, external_id, label, region, frequency, unit in SERIES:
        if group is not None and series_id not in SERIES_GROUPS[group]:
            continue
        fallback = (None,) * 6
        if series_id in FALLBACKS:
            other_id, other_frequency, other_unit, other_label = FALLBACKS[series_id]
            fallback = (FALLBACK_PROVIDER, other_id, other_frequency, other_unit,
                        source_address(FALLBACK_PROVIDER, other_id), other_label)
        rows.append((series_id, category, provider, external_id, label, region, frequency, unit,
                     source_address(provider, external_id)) + fallback)
    return local_frame(spark, rows, schemas.SERIES_DIM)


def series_definitions(spark: SparkSession, series_ids: list[str]) -> DataFrame:
    """Catalog rows of the given series; an unknown one is an error."""
    unknown = sorted(set(series_ids) - {row[0] for row in SERIES})
    if unknown:
        raise KeyError(f"unknown series: {unknown}")
    return series_dim(spark).where(F.col("series_id").isin(list(series_ids)))


def region_roles(spark: SparkSession) -> DataFrame:
    return local_frame(spark, ROLES, schemas.REGION_ROLES)


def pair_dim(spark: SparkSession) -> DataFrame:
    return local_frame(spark, PAIRS, schemas.PAIR_DIM)


def tenor_dim(spark: SparkSession) -> DataFrame:
    return local_frame(spark, TENORS, schemas.TENOR_DIM)


def market_dim(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [(no, *row, MARKET_TYPE, MARKET_PROVIDER) for no, row in enumerate(MARKETS)], schemas.MARKET_DIM)


def seed_rows(spark: SparkSession) -> DataFrame:
    return local_frame(spark, SEEDS, schemas.SEED)
