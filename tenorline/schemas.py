"""Table schemas and keys. A trailing ``!`` marks a column that is never null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "strings": T.ArrayType(T.StringType()),
}


def schema_of(*columns: str) -> T.StructType:
    fields = []
    for column in columns:
        name, kind = column.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


SERIES_DIM = schema_of(
    "series_id string!", "category string!", "provider string!", "external_series_id string!", "label string!",
    "region string!", "frequency string!", "unit string!", "source_url string!",
    "fallback_provider string", "fallback_external_series_id string", "fallback_frequency string",
    "fallback_unit string", "fallback_source_url string", "fallback_label string",
)
MARKET_DIM = schema_of(
    "market_no int!", "market_id string!", "region string!", "market_name string!", "measured_symbol string!",
    "measured_name string!", "measured_type string!", "provider string!",
)
REGION_ROLES = schema_of("region string!", "role string!", "series_id string!", "less_headline boolean!")
PAIR_DIM = schema_of("pair_key string!", "spot_series string!", "home_series string!", "foreign_series string!")
TENOR_DIM = schema_of(
    "pair_key string!", "tenor string!", "tenor_fraction double!", "spot_series string!", "base_series string!",
    "quote_series string!",
)
SEED = schema_of("series string!", "value double!", "as_of date!")

# Landed observations: one row per observation of a payload, series metadata and the fetch time alongside.
LANDED = schema_of(
    "series_id string!", "category string", "region string", "frequency string", "unit string", "provider string",
    "source_url string", "pos bigint", "date string", "value string", "fetched_at timestamp",
)

STAGING = schema_of(
    "series_id string!", "observation_date date!", "numeric_value double!", "category string", "region string",
    "frequency string", "unit string", "provider string", "source_url string", "is_valid boolean!",
    "is_imputed boolean!", "imputation_method string", "imputation_note string", "imputation_source_window string",
)
STAGING_DEFAULTS = {"is_valid": True, "is_imputed": False, "imputation_method": None, "imputation_note": None,
                    "imputation_source_window": None}
# Stored staging rows also tell the order of their fetch; rows that were estimated, or stored before, have none.
ORDERED_STAGING = T.StructType([*STAGING.fields, T.StructField("listed", T.LongType())])

RAW_OBSERVATIONS = schema_of("series_id string!", "observation_date date!", "value string!", "fetched_at timestamp!")
SERIES_METADATA = schema_of(
    "series_id string!", "key string!", "category string!", "provider string!", "external_series_id string!",
    "label string!", "region string!", "frequency string!", "unit string!", "source_url string!",
    "created_at timestamp!", "updated_at timestamp!",
)
CHECKPOINTS = schema_of("series_id string!", "last_successful_observation_date date", "last_run_at timestamp",
                        "last_run_status string!")
RUN_LOG = schema_of("run_id string!", "domain_key string!", "started_at timestamp!", "finished_at timestamp",
                    "status string!", "error_summary string")
TAYLOR = schema_of(
    "region string!", "as_of_date date", "policy_rate double", "inflation double", "inflation_target double!",
    "neutral_rate double!", "slack_proxy double!", "implied_rate double", "policy_gap double",
    "policy_series_key string", "policy_source_url string", "inflation_series_key string",
    "inflation_source_url string", "slack_source_note string!",
)
REFERENCE_METRICS = schema_of(
    "region string!", "headline_inflation double", "headline_inflation_as_of_date date", "core_inflation double",
    "core_inflation_as_of_date date", "policy_real_rate double", "policy_real_rate_as_of_date date",
    "market_real_rate double", "market_real_rate_as_of_date date", "output_gap double", "output_gap_as_of_date date",
    "gdp_growth_yoy_current double", "gdp_growth_yoy_historical_average double", "gdp_growth_yoy_gap double",
    "gdp_growth_yoy_as_of_date date", "gdp_growth_yoy_history_window string",
    "gdp_growth_qoq_annualized_current double", "gdp_growth_qoq_annualized_historical_average double",
    "gdp_growth_qoq_annualized_gap double", "gdp_growth_qoq_annualized_as_of_date date",
    "gdp_growth_qoq_annualized_history_window string", "headline_series_key string", "headline_source_url string",
    "core_series_key string", "core_source_url string", "market_real_rate_series_key string",
    "market_real_rate_source_url string", "output_gap_series_key string", "output_gap_source_url string",
    "gdp_series_key string", "gdp_source_url string", "policy_real_rate_note string!",
)
PPP_SNAPSHOTS = schema_of(
    "pair_key string!", "anchor_seq bigint!", "base_month date!", "anchor_kind string!", "anchor_statistic string!",
    "anchor_window_code string", "anchor_start_month date!", "anchor_end_month date!", "anchor_years_covered int!",
    "base_year string", "as_of_month date!", "base_spot double!", "current_spot double!", "implied_ppp double",
    "deviation_pct double", "trailing_12m_average_gap_pct double", "spot_series_key string!",
    "spot_source_url string", "home_cpi_series_key string!", "home_cpi_source_url string",
    "foreign_cpi_series_key string!", "foreign_cpi_source_url string",
)
PPP_PATHS = schema_of(
    "pair_key string!", "anchor_seq bigint!", "base_month date!", "anchor_kind string!", "anchor_statistic string!",
    "anchor_window_code string", "base_year string", "observation_month date!", "actual_spot double!",
    "implied_ppp double", "has_imputed_inputs boolean!", "imputation_note string",
)
IRP_SNAPSHOTS = schema_of(
    "pair_key string!", "as_of_date date!", "tenor string!", "spot double!", "base_rate double!",
    "quote_rate double!", "rate_spread double!", "cip_implied_forward double", "uip_implied_move_pct double!",
    "uip_implied_spot double!", "spot_series_key string!", "spot_source_url string", "base_rate_series_key string!",
    "base_rate_source_url string", "quote_rate_series_key string!", "quote_rate_source_url string",
)
AVAILABILITY = schema_of("pair_key string!", "section_key string!", "item_key string!", "status string!",
                         "detail string!", "as_of_date date")
EQUITY_PAYLOADS = schema_of("provider string!", "external_symbol string!", "fetched_at timestamp!",
                            "payload_json string!")
EQUITY_SNAPSHOTS = schema_of(
    "market_id string!", "region string!", "market_name string!", "measured_symbol string!", "measured_name string!",
    "measured_type string!", "provider string!", "source_url string!", "as_of date!", "trailing_pe double",
    "price_to_book double", "price_to_sales double", "price_to_cash_flow double", "dividend_yield_pct double",
    "price_to_free_cash_flow double", "price_to_cash_flow_method string!", "price_to_free_cash_flow_method string!",
    "missing_fields strings!",
)


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    keys: tuple[str, ...]


TABLES = {
    "series_metadata": Table(SERIES_METADATA, ("series_id",)),
    "raw_observations": Table(RAW_OBSERVATIONS, ("series_id", "observation_date")),
    "staging_observations": Table(STAGING, ("series_id", "observation_date")),
    "series_checkpoints": Table(CHECKPOINTS, ("series_id",)),
    "pipeline_runs": Table(RUN_LOG, ("run_id",)),
    "taylor_rule_inputs": Table(TAYLOR, ("region", "as_of_date")),
    "macro_reference_metrics": Table(REFERENCE_METRICS, ("region",)),
    # The window code is not part of these two keys: windows that start in the same month share a key.
    "currency_ppp_snapshots": Table(
        PPP_SNAPSHOTS, ("pair_key", "base_month", "anchor_kind", "anchor_statistic", "as_of_month")),
    "currency_ppp_paths": Table(
        PPP_PATHS, ("pair_key", "base_month", "anchor_kind", "anchor_statistic", "observation_month")),
    "currency_irp_snapshots": Table(IRP_SNAPSHOTS, ("pair_key", "as_of_date", "tenor")),
    "currency_data_availability": Table(AVAILABILITY, ("pair_key", "section_key", "item_key")),
    "equity_payloads": Table(EQUITY_PAYLOADS, ("provider", "external_symbol", "fetched_at")),
    "equity_market_valuation_snapshot": Table(EQUITY_SNAPSHOTS, ("market_id", "as_of")),
    "macro_series": Table(SEED, ()),
}


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project onto a schema in its column order; absent columns take their default or null."""
    defaults = defaults or {}
    present = set(df.columns)
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in present else F.lit(defaults.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def conform_staging(df: DataFrame) -> DataFrame:
    """Staging rows from older layouts: lineage columns are filled with their defaults."""
    return conform(df, STAGING, STAGING_DEFAULTS)
