"""Observations derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenorline.functions.dates import month_number
from tenorline.schemas import conform_staging

FLAGS = ["A", "N", "R"]
TENOR_PRIORITIES = {"3M": "1-URGENT", "6M": "2-HIGH", "12M": "3-MEDIUM"}
TENOR_FRACTIONS = {"3M": 0.25, "6M": 0.5, "12M": 1.0}
NOTE = "carried estimate"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(x: str) -> Column:
    """Sum of two-decimal figures that does not depend on the order of the rows: whole cents in a long."""
    return F.sum(F.rint(F.col(x) * 100).cast("bigint")).cast("double") / 100


def exact_mean(x: str) -> Column:
    return exact_sum(x) / F.count("*")


def sql_sum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def sql_mean(x: str) -> str:
    return f"({sql_sum(x)} / COUNT(*))"


def sql_round(x: str, digits: int) -> str:
    return f"(CAST(printf('%.{digits}f', {x}) AS DOUBLE) + 0.0)"


def sql_month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


def sql_month_no(x: str) -> str:
    return f"(year({x}) * 12 + month({x}) - 1)"


# --- parts: one monthly index series per part, with holes and some imputed rows ---------------------------------

def part_months(spark: SparkSession, sf_dir: str, holes: bool = True) -> DataFrame:
    """Monthly prices of the parts; with ``holes`` a sixth of the months is missing, for operators on gaps."""
    monthly = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.trunc("l_shipdate", "MM").alias("observation_date")).agg(
        exact_mean("l_extendedprice").alias("numeric_value"))
    phase = month_number(F.col("observation_date")) + F.col("l_partkey")
    return conform_staging((monthly.where(phase % 6 != 0) if holes else monthly).select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("series_id"), "observation_date", "numeric_value",
        F.lit("inflation").alias("category"), F.lit("ALL").alias("region"), F.lit("monthly").alias("frequency"),
        F.lit("index").alias("unit"), F.lit("lineitem").alias("provider"), F.lit("table:lineitem").alias("source_url"),
        (phase % 17 == 0).alias("is_imputed")))


PART_MONTHS = f"""
    part_months AS (
        SELECT 'part-' || CAST(k AS VARCHAR) AS series_id, d, v, (m + k) % 17 = 0 AS is_imputed
        FROM (SELECT l_partkey AS k, {sql_month('l_shipdate')} AS d, {sql_month_no('l_shipdate')} AS m,
                     {sql_mean('l_extendedprice')} AS v
              FROM lineitem GROUP BY ALL)
        WHERE (m + k) % 6 <> 0)"""
ALL_PART_MONTHS = PART_MONTHS.replace("WHERE (m + k) % 6 <> 0)", ")")


# --- suppliers: one series per supplier, of monthly, quarterly, annual or daily frequency -----------------------

def supplier_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_suppkey") % 4
    day = (F.when(kind == 0, F.trunc("l_shipdate", "MM")).when(kind == 1, F.trunc("l_shipdate", "QUARTER"))
           .when(kind == 2, F.trunc("l_shipdate", "YEAR")).otherwise(F.to_date("l_shipdate")))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", day.alias("observation_date")).agg(
        exact_sum("l_quantity").alias("numeric_value"))
    kept = (month_number(F.col("observation_date")).cast("bigint") * 7 + F.col("l_suppkey")) % 5 != 0
    return conform_staging(sums.where(kept).select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("series_id"), "observation_date", "numeric_value",
        F.when(kind == 0, "monthly").when(kind == 1, "quarterly").when(kind == 2, "annual").otherwise("daily").alias("frequency"),
        F.lit("level").alias("unit"), F.lit("table:lineitem").alias("source_url")))


SUPPLIER_PERIODS = f"""
    supplier_periods AS (
        SELECT 'supplier-' || CAST(k AS VARCHAR) AS series_id, k, d, v,
               CASE k % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'annual' ELSE 'daily' END AS frequency,
               CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 12 END AS step
        FROM (SELECT l_suppkey AS k,
                     CAST(CASE l_suppkey % 4 WHEN 0 THEN date_trunc('month', l_shipdate)
                               WHEN 1 THEN date_trunc('quarter', l_shipdate)
                               WHEN 2 THEN date_trunc('year', l_shipdate) ELSE date_trunc('day', l_shipdate) END AS DATE) AS d,
                     {sql_sum('l_quantity')} AS v
              FROM lineitem GROUP BY ALL)
        WHERE ({sql_month_no('d')} * 7 + k) % 5 <> 0)"""


# --- customers: one daily series per customer -------------------------------------------------------------------

def customer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("observation_date")).agg(
        exact_sum("o_totalprice").alias("numeric_value"))
    return conform_staging(daily.select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("series_id"), "observation_date", "numeric_value",
        F.lit("daily").alias("frequency"), F.lit("level").alias("unit"), F.lit("table:orders").alias("source_url"),
        (F.dayofmonth("observation_date") != 31).alias("is_valid")))


CUSTOMER_DAYS = f"""
    customer_days AS (
        SELECT 'customer-' || CAST(k AS VARCHAR) AS series_id, d, v, day(d) <> 31 AS is_valid
        FROM (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, {sql_sum('o_totalprice')} AS v
              FROM orders GROUP BY ALL))"""


# --- policy roles: six monthly series per supplier, which stands for a region -----------------------------------

def region_key(k: Column) -> Column:
    return F.concat(F.lit("R"), k.cast("string"))


def role_url(k: Column, role: str) -> Column:
    name = F.concat(F.lit(f"/{role}-"), k.cast("string"))
    return (F.when(k % 4 == 0, F.concat(F.lit("https://fred.stlouisfed.org/series"), name))
            .when(k % 4 == 1, F.concat(F.lit("https://data.ecb.europa.eu/data"), name))
            .when(k % 4 == 2, F.concat(F.lit("https://db.nomics.world/AMECO"), name))
            .otherwise(F.concat(F.lit("https://Stats.example.org:8443/data"), name)))


def role_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan and one combining aggregate feed all six roles of every region."""
    k = F.col("l_suppkey")
    monthly = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("observation_date")).agg(
        exact_mean("l_discount").alias("discount"), exact_mean("l_tax").alias("tax"), exact_mean("l_extendedprice").alias("price"),
        exact_mean("l_quantity").alias("quantity"), exact_sum("l_quantity").alias("volume"))

    def role(name: str, value: Column, unit: Column) -> Column:
        return F.struct(F.concat(region_key(k), F.lit(f"-{name}")).alias("series_id"), value.alias("numeric_value"),
                        unit.alias("unit"), role_url(k, name).alias("source_url"))

    roles = F.array_compact(F.array(
        role("policy", F.col("discount") * 100, F.lit("percent")),
        role("headline", F.when(k % 2 == 0, F.col("price")).otherwise(F.col("tax") * 100), F.when(k % 2 == 0, "index").otherwise("percent")),
        role("core", F.when(k % 3 == 0, F.col("price") / F.col("quantity")).otherwise(F.col("tax") * 100 + 0.5), F.when(k % 3 == 0, "index").otherwise("percent")),
        role("market_real_rate", F.col("tax") * 100 + 1, F.lit("percent")),
        role("gdp", F.col("volume"), F.lit("level")),
        F.when(k % 10 != 7, role("output_gap", F.when(k % 4 == 0, F.col("quantity") + 75).otherwise(F.col("quantity") - 25),
                                 F.when(k % 4 == 0, "ratio_to_trend_index").otherwise("percent"))),
    ))
    return conform_staging(monthly.select("observation_date", F.inline(roles)).withColumn("frequency", F.lit("monthly")))


def role_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = region_key(F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(
        region.alias("region"), ((F.col("s_suppkey") % 2) == 0).alias("nominal"),
        F.explode(F.array(*[F.lit(r) for r in ("policy", "headline", "core", "market_real_rate", "gdp", "output_gap")])).alias("role"),
    ).select("region", "role", F.concat(F.col("region"), F.lit("-"), F.col("role")).alias("series_id"),
             (F.col("nominal") & (F.col("role") == "market_real_rate")).alias("less_headline"))


def _sql_url(role: str) -> str:
    return f"""CASE k % 4 WHEN 0 THEN 'https://fred.stlouisfed.org/series' WHEN 1 THEN 'https://data.ecb.europa.eu/data'
               WHEN 2 THEN 'https://db.nomics.world/AMECO' ELSE 'https://Stats.example.org:8443/data' END
               || '/{role}-' || CAST(k AS VARCHAR)"""


def _sql_role(role: str, value: str, unit: str, where: str = "TRUE") -> str:
    return f"""SELECT 'R' || CAST(k AS VARCHAR) AS region, k, '{role}' AS role, d, {value} AS v, {unit} AS unit,
                      {_sql_url(role)} AS url FROM supplier_months WHERE {where}"""


ROLE_OBSERVATIONS = f"""
    supplier_months AS (
        SELECT l_suppkey AS k, {sql_month('l_shipdate')} AS d, {sql_mean('l_discount')} AS discount,
               {sql_mean('l_tax')} AS tax, {sql_mean('l_extendedprice')} AS price, {sql_mean('l_quantity')} AS quantity,
               {sql_sum('l_quantity')} AS volume
        FROM lineitem GROUP BY ALL),
    role_obs AS (
        {_sql_role('policy', 'discount * 100', "'percent'")} UNION ALL
        {_sql_role('headline', 'CASE WHEN k % 2 = 0 THEN price ELSE tax * 100 END', "CASE WHEN k % 2 = 0 THEN 'index' ELSE 'percent' END")} UNION ALL
        {_sql_role('core', 'CASE WHEN k % 3 = 0 THEN price / quantity ELSE tax * 100 + 0.5 END', "CASE WHEN k % 3 = 0 THEN 'index' ELSE 'percent' END")} UNION ALL
        {_sql_role('market_real_rate', 'tax * 100 + 1', "'percent'")} UNION ALL
        {_sql_role('gdp', 'volume', "'level'")} UNION ALL
        {_sql_role('output_gap', 'CASE WHEN k % 4 = 0 THEN quantity + 75 ELSE quantity - 25 END', "CASE WHEN k % 4 = 0 THEN 'ratio_to_trend_index' ELSE 'percent' END", 'k % 10 <> 7')})"""


# --- currency pairs: one pair per supplier, sharing price indices -----------------------------------------------

def pair_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily spot per supplier, 25 home indices with holes and imputed rows, three foreign indices."""
    items = table(spark, sf_dir, "lineitem")
    day, month = F.to_date("l_shipdate"), F.trunc("l_shipdate", "MM")
    spot = items.groupBy(F.col("l_suppkey").alias("k"), day.alias("observation_date")).agg(
        (exact_mean("l_extendedprice") / 10000).alias("numeric_value")).select(
        F.concat(F.lit("spot-"), F.col("k").cast("string")).alias("series_id"), "observation_date", "numeric_value",
        F.lit("daily").alias("frequency"), (F.dayofmonth("observation_date") != 31).alias("is_valid"))
    home = items.groupBy((F.col("l_partkey") % 25).alias("k"), month.alias("observation_date")).agg(
        exact_mean("l_extendedprice").alias("numeric_value"))
    phase = month_number(F.col("observation_date")) + F.col("k")
    home = home.where((F.col("k") % 2 == 1) | (phase % 41 != 0)).select(
        F.concat(F.lit("home-"), F.col("k").cast("string")).alias("series_id"), "observation_date", "numeric_value",
        F.lit("monthly").alias("frequency"), (phase % 19 == 0).alias("is_imputed"),
        F.when(phase % 19 == 0, NOTE).alias("imputation_note"))
    foreign = items.groupBy("l_returnflag", month.alias("observation_date")).agg(exact_mean("l_extendedprice").alias("numeric_value")).select(
        F.concat(F.lit("foreign-"), F.col("l_returnflag")).alias("series_id"), "observation_date", "numeric_value", F.lit("monthly").alias("frequency"))
    frames = [conform_staging(df.withColumn("source_url", F.concat(F.lit("table:lineitem/"), F.col("series_id")))) for df in (spot, home, foreign)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def pair_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    flag = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("pair-"), k.cast("string")).alias("pair_key"), F.concat(F.lit("spot-"), k.cast("string")).alias("spot_series"),
        F.concat(F.lit("home-"), (k % 25).cast("string")).alias("home_series"), F.concat(F.lit("foreign-"), flag).alias("foreign_series"))


PAIR_MONTHS = f"""
    spot_days AS (
        SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, {sql_mean('l_extendedprice')} / 10000 AS v
        FROM lineitem GROUP BY ALL),
    spot_months AS (
        SELECT k, {sql_month_no('d')} AS m, arg_max(v, d) AS spot FROM spot_days WHERE day(d) <> 31 GROUP BY ALL),
    home_months AS (
        SELECT k, m, home, (m + k) % 19 = 0 AS imputed
        FROM (SELECT l_partkey % 25 AS k, {sql_month_no('l_shipdate')} AS m, {sql_mean('l_extendedprice')} AS home FROM lineitem GROUP BY ALL)
        WHERE k % 2 = 1 OR (m + k) % 41 <> 0),
    foreign_months AS (
        SELECT l_returnflag AS f, {sql_month_no('l_shipdate')} AS m, {sql_mean('l_extendedprice')} AS foreign_index FROM lineitem GROUP BY ALL),
    pair_months AS (
        SELECT 'pair-' || CAST(s.s_suppkey AS VARCHAR) AS pair_key, s.s_suppkey AS k, p.m, p.spot, h.home, f.foreign_index, h.imputed
        FROM supplier s
        JOIN spot_months p ON p.k = s.s_suppkey
        JOIN home_months h ON h.k = s.s_suppkey % 25 AND h.m = p.m
        JOIN foreign_months f ON f.f = CASE s.s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AND f.m = p.m)"""


# --- tenors: one pair per customer ------------------------------------------------------------------------------

def tenor_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot and base rates per customer, quote rates per priority shared by all customers."""
    orders = table(spark, sf_dir, "orders").withColumn("observation_date", F.to_date("o_orderdate"))
    customer = F.col("o_custkey").cast("string")
    spot = orders.groupBy("o_custkey", "observation_date").agg((exact_mean("o_totalprice") / 100000).alias("numeric_value")).select(
        F.concat(F.lit("spot-"), customer).alias("series_id"), "observation_date", "numeric_value")
    base = orders.groupBy("o_custkey", "o_orderpriority", "observation_date").agg((exact_mean("o_totalprice") / 100000).alias("numeric_value")).select(
        F.concat(F.lit("base-"), customer, F.lit("-"), F.col("o_orderpriority")).alias("series_id"), "observation_date", "numeric_value")
    quote = orders.groupBy("o_orderpriority", "observation_date").agg((exact_mean("o_totalprice") / 50000).alias("numeric_value")).select(
        F.concat(F.lit("quote-"), F.col("o_orderpriority")).alias("series_id"), "observation_date", "numeric_value")
    frames = [conform_staging(df.withColumn("source_url", F.concat(F.lit("table:orders/"), F.col("series_id")))) for df in (spot, base, quote)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def tenor_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("c_custkey").cast("string")
    tenors = F.inline(F.array(*[F.struct(F.lit(tenor).alias("tenor"), F.lit(TENOR_FRACTIONS[tenor]).alias("tenor_fraction"), F.lit(priority).alias("priority"))
                                for tenor, priority in TENOR_PRIORITIES.items()]))
    return table(spark, sf_dir, "customer").select("c_custkey", tenors).select(
        F.concat(F.lit("fx-"), customer).alias("pair_key"), "tenor", "tenor_fraction", F.concat(F.lit("spot-"), customer).alias("spot_series"),
        F.concat(F.lit("base-"), customer, F.lit("-"), F.col("priority")).alias("base_series"),
        F.concat(F.lit("quote-"), F.col("priority")).alias("quote_series"))


TENOR_ROWS = f"""
    tenors(tenor, fraction, priority) AS (VALUES {', '.join(f"('{t}', {TENOR_FRACTIONS[t]}::DOUBLE, '{p}')" for t, p in TENOR_PRIORITIES.items())}),
    spot_latest AS (
        SELECT k, max(d) AS d, arg_max(v, d) AS v FROM (
            SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, {sql_mean('o_totalprice')} / 100000 AS v FROM orders GROUP BY ALL) GROUP BY k),
    base_latest AS (
        SELECT k, p, max(d) AS d, arg_max(v, d) AS v FROM (
            SELECT o_custkey AS k, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, {sql_mean('o_totalprice')} / 100000 AS v FROM orders GROUP BY ALL) GROUP BY k, p),
    quote_latest AS (
        SELECT p, max(d) AS d, arg_max(v, d) AS v FROM (
            SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, {sql_mean('o_totalprice')} / 50000 AS v FROM orders GROUP BY ALL) GROUP BY p),
    tenor_rows AS (
        SELECT 'fx-' || CAST(c.c_custkey AS VARCHAR) AS pair_key, t.tenor, t.fraction, s.d AS spot_date, s.v AS spot,
               b.v AS base_rate, b.d AS base_date, q.v AS quote_rate, q.d AS quote_date,
               s.v IS NOT NULL AND b.v IS NOT NULL AND q.v IS NOT NULL AS complete
        FROM customer c CROSS JOIN tenors t
        LEFT JOIN spot_latest s ON s.k = c.c_custkey
        LEFT JOIN base_latest b ON b.k = c.c_custkey AND b.p = t.priority
        LEFT JOIN quote_latest q ON q.p = t.priority)"""
