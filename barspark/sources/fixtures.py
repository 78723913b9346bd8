"""Bar tables derived from the driver's parquet (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import hash_uniform, sql_uniform
from ..operators.sequence import framed, index_bars, running, w_block
from ..session import checkpoint, stored


# Prices are kept to six decimals so that both engines start from equal doubles;
# the offset keeps short decimal products off the rounding ties.
OFF_TIE = 3.14159e-8


def _name(table_name: str, sf_dir: str) -> str:
    return table_name + "-" + sf_dir.strip("/").replace("/", "_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(daily: DataFrame) -> DataFrame:
    """Aggregated rows (d, t, volume, trades, delta) to consistent OHLC bars."""
    daily = checkpoint(daily)  # read three times below
    mean = daily.groupBy("instrument").agg(F.avg("d").alias("md"), F.avg("t").alias("mt"))
    x = index_bars(daily).join(mean, "instrument")
    x = running(x, {"cum": ("sum", F.col("d") - F.col("md"))})
    x = x.withColumn("close", F.round(100.0 * F.exp(0.4 * F.col("cum")), 6))
    x = framed(x, 1, {"pc": F.lag("close").over(w_block())})
    x = x.withColumn(
        "open", F.coalesce(F.round(F.col("pc") * F.exp(0.1 * (F.col("t") - F.col("mt"))), 6), F.col("close"))
    )
    return x.select(
        "instrument",
        F.col("ts").cast("timestamp").alias("ts"),
        "bar_index",
        "open",
        F.round(F.greatest("open", "close") * (1.0 + 0.05 * F.col("t")) + OFF_TIE, 6).alias("high"),
        F.round(F.least("open", "close") * (1.0 - 0.05 * F.col("d")) + OFF_TIE, 6).alias("low"),
        "close",
        "volume",
        "trades",
        "delta",
        F.lit(False).alias("partial"),
    )


def _daily(spark: SparkSession, sf_dir: str, instrument) -> DataFrame:
    q = F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(instrument.alias("instrument"), F.col("l_shipdate").alias("ts"))
        .agg(
            F.avg("l_discount").alias("d"),
            F.avg("l_tax").alias("t"),
            F.sum(q).alias("volume"),
            F.count(F.lit(1)).cast("double").alias("trades"),
            F.sum(F.when(F.col("l_linenumber") % 2 == 1, q).otherwise(-q)).alias("delta"),
        )
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """six daily series keyed by return flag and line status."""
    make = lambda: _priced(_daily(spark, sf_dir, F.concat("l_returnflag", "l_linestatus")))
    return stored(make, spark, _name("lineitem_bars", sf_dir))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1b: the same formulas with one series per supplier."""
    make = lambda: _priced(_daily(spark, sf_dir, F.col("l_suppkey").cast("string")))
    return stored(make, spark, _name("supplier_bars", sf_dir))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks; the parquet zone-less timestamps are read as UTC."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
        F.col("value").alias("size"),
    )


def exog(bars: DataFrame) -> DataFrame:
    """side feed, rows on even days of the month only."""
    day = F.dayofmonth("ts")
    return bars.filter(day % 2 == 0).select(
        "instrument",
        "ts",
        (1e-4 + 1e-5 * day).alias("spread"),
        (15.0 + 5.0 * F.sin(F.dayofyear("ts") / 58.0)).alias("implied_vol"),
        (F.dayofmonth(F.last_day("ts")) - day + 1).cast("double").alias("days_to_event"),
    )


def prob_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hashed probabilities against the 0/1 quality label."""
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.round(hash_uniform("p", F.col("doc_id")), 6).alias("p"),
        F.col("quality").cast("double").alias("y"),
    )


# DuckDB text of the same tables, for the oracle.

BARS = """raw AS (
 SELECT {inst} AS instrument, l_shipdate AS ts, avg(l_discount) d, avg(l_tax) t, sum(l_quantity) volume,
  CAST(count(*) AS DOUBLE) trades, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE -l_quantity END) delta
 FROM lineitem GROUP BY 1, 2),
cen AS (SELECT *, avg(d) OVER (PARTITION BY instrument) md, avg(t) OVER (PARTITION BY instrument) mt FROM raw),
cl AS (SELECT *, round(100.0 * exp(0.4 * sum(d - md) OVER (PARTITION BY instrument ORDER BY ts)), 6) AS close,
  CAST(row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS BIGINT) bar_index FROM cen),
op AS (SELECT *, coalesce(round(lag(close) OVER (PARTITION BY instrument ORDER BY ts) * exp(0.1 * (t - mt)), 6), close) AS open FROM cl),
bars AS (SELECT instrument, ts, bar_index, open, round(greatest(open, close) * (1.0 + 0.05 * t) + 3.14159e-8, 6) high,
  round(least(open, close) * (1.0 - 0.05 * d) + 3.14159e-8, 6) low, close, volume, trades, delta FROM op)"""
LINEITEM_BARS = BARS.format(inst="l_returnflag || l_linestatus")

EXOG = """exog AS (SELECT instrument, ts, 1e-4 + 1e-5 * day(ts) spread, 15.0 + 5.0 * sin(dayofyear(ts) / 58.0) implied_vol,
  CAST(day(last_day(ts)) - day(ts) + 1 AS DOUBLE) days_to_event FROM bars WHERE day(ts) % 2 = 0)"""

PAIRS = f"pairs AS (SELECT doc_id, round({sql_uniform(chr(39) + 'p' + chr(39), 'doc_id')}, 6) p, CAST(quality AS DOUBLE) y FROM labels)"
