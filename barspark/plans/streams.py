"""Queries of sources, sinks and streams; streams drain what is there and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import edge as G
from ..session import shared_folder, stored
from ..operators import decide as D
from ..sources import files as IO
from ..sources import fixtures as X
from ..streaming import streams as R
from .bars import hourly, ntz
from .calib import ordered_outcomes
from .decide import SI, inputs, ledger_rows
from .edge import STATS, stats
from .registry import query
from .train import decision_rows


def scratch(spark, name):
    """A folder for one run, under the shared checkpoint folder where one is set."""
    return f"{shared_folder(spark)}/runs/{name}-{uuid.uuid4().hex[:12]}"


def drain(df, spark, name, mode="append"):
    """Run a stream over everything available and read the result."""
    out, ck = scratch(spark, name), scratch(spark, name + "-ck")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_of(spark, df, name, parts=3):
    """``df`` as a file stream: one file per time range, written oldest first, one file per trigger.

    The file source reads in order of modification, so the ranges are written one after the other.
    """
    path = scratch(spark, name)
    sec = F.unix_seconds("ts")
    lo, hi = df.agg(F.min(sec), F.max(sec)).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        part = df.filter((sec >= lo + i * step) & (sec < lo + (i + 1) * step))
        part.coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ticks(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet")
    raw = spark.readStream.schema(t.schema).parquet(f"{sf}/events*.parquet")
    return raw.select(
        F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("price"), F.col("value").alias("size"),
    )




@query(
    "src_parse_ts",
    """WITH d AS (SELECT event_id, date_trunc('second', ts) AS t, CAST(ts AS DATE)::TIMESTAMP AS day FROM events)
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN t WHEN 4 THEN day WHEN 5 THEN day
      WHEN 6 THEN CASE WHEN day(day) <= 12 THEN make_date(year(day), day(day), month(day))::TIMESTAMP ELSE day END END AS parsed FROM d""",
)
def src_parse_ts(spark, sf):
    ts = F.col("ts").cast("timestamp")
    fm = lambda f: F.date_format(ts, f)
    k = F.col("event_id") % 8
    raw = (
        F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, (F.unix_seconds(ts) * 1000).cast("string"))
        .when(k == 2, fm("yyyy-MM-dd HH:mm:ss")).when(k == 3, fm("yyyy-MM-dd'T'HH:mm:ss")).when(k == 4, fm("yyyy-MM-dd"))
        .when(k == 5, fm("dd/MM/yyyy")).when(k == 6, fm("MM/dd/yyyy")).otherwise("n/a")
    )
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", raw.alias("raw"))
    return e.select("event_id", IO.parse_ts(F.col("raw")).cast("timestamp_ntz").alias("parsed"))


@query("src_bars_csv")
def src_bars_csv(spark, sf):
    path = scratch(spark, "csv")
    b = hourly(spark, sf)
    broken = F.col("bar_index") % 97 == 5
    out = b.select(
        F.col("instrument").alias("Instrument"), F.unix_seconds("ts").alias("TIME"), F.col("open").alias("O"),
        F.when(broken, "bad").otherwise(F.col("high").cast("string")).alias("High"), F.col("low").alias("l"),
        F.col("close").alias("Adj Close"), F.when(F.col("bar_index") % 2 == 0, F.col("volume")).alias("Vol"),
    )
    out.write.option("header", True).csv(path)
    good, bad = IO.read_bars_csv(spark, path)
    return good.groupBy("instrument").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.min(ntz()).alias("first_ts")).join(
        bad.groupBy("instrument").agg(F.count(F.lit(1)).alias("rejected")), "instrument", "left"
    )


@query("src_bars_json")
def src_bars_json(spark, sf):
    path = scratch(spark, "json")
    b = hourly(spark, sf).withColumn("chunk", F.floor(F.col("bar_index") / 500))
    col = lambda k: F.transform(F.col("r"), lambda e: e[k]).alias(k)
    row = F.struct("bar_index", F.unix_seconds("ts").alias("timestamp"), "open", "high", "low", F.when(F.col("bar_index") % 50 > 0, F.col("close")).alias("close"), "volume")
    arr = b.groupBy(F.col("instrument").alias("symbol"), "chunk").agg(F.sort_array(F.collect_list(row)).alias("r"))
    arr.select("symbol", *[col(k) for k in ("timestamp", "open", "high", "low", "close", "volume")]).write.json(path)
    return IO.read_bars_json(spark, path).select("instrument", ntz(), "open", "high", "low", "close", "volume")


@query(
    "sink_journal",
    f"""{SI}, a AS (SELECT instrument, bar_index, swept_low > 0 AND valid AS act FROM si), l AS (SELECT *, max(CASE WHEN act THEN bar_index END) OVER (PARTITION BY instrument ORDER BY bar_index) AS at_ FROM a)
    SELECT instrument, bar_index, act AS actionable FROM l WHERE act OR (bar_index - coalesce(at_, -1)) % 100 = 0""",
)
def sink_journal(spark, sf):
    path = scratch(spark, "journal")
    x = inputs(spark, sf)
    rows = IO.journal_rows(x.select("instrument", "bar_index", "close", "swept_low", "valid"), (F.col("swept_low") > 0) & F.col("valid"))
    IO.write_journal(path, decision=rows, lifecycle=spark.range(1).select(F.lit("start").alias("event")))
    back = spark.read.schema("kind string, instrument string, bar_index long, actionable boolean").json(path)
    return back.filter("kind = 'decision'").select("instrument", "bar_index", "actionable")


@query("sink_edge_state", f"{STATS} SELECT level, regime, setup, bucket, round(n_w, 6) AS n_w, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM es")
def sink_edge_state(spark, sf):
    path = scratch(spark, "edge")
    IO.save_edge_state(stats(spark, sf), path, 3)
    x = IO.load_edge_state(spark, path, 3)
    return x.select("level", *G.CELL, *[F.round(c, 6).alias(c) for c in ("n_w", "s1", "s2")])


@query("sink_model")
def sink_model(spark, sf):
    from ..operators import calib as C

    path = scratch(spark, "model")
    model = IO.frozen_model(stats(spark, sf), C.isotonic_fit(X.prob_pairs(spark, sf)))
    IO.write_model(model, path)
    return spark.read.schema(model.schema).json(path).select(F.size("leaves").alias("leaves"), F.size("knots").alias("knots"), "schema_version", F.to_json("gate").alias("gate"))


# --------------------------------------------------------------------------- #


@query("stream_bars")
def stream_bars(spark, sf):
    return drain(R.stream_bars(ticks(spark, sf)), spark, "bars").withColumn("ts", ntz())


@query("stream_dedup")
def stream_dedup(spark, sf):
    b = hourly(spark, sf).select("instrument", "ts", "close", "bar_index")
    twice = b.unionByName(b.filter("bar_index % 3 = 0"))
    return drain(R.stream_dedup(stream_of(spark, twice, "dup", 1)), spark, "dedup").withColumn("ts", ntz())


@query("stream_late")
def stream_late(spark, sf):
    return drain(R.stream_late(stream_of(spark, hourly(spark, sf), "late")), spark, "late-out")


@query("stream_sliding")
def stream_sliding(spark, sf):
    return drain(R.stream_sliding(ticks(spark, sf)), spark, "sliding").withColumns({"start": ntz("start"), "end": ntz("end")})


@query("stream_session")
def stream_session(spark, sf):
    return drain(R.stream_session(ticks(spark, sf)), spark, "session").withColumns({"start": ntz("start"), "end": ntz("end")})


@query("stream_features")
def stream_features(spark, sf):
    b = X.lineitem_bars(spark, sf)
    fs = R.FeatureStream(scratch(spark, "fs"))
    fs.start(stream_of(spark, b, "fbars", 2), scratch(spark, "fs-ck"), availableNow=True).awaitTermination()
    return spark.read.parquet(f"{fs.path}/features").drop("ts", "epoch")


@query("stream_ledger")
def stream_ledger(spark, sf):
    rows = ledger_rows(spark, sf).withColumn("ts", F.timestamp_seconds("bar_index"))
    return drain(R.stream_decisions(stream_of(spark, rows, "dec")), spark, "dec-out")


@query("stream_decisions")
def stream_decisions(spark, sf):
    """The learning chain on the real feature table, ten batches: book, map and health level pass from one to the next."""
    events = D.decision_events(decision_rows(spark, sf)).withColumn("ts", F.timestamp_seconds("seq"))
    return drain(R.stream_chain(stream_of(spark, events, "chain", 10)), spark, "chain-out")


@query("stream_health")
def stream_health(spark, sf):
    o = ordered_outcomes(spark, sf).withColumn("ts", F.timestamp_seconds("pos"))
    hs = R.HealthStream(scratch(spark, "hs"))
    src = stream_of(spark, stored(lambda: o, spark, X._name("outcomes", sf)), "hout", 2).select("instrument", "pos", "p", "y")
    hs.start(src, scratch(spark, "hs-ck"), availableNow=True).awaitTermination()
    return spark.read.parquet(f"{hs.path}/health").select("instrument", "epoch", "n", "brier", "ece", "skill", "level")
