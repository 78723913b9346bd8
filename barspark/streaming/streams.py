"""Structured Streaming forms: closed bars, dedup, windows, keyed recursions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives off-heap and is checkpointed, so a lost executor replays nothing else."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Closed bars only: a window is emitted once the watermark has passed its end."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.sum("size").alias("volume"),
            F.count(F.lit(1)).cast("double").alias("trades"),
        )
        .select("instrument", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume", "trades")
    )


def stream_dedup(bars: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A repeated (instrument, ts) inside the watermark is dropped."""
    return bars.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["instrument", "ts"])


def stream_sliding(ticks: DataFrame, width: str = "4 hours", slide: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Overlapping activity and volatility windows."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument", F.window("ts", width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.stddev_samp("price").alias("sd"))
        .select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume", "sd")
    )


def stream_session(ticks: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions that end after a gap."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
        .select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")
    )


Kernel = Callable[[dict | None, pd.DataFrame], tuple[dict, pd.DataFrame]]


class KeyedFold(StatefulProcessor):
    """A batch kernel run per key over micro-batches, its state one JSON string."""

    def __init__(self, kernel: Kernel, order: str):
        self.kernel, self.order = kernel, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = json.loads(self.state.get()[0]) if self.state.exists() else None
        # one key's rows of one trigger; the trigger's size bounds them
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        nxt, out = self.kernel(saved, pdf)
        self.state.update((json.dumps(nxt),))
        yield out

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, kernel: Kernel, schema: str, order: str = "bar_index", keys=("instrument",)) -> DataFrame:
    """The streaming form of ``operators.sequence.fold``: same kernel, same result."""
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=KeyedFold(kernel, order), outputStructType=schema, outputMode="append", timeMode="none"
    )


def stream_late(bars: DataFrame) -> DataFrame:
    """Every arriving bar with its issues; a bar at or behind the last accepted one is fatal.

    Needs ``bar_index`` as arrival order; state is the last accepted bar.
    """
    from ..kernels.data import validate

    rows = bars.select(
        "instrument", "bar_index", "partial", "open", "high", "low", "close", "volume", (F.unix_micros("ts") / 1e6).alias("sec")
    )
    return stream_fold(rows, validate(), "instrument string, bar_index long, issues array<string>, fatal boolean")


def stream_decisions(rows: DataFrame) -> DataFrame:
    """Per-bar signals to decisions and trades with the position machine as keyed state."""
    from ..kernels import ledger as K
    from ..operators.decide import LEDGER_IN

    step = K.ledger()
    cols = ["instrument", "bar_index", *K.OUT]

    def kernel(state, pdf: pd.DataFrame):
        nxt, got = step(state, pdf)
        return nxt, pdf.assign(**got)[cols]

    schema = "instrument string, bar_index long, " + ", ".join(f"{k} {t}" for k, t in K.OUT.items())
    return stream_fold(rows.select("instrument", "bar_index", *LEDGER_IN), kernel, schema)


def stream_chain(events: DataFrame, rules: dict | None = None, learn: bool = True) -> DataFrame:
    """The decision chain over a stream of accepted and rejected bars: book, calibration map and health level are the key's state,
    so each batch decides with what the batches before it taught, also after a restart."""
    from ..kernels import chain as N

    step = N.chain(rules, learn)
    cols = ["instrument", "seq", "bar_index", *N.OUT]

    def kernel(state, pdf: pd.DataFrame):
        nxt, got = step(state, pdf)
        return nxt, pdf.assign(**got)[cols]

    schema = "instrument string, seq long, bar_index long, " + ", ".join(f"{k} {t}" for k, t in N.OUT.items())
    return stream_fold(events.select("instrument", *N.IN), kernel, schema, order="seq")


class FeatureStream:
    """Bars to features by micro-batch: the batch operators on new bars plus a stored tail.

    ``tail`` keeps the last ``lookback`` bars per instrument, so a batch reads a
    bounded history whatever the age of the stream; the tables are versioned by
    epoch, so a replayed epoch rewrites its own output.  The sequential readings
    (trend filter, pivots, regime) resume from the fold states of the last epoch.
    """

    def __init__(self, path: str, block_lookback: int = 1024):
        self.path, self.lookback = path, block_lookback

    def _read(self, spark: SparkSession, name: str, epoch: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/{name}/epoch={epoch}") if epoch >= 0 else None

    def process(self, new: DataFrame, epoch: int) -> None:
        from ..kernels import series as S
        from ..operators import features as E
        from ..operators.drift import last_n
        from ..session import checkpoint

        spark = new.sparkSession
        new = checkpoint(new)
        tail = self._read(spark, "tail", epoch - 1)
        bars = checkpoint(new if tail is None else tail.unionByName(new))
        x = E.block_features(bars)
        first_new = new.groupBy("instrument").agg(F.min("bar_index").alias("_from"))
        x = x.join(first_new, "instrument").filter(F.col("bar_index") >= F.col("_from")).drop("_from")
        keep = x.columns
        steps = {"kalman": S.kalman(), "pivots": S.pivots(), "sweeps": S.sweeps(), "runs": S.run_asymmetry(), "regime": S.regime()}
        outs = E.TREND_OUT | E.PIVOT_OUT | E.SWEEP_OUT | E.RUN_OUT | E.REGIME_OUT
        start = self._read(spark, "state", epoch - 1)
        out, ends = E.as_fold(x, steps, keep, outs, start=start, end_states=True)
        E.nan_to_null(out).write.mode("overwrite").parquet(f"{self.path}/features/epoch={epoch}")
        quiet = None if start is None else start.join(ends, "instrument", "left_anti")
        states = ends if quiet is None else ends.unionByName(quiet)
        states.write.mode("overwrite").parquet(f"{self.path}/state/epoch={epoch}")
        last_n(bars, self.lookback, "bar_index").write.mode("overwrite").parquet(f"{self.path}/tail/epoch={epoch}")

    def start(self, bars: DataFrame, checkpoint_dir: str, **trigger):
        return bars.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint_dir).trigger(**trigger).start()


class HealthStream:
    """Outcomes to one health row per instrument and epoch, from the last 2000 outcomes."""

    def __init__(self, path: str, keep: int = 2000):
        self.path, self.keep = path, keep

    def process(self, new: DataFrame, epoch: int) -> None:
        from ..operators import drift as D
        from ..session import checkpoint

        spark = new.sparkSession
        old = spark.read.parquet(f"{self.path}/tail/epoch={epoch - 1}") if epoch > 0 else None
        rows = checkpoint(new if old is None else old.unionByName(new))
        D.health(rows, keep=self.keep).write.mode("overwrite").parquet(f"{self.path}/health/epoch={epoch}")
        D.last_n(rows, self.keep, "pos").write.mode("overwrite").parquet(f"{self.path}/tail/epoch={epoch}")

    def start(self, outcomes: DataFrame, checkpoint_dir: str, **trigger):
        return outcomes.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint_dir).trigger(**trigger).start()
