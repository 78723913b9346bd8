"""Streaming results equal batch results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import bars as B
from barspark.operators import decide as D
from barspark.plans import load
from barspark.sources import files as IO
from tests.conftest import SF

load()
from barspark.plans import streams as PS  # noqa: E402
from barspark.plans.bars import hourly  # noqa: E402
from barspark.plans.decide import ledger_rows  # noqa: E402


def test_stream_decisions_equal_batch(spark):
    a = PS.stream_ledger(spark, SF).orderBy("instrument", "bar_index").toPandas()
    b = D.position_ledger(ledger_rows(spark, SF)).orderBy("instrument", "bar_index").toPandas()
    assert (a["action"] == b["action"]).all() and (a["reason"].fillna("") == b["reason"].fillna("")).all()
    np.testing.assert_allclose(a["growth"], b["growth"], rtol=1e-12)


def test_stream_validation_equals_batch(spark):
    a = PS.stream_late(spark, SF).orderBy("instrument", "bar_index").toPandas()
    b = B.bar_validate(hourly(spark, SF)).orderBy("instrument", "bar_index").toPandas()
    assert (a["fatal"] == b["fatal"]).all() and all(list(x) == list(y) for x, y in zip(a["issues"], b["issues"]))


def test_stream_features_equal_batch(spark, features):
    a = PS.stream_features(spark, SF).orderBy("instrument", "bar_index").toPandas()
    b = features.orderBy("instrument", "bar_index").toPandas()
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c].astype(float), rtol=1e-7, atol=1e-10, err_msg=c)


def test_closed_bars_only_and_dedup(spark):
    a = PS.stream_bars(spark, SF)
    b = hourly(spark, SF)
    assert 0 < a.count() < b.count()
    assert a.join(b.select("instrument", F.col("ts").cast("timestamp_ntz").alias("ts"), "close"), ["instrument", "ts", "close"]).count() == a.count()
    assert PS.stream_dedup(spark, SF).count() == b.count()


def test_bad_bars(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("X", 0, 0, 100.0, 101.0, 99.0, 100.0, 5.0, False), ("X", 1, 60, 100.0, 101.0, 99.0, 100.0, 5.0, False),
        ("X", 2, 60, 100.0, 101.0, 99.0, 100.0, 5.0, False), ("X", 3, 30, 100.0, 101.0, 99.0, 100.0, 5.0, False),
        ("X", 4, 120, 100.0, inf, 99.0, 100.0, 5.0, False), ("X", 5, 180, 100.0, 101.0, 99.0, 100.0, nan, False),
        ("X", 6, 240, 100.0, 101.0, 99.0, 100.0, 5.0, True), ("X", 7, 300, 300.0, 301.0, 299.0, 300.0, 5.0, False),
        ("X", 8, 360, 100.0, 100.0, 100.0, 100.0, 0.0, False), ("X", 9, 90000, 100.0, 101.0, 99.0, 100.0, 5.0, False),
    ]
    x = spark.createDataFrame(rows, "instrument string, bar_index long, s long, open double, high double, low double, close double, volume double, partial boolean")
    x = x.withColumn("ts", F.timestamp_seconds("s"))
    got = {r["bar_index"]: list(r["issues"]) for r in B.bar_validate(x).collect()}
    assert got == {
        0: [], 1: [], 2: ["duplicate_timestamp"], 3: ["time_reversal"], 4: ["non_finite"], 5: ["non_finite"], 6: ["partial_bar"],
        7: ["probable_split"], 8: ["zero_volume", "zero_range"], 9: ["large_time_gap"],
    }
    assert B.clean_bars(x).count() == 4


def test_csv_aliases_and_rejects(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Date,O,HIGH,low,Adj Close,Vol\n2024-01-02,1,2,0.5,1.5,\n2024-01-03,1,2,0.5,bad,3\n1704326400000,1,2,0.5,1.5,7\n2024-01-05,1,0.9,0.5,1.5,3\n")
    good, bad = IO.read_bars_csv(spark, str(p), "X")
    assert [r["volume"] for r in good.orderBy("ts").collect()] == [0.0, 7.0]
    assert sorted(r["reason"] for r in bad.collect()) == ["inconsistent bar", "unparsable number"]
    (tmp_path / "y.csv").write_text("Date,O,HIGH,low\n2024-01-02,1,2,0.5\n")
    with pytest.raises(ValueError):
        IO.read_bars_csv(spark, str(tmp_path / "y.csv"), "X")
