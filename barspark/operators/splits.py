"""Purged cross-validation and walk-forward splits over label spans."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import number_trades


def cv_groups(labels: DataFrame, k: int) -> DataFrame:
    """``grp`` = which of ``k`` near-equal runs by entry; the first ones take the remainder."""
    x = number_trades(labels)
    n = labels.groupBy("instrument").agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, "instrument")
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (size + 1)
    g = F.when(F.col("k") < head, F.floor(F.col("k") / (size + 1))).otherwise(
        extra + F.floor((F.col("k") - head) / F.greatest(size, F.lit(1)))
    )
    return x.withColumn("grp", g.cast("long")).drop("_n", "k")


def group_spans(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("instrument", "grp").agg(
        F.min("bar_index").alias("start"), F.max("exit_index").alias("end"), F.count(F.lit(1)).alias("n")
    )


def _roles(grouped: DataFrame, bars: DataFrame, tests: Sequence[tuple[int, ...]], embargo: float, purge: bool) -> DataFrame:
    """One row per (label, split) with its role.

    The spans of an instrument's groups are one short array (k entries), so a
    label meets every split without a join per split.
    """
    spans = group_spans(grouped).groupBy("instrument").agg(
        F.map_from_entries(F.collect_list(F.struct("grp", F.struct("start", "end")))).alias("_sp")
    )
    nb = bars.groupBy("instrument").agg((F.max("bar_index") + 1).alias("_nb"))
    emb = F.ceil(F.lit(float(embargo)) * F.col("_nb"))
    x = grouped.join(spans, "instrument").join(nb, "instrument").withColumn("_emb", emb)
    table = F.array(*[F.struct(F.lit(i).alias("split_id"), F.array(*[F.lit(g).cast("long") for g in t]).alias("_t")) for i, t in enumerate(tests)])
    x = x.withColumn("_s", F.explode(table)).select("*", "_s.split_id", "_s._t").drop("_s")
    e, out = F.col("bar_index"), F.col("exit_index")

    def span(g):
        return F.element_at(F.col("_sp"), g)

    over = F.exists("_t", lambda g: (e <= span(g)["end"]) & (out >= span(g)["start"])) if purge else F.lit(False)
    held = F.exists("_t", lambda g: (e > span(g)["end"]) & (e <= span(g)["end"] + F.col("_emb")))
    role = (
        F.when(F.array_contains("_t", F.col("grp")), "test").when(over, "purged").when(held, "embargoed").otherwise("train")
    )
    return x.withColumn("role", role).select(
        "split_id", "instrument", "candidate_id", "grp", "role", "bar_index", "exit_index", F.col("_t").alias("test_groups")
    )


def purged_kfold(labels: DataFrame, bars: DataFrame, k: int = 5, embargo: float = 0.01, purge: bool = True) -> DataFrame:
    return _roles(cv_groups(labels, k), bars, [(g,) for g in range(k)], embargo, purge)


def combos(k: int, n_test: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(k), n_test))


def cpcv_splits(labels: DataFrame, bars: DataFrame, k: int = 8, n_test: int = 2, embargo: float = 0.01) -> DataFrame:
    return _roles(cv_groups(labels, k), bars, combos(k, n_test), embargo, True)


def cpcv_paths(spark: SparkSession, k: int = 8, n_test: int = 2) -> DataFrame:
    """Path of each (split, test group): the j-th split that tests g belongs to path j."""
    rows = [(i, g) for i, t in enumerate(combos(k, n_test)) for g in t]
    x = spark.createDataFrame(rows, "split_id long, grp long")
    w = Window.partitionBy("grp").orderBy("split_id")
    return x.withColumn("path", (F.row_number().over(w) - 1).cast("long"))


def leakage_report(roles: DataFrame, grouped: DataFrame) -> DataFrame:
    """Counts by role and two checks that must be zero: train rows that overlap a
    test span, and labels that are both train and test of a split."""
    keys = ["instrument", "split_id"]
    sizes = roles.groupBy(*keys).pivot("role", ["train", "test", "purged", "embargoed"]).count().fillna(0)
    spans = group_spans(grouped).select("instrument", F.col("grp").alias("_g"), "start", "end")
    train = roles.filter("role = 'train'")
    tests = roles.filter("role = 'test'").select(*keys, "grp").distinct().withColumnRenamed("grp", "_g")
    bounds = tests.join(spans, ["instrument", "_g"])
    bad = train.join(bounds, keys).filter((F.col("bar_index") <= F.col("end")) & (F.col("exit_index") >= F.col("start")))
    bad = bad.groupBy("instrument").agg(F.count(F.lit(1)).alias("overlaps"))
    both = train.join(roles.filter("role = 'test'").select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_semi")
    both = both.groupBy("instrument").agg(F.count(F.lit(1)).alias("duplicates"))
    n = grouped.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_samples"))
    a = sizes.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n_splits"), F.sum("purged").alias("purged_total"),
        F.sum("embargoed").alias("embargoed_total"), F.avg("train").alias("_tr"),
    )
    x = a.join(n, "instrument").join(bad, "instrument", "left").join(both, "instrument", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return x.select(
        "instrument", "n_splits", "n_samples", "purged_total", "embargoed_total",
        z("overlaps").alias("overlap_violations"), z("duplicates").alias("duplicate_violations"),
        (F.col("_tr") / F.col("n_samples")).alias("mean_train_fraction"),
        ((F.col("purged_total") + F.col("embargoed_total")) / (F.col("n_splits") * F.col("n_samples"))).alias("dropped_fraction"),
        ((z("overlaps") == 0) & (z("duplicates") == 0)).alias("ok"),
    )


# --------------------------------------------------------------------------- #
# walk-forward


def _lengths(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg((F.max("bar_index") + 1).alias("n"))


def anchored_folds(bars: DataFrame, n_splits: int, min_train: int, embargo: int = 0) -> DataFrame:
    """Expanding train, near-equal test runs; edges round half to even."""
    if not 0 <= embargo < min_train:
        raise ValueError("min_train must exceed embargo")
    n = _lengths(bars).filter(F.col("n") - min_train >= n_splits)
    step = (F.col("n") - min_train) / float(n_splits)
    edges = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_splits)), lambda i: F.bround(min_train + i * step).cast("long")))
    x = n.withColumn("_e", edges).select("instrument", "_e", F.posexplode(F.slice("_e", 1, F.size("_e") - 1)).alias("fold", "test_start"))
    x = x.withColumn("test_end", F.element_at("_e", F.col("fold") + 2))
    x = x.withColumns({"train_start": F.lit(0).cast("long"), "train_end": F.col("test_start") - embargo})
    return x.filter((F.col("train_end") > 0) & (F.col("test_end") > F.col("test_start"))).drop("_e")


def rolling_folds(bars: DataFrame, train: int, test: int, step: int | None = None, embargo: int = 0) -> DataFrame:
    stride = test if step is None else step
    last = F.floor((F.col("n") - (train + embargo + test)) / stride)
    x = _lengths(bars).withColumn("_l", last).filter(F.col("_l") >= 0)
    x = x.select("instrument", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l"))).alias("fold"))
    t0 = F.col("fold") * stride
    return x.select(
        "instrument", F.col("fold").cast("int").alias("fold"), (t0 + train + embargo).alias("test_start"),
        (t0 + train + embargo + test).alias("test_end"), t0.alias("train_start"), (t0 + train).alias("train_end"),
    )


def assign_folds(rows: DataFrame, folds: DataFrame, pos: str = "bar_index") -> DataFrame:
    """Each row in every fold it trains or tests; a fold list per instrument is short."""
    fs = folds.groupBy("instrument").agg(
        F.collect_list(F.struct("fold", "train_start", "train_end", "test_start", "test_end")).alias("_f")
    )
    p = F.col(pos)
    x = rows.join(fs, "instrument")
    hit = F.filter("_f", lambda f: ((p >= f["train_start"]) & (p < f["train_end"])) | ((p >= f["test_start"]) & (p < f["test_end"])))
    x = x.withColumn("_h", F.explode(hit))
    role = F.when(p >= F.col("_h.test_start"), "test").otherwise("train")
    return x.withColumns({"fold": F.col("_h.fold"), "role": role}).drop("_f", "_h")


def parameter_drift(values: DataFrame, keys: Sequence[str], value: str = "value", order: str = "fold", limit: float = 0.5) -> DataFrame:
    """How a fitted parameter moves from fold to fold."""
    keys = list(keys)
    v = F.col(value)
    w = Window.partitionBy(*keys).orderBy(order)
    sgn = F.when(F.signum(v) != 0, F.signum(v))
    x = values.filter(v.isNotNull()).withColumns({"_p": F.lag(value).over(w), "_s": sgn})
    x = x.withColumn("_ps", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    a = x.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("_lo"), F.max(v).alias("_hi"),
        F.avg(F.when(F.col("_p") != 0, F.abs(v - F.col("_p")) / F.abs("_p"))).alias("mean_abs_rel_change"),
        F.sum(F.when(F.col("_s") != F.col("_ps"), 1).otherwise(0)).alias("sign_flips"),
    )
    inf = F.lit(float("inf"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).when(F.col("std") == 0, 0.0).otherwise(inf)
    ratio = F.when(F.col("_lo") > 0, F.col("_hi") / F.col("_lo")).when(F.col("_hi") < 0, F.col("_lo") / F.col("_hi")).otherwise(inf)
    marc = F.when(F.col("n") > 1, F.coalesce(F.col("mean_abs_rel_change"), inf)).otherwise(0.0)
    verdict = (
        F.when(F.col("cv") == float("inf"), "undefined").when(F.col("sign_flips") > 0, "sign-unstable")
        .when(F.col("cv") <= limit, "stable").otherwise("drifting")
    )
    return a.withColumns({"cv": cv, "max_over_min": ratio, "mean_abs_rel_change": marc}).withColumn("verdict", verdict).drop("_lo", "_hi")
