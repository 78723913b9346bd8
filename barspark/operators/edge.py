"""Edge Book: decayed outcome statistics by (regime, setup, bucket) and their posterior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import student_t_ppf
from .label import avg_uniqueness, combined_weights, ess, triple_barrier  # noqa: F401
from .rolling import EW_HALFLIVES, ew_weight
from .sequence import own_rows, with_lookback

CELL = ["regime", "setup", "bucket"]
# Evidence cut points, prior and pooling strengths.
EVIDENCE_EDGES = (0.25, 0.6, 1.0, 1.6)
PRIOR_A, PRIOR_B = 3.0, 4.5
PRIOR_MEAN, PRIOR_STRENGTH, POOLING = 0.0, 40.0, 25.0
HALFLIFE = 5040.0


def evidence_bucket(log_odds: Column) -> Column:
    a = F.abs(log_odds)
    return sum((F.when(a >= e, 1).otherwise(0) for e in EVIDENCE_EDGES), F.lit(0)).cast("long")


def clipped(r: Column) -> Column:
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-12.0)), F.lit(12.0)))


def edge_stats(outcomes: DataFrame, age: Column | None = None, halflife: float = HALFLIFE, by: tuple[str, ...] = ()) -> DataFrame:
    """n_w, s1, s2 at leaf, node and root in one rollup.

    ``outcomes`` has the cell columns, ``ret_sigma`` and ``weight``.  The decay is a
    factor of each row's weight, so the sums combine map-side and any number of
    batches add up.
    """
    w = F.col("weight") if age is None else F.col("weight") * F.pow(F.lit(2.0), -age / halflife)
    r = clipped(F.col("ret_sigma"))
    x = outcomes.filter(F.col("ret_sigma").isNotNull() & (F.col("weight") > 0)).select(
        *by, *CELL, w.alias("w"), r.alias("r")
    )
    level = F.grouping_id()
    b = [F.col(k) for k in by]
    cells = [F.col(k) for k in CELL]
    # the rollup levels, without (regime), inside every value of ``by``
    sets = [[*b, *cells[:n]] for n in (3, 2, 0)]
    g = x.groupingSets(sets, *b, *cells) if by else x.rollup(*CELL)
    out = g.agg(
        level.alias("_g"),
        F.sum("w").alias("n_w"),
        F.sum(F.col("w") * F.col("r")).alias("s1"),
        F.sum(F.col("w") * F.col("r") ** 2).alias("s2"),
    )
    name = F.when(F.col("_g") == 0, "leaf").when(F.col("_g") == 1, "node").when(F.col("_g") == 7, "root")
    return out.withColumn("level", name).filter(F.col("level").isNotNull()).select(*by, "level", *CELL, "n_w", "s1", "s2")


def posterior(n: Column, s1: Column, s2: Column, mu0: Column, kappa0: float, q: float = 0.1) -> dict[str, Column]:
    """Normal-Inverse-Gamma posterior of the mean outcome and its credible bounds."""
    kn = n + kappa0
    an = PRIOR_A + 0.5 * n
    ss = F.greatest(s2 - s1 * s1 / n, F.lit(0.0))
    bn = F.when(n > 0, PRIOR_B + 0.5 * ss + kappa0 * n * (s1 / n - mu0) ** 2 / (2.0 * kn)).otherwise(PRIOR_B)
    mean = F.when(n > 0, (kappa0 * mu0 + s1) / kn).otherwise(mu0)
    dof = 2.0 * an
    scale2 = bn / (an * kn)
    scale = F.sqrt(scale2)
    return {
        "mean": mean,
        "lcb": mean + student_t_ppf(q, dof) * scale,
        "ucb": mean + student_t_ppf(1.0 - q, dof) * scale,
        "var_mean": scale2 * dof / (dof - 2.0),
        "outcome_var": bn / (an - 1.0),
        "n_eff": n,
        "dof": dof,
    }


def chain(x: DataFrame) -> DataFrame:
    """Leaf posterior from columns n/s1/s2 of leaf (l), node (m) and root (g).

    Each level is shrunk to the level above *without* its own data.
    """
    z = lambda k: F.coalesce(F.col(k), F.lit(0.0))

    def minus(a: str, b: str) -> tuple[Column, Column, Column]:
        n = F.greatest(z(f"n_{a}") - z(f"n_{b}"), F.lit(0.0))
        some = n > 0
        return (
            n,
            F.when(some, z(f"s1_{a}") - z(f"s1_{b}")).otherwise(0.0),
            F.when(some, F.greatest(z(f"s2_{a}") - z(f"s2_{b}"), F.lit(0.0))).otherwise(0.0),
        )

    gn, g1, g2 = minus("g", "m")
    x = x.withColumn("_mu_g", posterior(gn, g1, g2, F.lit(PRIOR_MEAN), PRIOR_STRENGTH)["mean"])
    mn, m1, m2 = minus("m", "l")
    x = x.withColumn("_mu_m", posterior(mn, m1, m2, F.col("_mu_g"), POOLING)["mean"])
    post = posterior(z("n_l"), z("s1_l"), z("s2_l"), F.col("_mu_m"), POOLING)
    return x.withColumns(post).drop("_mu_g", "_mu_m", *[f"{k}_{lv}" for k in ("n", "s1", "s2") for lv in "lmg"])


def edge_grid(spark: SparkSession) -> DataFrame:
    """All 4 x 4 x 5 cells."""
    r = lambda n, c: spark.range(n).withColumnRenamed("id", c)
    return r(4, "regime").crossJoin(r(4, "setup")).crossJoin(r(5, "bucket"))


def edge_posterior(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Posterior of every cell of the grid; an unseen cell inherits its parents."""
    by = list(by)

    def level(name: str, lv: str, keys: list[str]) -> DataFrame:
        return stats.filter(F.col("level") == name).select(
            *by, *keys, F.col("n_w").alias(f"n_{lv}"), F.col("s1").alias(f"s1_{lv}"), F.col("s2").alias(f"s2_{lv}")
        )

    # the grid is 80 fixed cells, whatever the size of the data
    grid, root = F.broadcast(edge_grid(stats.sparkSession)), level("root", "g", [])
    x = root.crossJoin(grid) if by else grid.join(root, how="left")
    x = x.join(level("leaf", "l", CELL), [*by, *CELL], "left").join(level("node", "m", CELL[:2]), [*by, *CELL[:2]], "left")
    return chain(x)


def edge_lookup(rows: DataFrame, post: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Attach the posterior of each row's cell (an 80-row table, or 80 rows per ``by``)."""
    return rows.join(post if by else F.broadcast(post), [*by, *CELL], "left")


def edge_summary(stats: DataFrame) -> DataFrame:
    root = stats.filter("level = 'root'")
    z = posterior(F.col("n_w"), F.col("s1"), F.col("s2"), F.lit(PRIOR_MEAN), PRIOR_STRENGTH)
    none = [F.lit(None).cast("long").alias(k) for k in CELL]
    cols = ["n_eff", "mean", "lcb", "ucb"]
    top = root.select(*none, *[z[k].alias(k) for k in cols])
    cells = edge_posterior(stats).filter(F.col("n_eff") >= 1.0).select(*CELL, *cols)
    return top.unionByName(cells).orderBy(*[F.col(k).asc_nulls_first() for k in CELL])


def edge_asof(outcomes: DataFrame, bars: DataFrame, halflife: float = HALFLIFE) -> DataFrame:
    """Posterior of each bar's cell from outcomes resolved strictly before it.

    One union of events and lookups, windows inside (instrument, block); the
    look-back is 64 half-lives, beyond which a weight changes no bit of the sum.
    """
    ev = outcomes.filter(F.col("ret_sigma").isNotNull() & (F.col("weight") > 0)).select(
        "instrument", F.col("exit_index").alias("pos"), F.lit(1).alias("kind"), *CELL,
        F.lit(None).cast("string").alias("candidate_id"), F.col("weight").alias("w"), clipped(F.col("ret_sigma")).alias("r"),
    )
    ask = bars.select(
        "instrument", F.col("bar_index").alias("pos"), F.lit(0).alias("kind"), *CELL, "candidate_id",
        F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("r"),
    )
    rows = int(EW_HALFLIVES * halflife) + 1
    x = with_lookback(ev.unionByName(ask), rows, rows, "pos")
    g = ew_weight(halflife, rows, "pos")
    x = x.withColumn("_g", g)
    sums = {"n": F.col("w"), "s1": F.col("w") * F.col("r"), "s2": F.col("w") * F.col("r") ** 2}
    cols = {}
    for lv, keys in (("l", CELL), ("m", CELL[:2]), ("g", [])):
        win = Window.partitionBy("instrument", "blk", *keys).orderBy("pos", "kind").rowsBetween(
            Window.unboundedPreceding, 0
        )
        cols |= {f"{k}_{lv}": F.sum(v * F.col("_g")).over(win) / F.col("_g") for k, v in sums.items()}
    x = own_rows(x.withColumns(cols)).filter("kind = 0")
    return chain(x.withColumnRenamed("pos", "bar_index")).drop("kind", "w", "r", "_g")
