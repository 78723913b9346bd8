"""Targets, costs, sizing, limits, the entry gate and the position ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip
from ..kernels import chain as N
from ..kernels import ledger as K
from .features import as_fold
from .sequence import fold_forward, index_bars, running

c = F.col
INF = float("inf")


def barrier_plan(stop: float = 1.6, target: float = 2.6, hold: int = 30) -> dict[str, Column]:
    """Stop, target and horizon adjusted by stress, jumps, regime lean and the next pivot."""
    p0, p1, p2 = (F.coalesce(c(k), F.lit(0.0)) for k in ("p0", "p1", "p2"))
    d = c("direction")
    s = stop * F.when(p2 > 0.2, 1.0 + 0.6 * p2).otherwise(1.0)
    s = s * F.when(c("jump_share") > 0.4, 1.0 + 0.4 * (c("jump_share") - 0.4) / 0.6).otherwise(1.0)
    back = p1 > p0
    t = target * F.when(back, 1.0 - 0.25 * (p1 - p0)).otherwise(1.0 + 0.2 * (p0 - p1))
    h = F.when(back, F.floor(hold * (1.0 - 0.3 * (p1 - p0)))).otherwise(hold)
    level = F.when(d > 0, c("pivot_high")).otherwise(c("pivot_low"))
    dist = F.when((level > 0) & (c("close") > 0), F.log(level / c("close")) * d / c("sigma_fcst"))
    t = F.when((dist > 0.3) & (dist < t), F.greatest(0.8 * dist, 0.6 * s)).otherwise(t)
    ok = (c("sigma_fcst") > 0) & (d != 0)
    s, t = clip(s, 0.4, 8.0), clip(t, 0.4, 12.0)
    px = lambda sign, k: c("close") * F.exp(sign * d * k * c("sigma_fcst"))
    plan = {
        "stop_sigma": s, "target_sigma": t, "max_holding": F.least(F.greatest(h, F.lit(3)), F.lit(500)).cast("long"),
        "stop_price": px(-1.0, s), "target_price": px(1.0, t),
    }
    return {k: F.when(ok, v) for k, v in plan.items()}


def naive_expectancy() -> Column:
    return c("p_success") * c("target_sigma") - (1.0 - c("p_success")) * c("stop_sigma")


def spread_used(feed: str = "spread_feed") -> Column:
    """Measured spread when present and not negative, else the range estimate."""
    return F.when((c(feed) >= 0) & (c(feed) < INF), c(feed)).otherwise(c("spread"))


def cost_estimate(spread: Column, participation: float = 0.002, stress: Column | None = None) -> dict[str, Column]:
    """Half spread, impact, slippage and fee in sigma, and their round trip."""
    s = c("sigma_fcst")
    k = F.lit(1.0) if stress is None else F.greatest(stress, F.lit(1.0))
    half = 0.5 * F.when(spread > 0, spread).otherwise(0.0005) / s
    half = F.when(half > 0.20, INF).otherwise(half) * k
    rng = F.when(c("range_over_sigma") > 0, c("range_over_sigma")).otherwise(1.3)
    parts = {
        "half_spread_sigma": half,
        "impact_sigma": 0.6 * math.sqrt(max(participation, 0.0)) * k,
        "slippage_sigma": 0.02 * F.least(rng, F.lit(5.0)) * k,
        "fee_sigma": 1e-4 / s,
    }
    ok = s > 0
    out = {n: F.when(ok, v).otherwise(INF) for n, v in parts.items()}
    out["cost_sigma"] = F.when(ok, 2.0 * sum(list(parts.values())[1:], half)).otherwise(INF)
    return out


def stress_multiplier() -> Column:
    return 1.0 + 1.5 * c("p2")


def capacity(edge: Column, eta: float = 0.6) -> Column:
    """Participation whose impact eats the edge."""
    return F.when(edge > 0, (edge / (2.0 * eta)) ** 2).otherwise(0.0)


def position_size(drawdown: Column, extra: Column | None = None, equity: Column | None = None, blocked: Column | None = None) -> dict[str, Column]:
    """Fraction of equity at risk and units, with every factor named.

    Needs mean, lcb, outcome_var, var_mean, n_eff, cost_sigma, stop_sigma, sigma_fcst, close.
    """
    extra = F.lit(1.0) if extra is None else extra
    equity = F.lit(1.0) if equity is None else equity
    net, low = c("mean") - c("cost_sigma"), c("lcb") - c("cost_sigma")
    pos = F.greatest(net, F.lit(0.0))
    kelly = pos / (c("outcome_var") + c("var_mean"))
    haircut = clip(low / F.greatest(net, F.lit(1e-9)), 0, 1)
    data = clip(c("n_eff") / 30.0, 0.15, 1.0)
    raw = kelly * 0.25 * haircut * data * extra
    ok = (low > 0) & (c("stop_sigma") > 0) & ~(F.lit(False) if blocked is None else blocked)
    ok = F.coalesce(ok, F.lit(False))
    frac = F.when(ok, clip(raw * drawdown, 0.0, 0.02)).otherwise(0.0)
    dist = F.abs(c("close") * (1.0 - F.exp(-c("stop_sigma") * c("sigma_fcst"))))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return {
        "risk_raw": F.when(ok, raw).otherwise(0.0),
        "risk_fraction": frac,
        "units": F.when(ok & (dist > 0), frac * equity / dist).otherwise(0.0),
        "throttles": F.when(
            ok,
            F.create_map(
                F.lit("kelly_raw"), kelly, F.lit("uncertainty_haircut"), haircut, F.lit("data_sufficiency"), data,
                F.lit("drawdown"), drawdown, F.lit("kelly_fraction"), F.lit(0.25), F.lit("extra"), extra,
            ),
        ).otherwise(none),
    }


def vol_target(sigma: Column, bars_per_year: float = 252.0, target: float = 0.15) -> Column:
    return F.when(sigma > 0, clip(target / (sigma * math.sqrt(bars_per_year)), 0.1, 3.0)).otherwise(1.0)


def throttle(dd: Column, r: dict = K.RULES) -> Column:
    """Column form of the drawdown throttle."""
    a, b, f, k = r["dd_start"], r["dd_stop"], r["dd_floor"], r["dd_kill"]
    return (
        F.when(dd <= a, 1.0).when(dd >= k, 0.0).when(dd >= b, f * (1.0 - (dd - b) / (k - b)))
        .otherwise(1.0 - (dd - a) / (b - a) * (1.0 - f))
    )


def drawdown_throttle(equity: DataFrame, order: str = "bar_index") -> DataFrame:
    """Peak, drawdown, throttle and kill flag of an equity series (starting at 1)."""
    x = running(equity, {"_pk": ("max", c("equity"))}, order=order)
    x = x.withColumn("peak", F.greatest(F.lit(1.0), c("_pk"))).drop("_pk")
    x = x.withColumn("drawdown", F.greatest(1.0 - c("equity") / c("peak"), F.lit(0.0)))
    return x.withColumns({"throttle": throttle(c("drawdown")), "killed": c("drawdown") >= K.RULES["dd_kill"]})


def limit_checks() -> tuple[Column, Column]:
    """(kill switches, warnings) from drawdown, brier, psi, slippage_ratio, stale_bars, loss_streak, n_trades."""
    kills = F.array_compact(
        F.array(
            F.when(c("drawdown") >= 0.25, "drawdown"), F.when(c("brier") > 0.27, "brier"), F.when(c("psi") > 0.25, "psi"),
            F.when(c("slippage_ratio") > 2.0, "slippage"), F.when(c("stale_bars") > 3, "stale"),
        )
    )
    alarm = F.ceil(F.log2(F.greatest(c("n_trades"), F.lit(8)).cast("double"))) + 3
    return kills, F.array_compact(F.array(F.when(c("loss_streak") >= alarm, "loss_streak")))


def upper_median(values: DataFrame, value: str, min_n: int = 10, keys=("instrument",)) -> DataFrame:
    """Upper middle element of a short window (at most 50 rows per key)."""
    a = values.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    n = F.size("_v")
    return a.select(*keys, F.when(n >= min_n, F.element_at("_v", (F.floor(n / 2) + 1).cast("int"))).alias("slippage_ratio"))


TRADEABLE_OFF = (1, 7, 8)
AUCTIONS = (2, 6)


def gate(p_min: float = 0.58, ebe_min: float = 1.25, lcb_min: float = 0.05, hazard_max: float = 0.35, n_engines: int = 9) -> Column:
    """Names of the failed conditions that depend on the bar only; empty means pass.

    The first five end the list, the others accumulate.  Open position, entry rate
    and size belong to the ledger.
    """
    first = (
        F.when(~c("valid"), "features not valid").when(c("direction") == 0, "no directional evidence")
        .when(c("stop_sigma").isNull(), "no volatility forecast for barriers")
        .when(c("phase").isin(*TRADEABLE_OFF, *AUCTIONS), "session phase")
    )
    low = c("lcb") - c("cost_sigma")
    rest = F.array_compact(
        F.array(
            F.when(c("dominant") == 3, "quiet regime"),
            F.when(c("hazard") > hazard_max, "transition hazard"),
            F.when(~F.coalesce(low > lcb_min, F.lit(False)), "expectancy lower bound"),
            F.when(~F.coalesce(c("p_success") >= p_min, F.lit(False)), "probability"),
            F.when(~F.coalesce(c("ebe") >= ebe_min, F.lit(False)), "effective breadth"),
            F.when(c("n_invalid") > max(2, n_engines // 3), "engines invalid"),
        )
    )
    return F.when(first.isNotNull(), F.array(first)).otherwise(rest)


def decision_events(rows: DataFrame, rejects: DataFrame | None = None, psi: DataFrame | None = None) -> DataFrame:
    """One ordered stream of accepted bars (``train.decision_inputs``) and rejected ones (instrument, ts, kind), numbered by ``seq``.

    ``psi`` (instrument, bar_index, psi_max) is the worst feature's drift as known at a bar; without it drift never demotes.
    """
    x = rows.withColumns({"issue": F.lit(None).cast("string"), "sigma": c("sigma_fcst"), "max_posterior": F.greatest("p0", "p1", "p2", "p3")})
    x = x.withColumn("psi_max", F.lit(None).cast("double")) if psi is None else x.join(psi.select("instrument", "bar_index", "psi_max"), ["instrument", "bar_index"], "left")
    names = [k for k in N.IN if k != "seq"]
    if rejects is None:
        return x.select("instrument", c("bar_index").alias("seq"), *names)
    x = x.select("instrument", "ts", *names)
    none = [F.lit(None).cast(kind).alias(k) for k, kind in x.dtypes if k not in ("instrument", "ts", "issue")]
    both = x.unionByName(rejects.select("instrument", "ts", c("kind").alias("issue"), *none))
    return index_bars(both, ("ts", "issue"), name="seq").drop("ts")  # a bar before the rejected ones of its time


def decisions(events: DataFrame, rules: dict | None = None, learn: bool = True, equity: float = 1.0, start: DataFrame | None = None, block: int = 16384) -> tuple[DataFrame, DataFrame]:
    """(one decision per event, last state per instrument) of the whole chain with its feedback; see :mod:`..kernels.chain`.

    ``start`` (instrument, state) resumes: from the states of an earlier call, or from a trained book (:func:`book_start`).
    A call on ten batches, each from the states of the one before, gives the rows of one call on all.
    """
    step = N.chain(rules, learn, equity)
    keep = ["instrument", "seq", "bar_index"]

    def kernel(state, rows):
        nxt, got = step(state, rows)
        return nxt, rows[keep].assign(**got)

    schema = "instrument string, seq long, bar_index long, " + ", ".join(f"{k} {t}" for k, t in N.OUT.items())
    return fold_forward(events.select("instrument", *N.IN), kernel, schema, start=start, block=block)


def book_start(instruments: DataFrame, stats: DataFrame, knots: DataFrame | None = None, equity: float = 1.0, clock: int = 0) -> DataFrame:
    """(instrument, state) that begins with a trained book (``edge.edge_stats``: at most 80 cells, 16 nodes and a root) and calibration knots."""
    key = F.concat_ws(":", c("regime").cast("string"), c("setup").cast("string"), c("bucket").cast("string"))
    cells = stats.filter("n_w > 0").select(F.struct(key.alias("key"), F.array(F.lit(float(clock)), "n_w", "s1", "s2").alias("value")).alias("c")).agg(F.collect_list("c").alias("cs"))
    cells = cells.select(F.to_json(F.map_from_entries("cs")).alias("book"))
    steps = F.lit("null")
    if knots is not None:
        fitted = knots.agg(F.to_json(F.sort_array(F.collect_list(F.array("x", "y")))).alias("steps"))  # the knots of one map
        cells, steps = cells.crossJoin(fitted), F.when(c("steps") == "[]", "null").otherwise(c("steps"))
    state = F.format_string(
        f'{{"open": null, "recent": [], "equity": {equity!r}, "peak": {equity!r}, "book": %s, "outcomes": [], "since": 0, "map": %s, "level": 0, "brier": null}}', "book", steps
    )
    return instruments.select("instrument").distinct().crossJoin(F.broadcast(cells.select(state.alias("state"))))  # one row


def decision_trades(made: DataFrame) -> DataFrame:
    """Closed positions of :func:`decisions`."""
    return made.filter(c("entry_index").isNotNull()).select(
        "instrument", "entry_index", c("bar_index").alias("exit_index"), c("trade_direction").alias("direction"), "entry_price", "exit_price",
        c("trade_sigma").alias("ret_sigma"), c("trade_outcome").alias("outcome"), c("trade_cell").alias("cell"), c("trade_p").alias("p_at_entry"),
        c("trade_risk").alias("risk_fraction"), c("equity").alias("equity_after"), "reason", c("trade_cost").alias("cost_sigma"),
        (c("trade_sigma") - c("trade_cost")).alias("net_sigma"),
    )


LEDGER_IN = (
    "open", "high", "low", "close", "direction", "p_success", "ebe", "gate_ok", "stop_sigma", "target_sigma", "sigma",
    "max_holding", "cost_sigma", "risk_raw", "tradeable", "cell",
)


def position_ledger(rows: DataFrame, initial_equity: float = 1.0, **kw) -> DataFrame:
    """Run the position machine over a table of per-bar signals.

    The equity is the prefix product of the bars' growth factors, a scan.
    """
    x = as_fold(rows.select("instrument", "bar_index", *LEDGER_IN), {"ledger": K.ledger(kw.pop("rules", None))}, ["instrument", "bar_index"], K.OUT, **kw)
    x = running(x, {"_g": ("sum", F.log("growth"))})
    return x.withColumn("equity", initial_equity * F.exp("_g")).drop("_g")


def trades(ledger: DataFrame) -> DataFrame:
    """One row per closed position."""
    cell = F.split("trade_cell", ":")
    return ledger.filter(c("entry_index").isNotNull()).select(
        "instrument", "entry_index", c("bar_index").alias("exit_index"), c("trade_direction").alias("direction"),
        "entry_price", "exit_price", c("trade_sigma").alias("ret_sigma"), c("trade_outcome").alias("outcome"),
        cell[0].cast("long").alias("regime"), cell[1].cast("long").alias("setup"), cell[2].cast("long").alias("bucket"),
        c("trade_p").alias("p_at_entry"), c("trade_risk").alias("risk_fraction"), c("equity").alias("equity_after"),
        "reason", c("trade_cost").alias("cost_sigma"), (c("trade_sigma") - c("trade_cost")).alias("net_sigma"),
    )


def trade_net(rows: DataFrame) -> DataFrame:
    return rows.withColumn("net_sigma", c("ret_sigma") - c("cost_sigma"))


def with_rejects(decisions: DataFrame, rejects: DataFrame) -> DataFrame:
    """A rejected bar still yields a row: NO TRADE with the reason."""
    r = rejects.select(
        "instrument", "bar_index", F.lit("NO TRADE").alias("action"), F.array(F.concat(F.lit("bar rejected: "), "kind")).alias("veto")
    )
    return decisions.select("instrument", "bar_index", "action", "veto").unionByName(r)


def run_summary(decisions: DataFrame, trade_rows: DataFrame, keys=("instrument",)) -> DataFrame:
    """Bars, signals, trades, hit rate, expectancy and final equity."""
    keys = list(keys)
    d = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.when(c("action") != "NO TRADE", 1).otherwise(0)).alias("actionable"),
        F.max_by("equity", "bar_index").alias("final_equity"),
    )
    t = trade_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(c("ret_sigma") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg("ret_sigma").alias("expectancy"), (F.stddev_samp("ret_sigma") / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )
    x = d.join(t, keys, "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    return x.withColumn("t_stat", F.try_divide("expectancy", "se"))
