"""Ordered work over bars, in bounded pieces.

One instrument may hold a third of all rows, so nothing here puts a whole
instrument in one task.  A series is cut into blocks of ``block`` consecutive
bars and every operator is one of four shapes:

``index_bars``     number the bars of each instrument (two-level counting)
``with_lookback``  bounded frames: each block also gets the rows before it
``running``        prefix sums / maxima / last-known values: block totals are
                   scanned, then added to the prefix inside the block
``fold``           sequential recursions: blocks run in parallel from guessed
                   start states until every start equals the end before it
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, shared_folder, shuffles_removed

BLOCK = 4096
FOLD_BLOCK = 16384
_SPAN = 1024


def index_bars(
    bars: DataFrame,
    order: Sequence[str] = ("ts",),
    keys: Sequence[str] = ("instrument",),
    slot_seconds: int = 1 << 20,
    name: str = "bar_index",
) -> DataFrame:
    """Add a dense 0-based ``bar_index`` per key, in time order.

    Rows are numbered inside fixed time slots, slot counts inside spans of 1024
    slots, and span counts per key: no window sees more than one slot of rows.
    ``order[0]`` must be a timestamp.
    """
    slot = F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / slot_seconds)
    return number_rows(bars, slot, order, keys, name)


def number_rows(
    df: DataFrame, slot: Column, order: Sequence[str], keys: Sequence[str] = ("instrument",), name: str = "bar_index"
) -> DataFrame:
    """Dense 0-based number per key in ``order``, which must not contradict ``slot``.

    Rows are numbered inside a slot, and slot counts are scanned.
    """
    keys = list(keys)
    x = df.withColumn("_slot", slot)
    counts = x.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _exclusive_sums(counts, keys, "_slot", "_n")
    w = Window.partitionBy(*keys, "_slot").orderBy(*order)
    x = x.withColumn("_rn", F.row_number().over(w) - 1)
    return (
        x.join(offsets, [*keys, "_slot"])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_slot", "_rn", "_before")
    )


def _exclusive_sums(totals: DataFrame, keys: list[str], pos: str, val: str) -> DataFrame:
    """Sum of ``val`` over smaller ``pos`` per key, scanned span by span."""
    t = totals.withColumn("_span", F.floor(F.col(pos) / _SPAN))
    inner = Window.partitionBy(*keys, "_span").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    spans = t.groupBy(*keys, "_span").agg(F.sum(val).alias("_sv"))
    outer = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", F.coalesce(F.sum("_sv").over(outer), F.lit(0)).alias("_base"))
    t = t.withColumn("_in", F.coalesce(F.sum(val).over(inner), F.lit(0)))
    return t.join(spans, [*keys, "_span"]).select(*keys, pos, (F.col("_in") + F.col("_base")).alias("_before"))


# --------------------------------------------------------------------------- #
# bounded frames


def with_lookback(
    df: DataFrame, rows: int, block: int = BLOCK, order: str = "bar_index"
) -> DataFrame:
    """Add ``blk`` and ``halo``; each block also holds the ``rows`` rows before it.

    Copies ``rows / block`` of the data.  Windows go over ``(instrument, blk)``;
    finish with :func:`own_rows`.
    """
    block = max(block, rows)
    b = F.floor(F.col(order) / block)
    tail = F.pmod(F.col(order), F.lit(block)) >= block - rows
    return df.withColumn("blk", F.explode(F.when(tail, F.array(b, b + 1)).otherwise(F.array(b)))).withColumn(
        "halo", F.col("blk") != b
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("halo")).drop("halo", "blk")


def w_block(keys: Sequence[str] = ("instrument",), order: str = "bar_index"):
    """Unframed window of a block, for ``lag``."""
    return Window.partitionBy(*keys, "blk").orderBy(order)


def w_last(k: int, keys: Sequence[str] = ("instrument",), order: str = "bar_index"):
    """The last ``k`` rows up to the current one."""
    return w_block(keys, order).rowsBetween(-(k - 1), 0)


def framed(df: DataFrame, rows: int, cols: dict[str, Column], **kw) -> DataFrame:
    """Add window columns that look at most ``rows`` rows back."""
    return own_rows(with_lookback(df, rows, **kw).withColumns(cols))


def framed_apply(
    df: DataFrame,
    rows: int,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    keys: Sequence[str] = ("instrument",),
    order: str = "bar_index",
    block: int = BLOCK,
) -> DataFrame:
    """Run an array function over each block and its look-back rows.

    ``fn`` gets the block sorted by ``order`` and returns a frame of the same
    length; look-back rows are dropped afterwards.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = fn(pdf)
        return out[~pdf["halo"].to_numpy()]

    return with_lookback(df, rows, block, order).groupBy(*keys, "blk").applyInPandas(run, schema)


# --------------------------------------------------------------------------- #
# prefix scans

_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    spec: dict[str, tuple[str, Column]],
    keys: Sequence[str] = ("instrument",),
    order: str = "bar_index",
    block: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Prefix aggregates per key: ``{name: (kind, value)}``.

    kind is ``sum``, ``max``, ``min`` or ``last`` (last non-null).  The data is
    shuffled once by (key, block); block totals (n/block rows) carry the rest,
    themselves scanned in spans of 1024 blocks.  ``inclusive=False`` excludes
    the current row.  Rows of one position go by ``candidate_id`` where there is one.
    """
    keys = list(keys)
    x = df.withColumn("_b", F.floor(F.col(order) / block))
    x = x.withColumns({f"_v_{n}": v for n, (_, v) in spec.items()})
    at = [order, *(c for c in ("candidate_id",) if c in df.columns and c != order)]  # two candidates on a bar keep one order
    wl = Window.partitionBy(*keys, "_b").orderBy(*at).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )

    def over(kind: str, c: Column, w) -> Column:
        return F.last(c, ignorenulls=True).over(w) if kind == "last" else _LOCAL[kind](c).over(w)

    def total(kind: str, c: Column, pos: str) -> Column:
        place = F.struct(*at) if pos == order else F.col(pos)
        return F.max_by(c, F.when(c.isNotNull(), place)) if kind == "last" else _LOCAL[kind](c)

    tot = x.groupBy(*keys, "_b").agg(
        *[total(k, F.col(f"_v_{n}"), order).alias(f"_t_{n}") for n, (k, _) in spec.items()]
    ).withColumn("_s", F.floor(F.col("_b") / _SPAN))
    spans = tot.groupBy(*keys, "_s").agg(
        *[total(k, F.col(f"_t_{n}"), "_b").alias(f"_u_{n}") for n, (k, _) in spec.items()]
    )
    wo = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *keys, "_s", *[over(k, F.col(f"_u_{n}"), wo).alias(f"_o_{n}") for n, (k, _) in spec.items()]
    )
    wi = Window.partitionBy(*keys, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *keys, "_b", "_s", *[over(k, F.col(f"_t_{n}"), wi).alias(f"_i_{n}") for n, (k, _) in spec.items()]
    )

    def merge(kind: str, older: Column, newer: Column) -> Column:
        if kind == "sum":
            return F.when(older.isNull(), newer).when(newer.isNull(), older).otherwise(older + newer)
        if kind == "max":
            return F.greatest(older, newer)
        if kind == "min":
            return F.least(older, newer)
        return F.coalesce(newer, older)

    carry = tot.join(spans, [*keys, "_s"]).select(
        *keys, "_b", *[merge(k, F.col(f"_o_{n}"), F.col(f"_i_{n}")).alias(f"_c_{n}") for n, (k, _) in spec.items()]
    )
    x = x.withColumns({f"_l_{n}": over(k, F.col(f"_v_{n}"), wl) for n, (k, _) in spec.items()})
    x = x.join(carry, [*keys, "_b"])
    x = x.withColumns({n: merge(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in spec.items()})
    return x.drop("_b", *[f"_{p}_{n}" for n in spec for p in "vlc"])


# --------------------------------------------------------------------------- #
# folds

State = dict | None
Kernel = Callable[[State, pd.DataFrame], tuple[dict, pd.DataFrame]]


def _close(a, b, tol: float = 1e-12) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k], tol) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_close(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b) or abs(a - b) <= tol * max(abs(a), abs(b), 1e-3)
    return a == b


@F.pandas_udf(T.BooleanType())
def _same_state(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [x == y or (x is not None and y is not None and _close(json.loads(x), json.loads(y))) for x, y in zip(a, b)]
    )


def fold(
    df: DataFrame,
    kernel: Kernel,
    schema: str,
    keys: Sequence[str] = ("instrument",),
    order: str = "bar_index",
    block: int = FOLD_BLOCK,
    start: DataFrame | None = None,
    end_states: bool = False,
):
    """Sequential recursion per key, run block by block in parallel.

    ``kernel(state, rows)`` consumes sorted rows and returns the next state (a
    small JSON-able dict) and the output rows.  Every block first runs from an
    empty state; its end state is the guess for the next block's start.  Blocks
    whose start changes run again until none does, which makes every start exact
    (block 0 is, hence block 1 is, ...).  Recursions that forget their past
    settle in two or three rounds; the worst case is one round per block.

    ``start`` (keys + ``state``) resumes from saved states; ``end_states=True``
    also returns the final state per key.
    """
    keys = list(keys)
    by = [*keys, "blk"]
    x = df.withColumn("blk", F.floor(F.col(order) / block))
    first = x.groupBy(*keys).agg(F.min("blk").alias("blk"), F.max("blk").alias("last_blk"))
    x = checkpoint(x)
    span = x.select(F.max(F.col("blk")).alias("hi"), F.min("blk").alias("lo")).first()
    key_types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    state_schema = ", ".join(f"{k} {key_types[k]}" for k in by) + ", state string"

    def step(group, pdf: pd.DataFrame, state: str | None, want: str) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        nxt, out = kernel(json.loads(state) if state else None, pdf)
        if want == "out":
            return out
        return pd.DataFrame([[*group, json.dumps(nxt)]], columns=[*by, "state"])

    def grouped(starts: DataFrame | None, rows: DataFrame, want: str, out_schema: str) -> DataFrame:
        if starts is None:
            return rows.groupBy(*by).applyInPandas(lambda g, p: step(g, p, None, want), out_schema)

        def co(group, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                names = [c.split()[0] for c in out_schema.split(",")]
                return pd.DataFrame(columns=names)
            st = right["state"].iloc[0] if len(right) else None
            return step(group, left, st, want)

        return rows.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(co, out_schema)

    base = None
    if start is not None:
        base = first.join(start, keys).select(*by, "state")
    if span is None or span.hi is None or span.hi == span.lo:
        starts = base
    else:
        ends = checkpoint(grouped(base, x, "state", state_schema))
        used = None
        while True:
            proposed = ends.select(*keys, (F.col("blk") + 1).alias("blk"), "state")
            if base is not None:
                proposed = proposed.unionByName(base)
            proposed = proposed.join(ends.select(*by), by, "left_semi")
            if used is None:
                fresh = checkpoint(proposed)
                used = fresh
            else:
                both = proposed.join(used.withColumnRenamed("state", "old"), by, "left").withColumn(
                    "same", F.coalesce(_same_state("old", "state"), F.lit(False))
                )
                both = checkpoint(both)
                fresh = both.filter(~F.col("same")).select(*by, "state")
                if fresh.isEmpty():
                    break
                used = both.select(*by, F.when(F.col("same"), F.col("old")).otherwise(F.col("state")).alias("state"))
            todo = x.join(fresh.select(*by), by, "left_semi")
            redone = grouped(fresh, todo, "state", state_schema)
            ends = checkpoint(ends.join(fresh.select(*by), by, "left_anti").unionByName(redone))
        starts = used
    out = grouped(starts, x, "out", schema)
    if not end_states:
        return out
    last = first.select(*keys, F.col("last_blk").alias("blk"))
    tail = x.join(last, by, "left_semi")
    ts = None if starts is None else starts.join(last, by, "left_semi")
    return out, grouped(ts, tail, "state", state_schema).drop("blk")


def fold_forward(
    df: DataFrame,
    kernel: Kernel,
    schema: str,
    keys: Sequence[str] = ("instrument",),
    order: str = "seq",
    block: int = FOLD_BLOCK,
    start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A recursion that never forgets: (output rows, last state per key).

    Round k runs the k-th block of every series at once, from the states that round k - 1 stored beside its rows. Each row
    goes through Python once, however many rounds there are, where :func:`fold` would run all later blocks again whenever a
    start changes. A task holds one block of one series; the rounds are the blocks of the longest series. ``order`` numbers
    a series without gaps; ``start`` (keys, state) resumes it.
    """
    keys = list(keys)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-forward-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(spark):
        df.withColumn("blk", F.floor(F.col(order) / block)).repartition("blk", *keys).write.partitionBy("blk").parquet(f"{path}/in")
    x = spark.read.schema(f"{_ddl(df)}, blk long").parquet(f"{path}/in")
    names = [c.split()[0] for c in schema.split(",")]
    kinds = dict(df.dtypes)
    state_schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", state string"
    out_schema = f"{schema}, state string"

    def step(group, pdf: pd.DataFrame, state: str | None) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        nxt, out = kernel(json.loads(state) if state else None, pdf)
        out = out[names].astype(object).where(out[names].notna(), None).assign(state=None)
        out.loc[len(out)] = [dict(zip(keys, group)).get(n) for n in names] + [json.dumps(nxt)]
        return out

    def run(group, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[*names, "state"])
        return step(group, left, right["state"].iloc[0] if len(right) else None)

    span = x.agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).first()
    if span.lo is None:
        return spark.createDataFrame([], schema), (start if start is not None else spark.createDataFrame([], state_schema))
    begun = start if start is not None else spark.createDataFrame([], state_schema)
    states = begun
    for b in range(span.lo, span.hi + 1):
        rows = x.filter(F.col("blk") == b).drop("blk")
        with shuffles_removed(spark):
            made = rows.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(run, out_schema)
            made.write.parquet(f"{path}/out/round={b}")
        new = spark.read.schema(out_schema).parquet(f"{path}/out/round={b}").filter("state IS NOT NULL").select(*keys, "state")
        states = new.unionByName(begun.join(new, keys, "left_anti")) if start is not None else new
    every = spark.read.schema(f"{out_schema}, round long").parquet(f"{path}/out")
    last = every.filter("state IS NOT NULL").groupBy(*keys).agg(F.max_by("state", "round").alias("state"))
    ends = last.unionByName(begun.join(last, keys, "left_anti"))
    return every.filter("state IS NULL").select(*names), ends


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# --------------------------------------------------------------------------- #
# exact order statistics of unbounded groups


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Iterable[float], edges: int = 127
) -> DataFrame:
    """Exact linearly interpolated quantiles: columns ``q_0, q_1, ...``.

    ``percentile`` keeps every distinct value of a group in one task.  Here a
    bounded sketch gives cut points, buckets are counted, and only the buckets
    that hold a wanted rank are sorted.  The answer does not depend on the sketch.
    """
    keys, qs = list(keys), list(qs)
    v = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    v = v.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_m"))
    cut = v.groupBy(*keys).agg(
        F.percentile_approx("_x", [i / (edges + 1) for i in range(1, edges + 1)], 4096).alias("_e")
    )
    cut = cut if keys else cut.withColumn("_one", F.lit(1))
    v = v if keys else v.withColumn("_one", F.lit(1))
    ks = keys or ["_one"]
    v = v.join(cut, ks).withColumn("_k", F.size(F.filter("_e", lambda e: e < F.col("_x")))).drop("_e")
    cnt = v.groupBy(*ks, "_k").agg(F.sum("_m").alias("_c"))
    wk = Window.partitionBy(*ks)
    cnt = cnt.withColumns(
        {
            "_n": F.sum("_c").over(wk),
            "_lo": F.sum("_c").over(wk.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"),
        }
    )
    ranks = F.array_distinct(
        F.flatten(
            F.array(*[F.array(F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1))) for q in qs])
        )
    )
    want = cnt.withColumn(
        "_r", F.filter(ranks, lambda r: (r >= F.col("_lo")) & (r < F.col("_lo") + F.col("_c")))
    ).filter(F.size("_r") > 0)
    wb = Window.partitionBy(*ks, "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        v.join(want.select(*ks, "_k", "_n", "_lo", "_r"), [*ks, "_k"])
        .withColumn("_hi", F.col("_lo") + F.sum("_m").over(wb))
        .withColumn("_r", F.explode("_r"))
        .filter((F.col("_r") < F.col("_hi")) & (F.col("_r") >= F.col("_hi") - F.col("_m")))
    )
    picked = hit.groupBy(*ks).agg(
        F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_at")
    )
    cols = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col("_at")[F.floor(pos)], F.col("_at")[F.ceil(pos)]
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q_{i}"))
    return picked.select(*keys, *cols)
