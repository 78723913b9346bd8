"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Each turn may keep
its role or be relabelled; a turn of the same role as the one before is merged into it; where a role is missing an empty turn
is inserted. The cheapest repair is a path through the automaton: a turn is a 4 x 4 matrix of costs from the state before it to
the state after it, and a run of turns is their product in the (min, +) sense.

So a conversation of any length is cut: turns are range-sorted by (conv_id, turn, role, text), each partition writes pieces of at
most ``PIECE`` turns with their matrix, the matrices of a conversation (16 numbers for 4,096 turns) are multiplied along it
to learn each piece's first and last state, and then all pieces are repaired and rendered at once.

Result: pieces that partition edges cut are put together again, so a conversation of up to ``PIECE`` turns is one row: conv_id,
part, turns, merged, relabelled, inserted, cost, text. A longer one has a row for about as many turns each; its parts' texts,
joined in order, are the rendered conversation.

Defined results: a null or unknown role is relabelled at a lower price; null text is empty; a null turn comes first; equal
turns are ordered by role and text, so repeated rows follow each other and merge; rows with a null ``conv_id`` are one
conversation; among repairs of equal cost the one with the earlier role in ROLES wins, from the last turn back; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written

ROLES = ("start", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
MERGE, INSERT, RELABEL, NAME = 1, 4, 6, 2
NEVER = 1 << 40
PIECE, PIECE_BYTES = 4096, 8 << 20
NUMBERS = ("turns", "merged", "relabelled", "inserted", "cost")


def _path(s: int, t: int) -> list[int] | None:
    """Roles to insert between state s and a turn of role t: the shortest way along NEXT."""
    ways = [(s, [])]
    for at, via in ways:
        if t in NEXT[at]:
            return via
        if len(via) < 3:
            ways += [(x, [*via, x]) for x in NEXT[at]]
    return None


INSERTED = {(s, t): _path(s, t) for s in range(4) for t in (1, 2, 3)}
CLOSING = {s: [] if s == LAST else [*INSERTED[s, LAST], LAST] for s in range(4)}


def step(role: int) -> list[list[int]]:
    """Costs of a turn of this role (0: unknown) from each state to each."""
    m = [[NEVER] * 4 for _ in range(4)]
    for s in range(4):
        for t in (1, 2, 3):
            label = 0 if role == t else (RELABEL if role else NAME)
            ways = [MERGE] if s == t else []
            if INSERTED[s, t] is not None:
                ways.append(INSERT * len(INSERTED[s, t]))
            if ways:
                m[s][t] = label + min(ways)
    return m


STEPS = [step(r) for r in range(4)]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(min(a[i][k] + b[k][j] for k in range(4)), NEVER) for j in range(4)] for i in range(4)]


def best_path(matrices: list[list[list[int]]], first: int, last: int | None) -> list[int]:
    """States after each matrix on the cheapest path; ``last`` None: the state that is cheapest with its closing turns."""
    cost, rows = [0 if s == first else NEVER for s in range(4)], []
    for m in matrices:
        rows.append(cost)
        cost = [min(cost[s] + m[s][t] for s in range(4)) for t in range(4)]
    if last is None:
        last = min(range(4), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), s))
    out = []
    for m, before in zip(reversed(matrices), reversed(rows), strict=True):
        out.append(last)
        last = min(range(4), key=lambda s, t=last: (before[s] + m[s][t], s))
    return out[::-1]


def repair(roles: list[int], texts: list[str], first: int, last: int | None) -> tuple[int, int, int, int, str]:
    """merged, relabelled, inserted, cost and the rendered text of a piece between two states; ``last`` None at the end."""
    merged = relabelled = inserted = cost = 0
    state, out = first, []

    def insert(role: int) -> None:
        nonlocal inserted, cost
        inserted, cost = inserted + 1, cost + INSERT
        out.append(f"<|{ROLES[role]}|>\n\n")

    for role, text, to in zip(roles, texts, best_path([STEPS[r] for r in roles], first, last), strict=True):
        if role != to:
            relabelled, cost = relabelled + 1, cost + (RELABEL if role else NAME)
        if state == to and (INSERTED[state, to] is None or MERGE <= INSERT * len(INSERTED[state, to])):
            merged, cost = merged + 1, cost + MERGE
            out.append(f"{text}\n")
        else:
            for r in INSERTED[state, to]:
                insert(r)
            out.append(f"<|{ROLES[to]}|>\n{text}\n")
        state = to
    if last is None:
        for r in CLOSING[state]:
            insert(r)
    return merged, relabelled, inserted, cost, "".join(out)


def pieces(turns: DataFrame) -> DataFrame:
    """no (rising along each conversation), conv_id, roles, texts, costs: the cut and sorted turns."""
    role = F.lower(F.trim("role"))
    code = F.when(role == "system", 1).when(role == "user", 2).when(role == "assistant", 3).otherwise(0)
    rows = turns.select("conv_id", "turn", code.alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text", "row"]
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, size = 0, None, 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [[x[i] for x in done] for i in range(4)]
            matrices = []
            for x in done:
                m = STEPS[x[2][0]]
                for r in x[2][1:]:
                    m = product(m, STEPS[r])
                matrices.append([c for line in m for c in line])
            types = (pa.int64(), id_type, pa.list_(pa.int32()), pa.list_(pa.string()))
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(matrices, pa.list_(pa.int64()))], ["no", "conv_id", "roles", "texts", "costs"])

        for b in batches:
            id_type = column(b, "conv_id").type
            for conv, role, text, part in zip(*(column(b, c).to_pylist() for c in ("conv_id", "role", "text", "part")), strict=True):
                if open_ is None or conv != open_[1] or len(open_[2]) == PIECE or size > PIECE_BYTES:
                    if open_ is not None:
                        done.append(open_)
                        if len(done) >= 2000 or size > PIECE_BYTES:
                            yield flush()
                            done = []
                    open_, size = ((part << 32) + number, conv, [], []), 0
                    number += 1
                open_[2].append(role)
                open_[3].append(text)
                size += len(text)
        if open_ is not None:
            done.append(open_)
            yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"no long, conv_id {kind}, roles array<int>, texts array<string>, costs array<long>")


def chat_format(turns: DataFrame) -> DataFrame:
    """One row per conversation or part of one, as the module says."""
    held = written(pieces(turns), "turns")
    along = held.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", F.size("roles").alias("turns"), "costs"))).alias("m")).select("m")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in column(b, "m").to_pylist():
                chain = [[x["costs"][4 * i : 4 * i + 4] for i in range(4)] for x in m]
                ends = best_path(chain, 0, None)
                turns = 0
                for i, (x, s, e) in enumerate(zip(m, [0, *ends[:-1]], ends, strict=True)):
                    out.append((x["no"], turns // PIECE, s, e if i + 1 < len(m) else -1))
                    turns += x["turns"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, ["no", "part", "first", "last"])

    placed = held.join(along.mapInArrow(states, "no long, part long, first long, last long"), "no")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for roles, texts, first, last in zip(*(column(b, c).to_pylist() for c in ("roles", "texts", "first", "last")), strict=True):
                got.append((len(roles), *repair(roles, texts, first, None if last < 0 else last)))
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)] + [pa.array([g[5] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("conv_id", "part", "no")), *cols], ["conv_id", "part", "no", *NUMBERS, "text"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, part long, no long, {', '.join(f'{c} long' for c in NUMBERS)}, text string"
    rendered = placed.select("conv_id", "part", "no", "roles", "texts", "first", "last").mapInArrow(render, fields)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "")
    return rendered.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in NUMBERS], text.alias("text"))
