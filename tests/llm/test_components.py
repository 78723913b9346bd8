"""Connected components: few steps where the edges are stars already, and no row per signature of a large bucket."""

from barspark.llm import components, ngram_join


def test_stars_need_no_round(spark, monkeypatch):
    names = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: names.append(name) or f(df, name))
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 400)] + [(1000, 1001), (5, 5)], "a long, b long").coalesce(1)
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(400)} | {1000: 1000, 1001: 1000}
    assert names == ["edges", "components"]  # a task ties its edges before any round


def test_edges_of_many_tasks(spark):
    edges = [(i, (7 * i + 3) % 500) for i in range(0, 500, 2)] * 3 + [(i + 1000, i + 1001) for i in range(60)]
    want = {i: i for e in edges for i in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((a, b) for a, b in want.items() if {a, b} & {x for e in edges if e[0] != e[1] for x in e})


def test_a_large_bucket_is_tied_without_a_row_per_signature(spark):
    n, sigs = ngram_join.SMALL * 3, list(range(40))
    rows = [(i, 100 + i % 30, i, b"\xff" * 32, 200, sigs) for i in range(n)]
    got = ngram_join.proposals(spark.createDataFrame(rows, ngram_join.SIGNED), 90)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array(FLOOR" not in plan.replace("array(cast(FLOOR", "array(FLOOR")  # no two rows of each signature and set
    edges = [tuple(r) for r in got.collect()]
    assert len(edges) <= 2 * n
    group = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    size = {r[0]: r[1] for r in rows}
    assert all(group[a] == group[b] for a in size for b in size if 90 * max(size[a], size[b]) <= 100 * min(size[a], size[b]))


def test_large_buckets_are_tied_without_a_join_of_their_signatures(spark):
    n, sigs = ngram_join.SMALL * 3, list(range(40))
    rows = [(i, (100, 109, 400)[i % 3], i, b"\xff" * 32, 200, sigs) for i in range(n)]
    got = ngram_join.proposals(spark.createDataFrame(rows, ngram_join.SIGNED), 90)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("band" in line for line in joins)  # else a row of each signature and set
    found = components.components(got).filter("node >= 0").collect()
    group = {r["node"]: r["component"] for r in found}
    assert sorted(group) == list(range(n))
    assert len({group[i] for i in range(n) if i % 3 < 2}) == 1 and len({group[i] for i in range(2, n, 3)}) == 1 and group[0] != group[2]
