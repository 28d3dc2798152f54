"""Traversal from many origins with caps, and limits that the running job counts."""

import random

import pytest
from pyspark.sql import functions as F

from siltwork.functions import checks
from siltwork.operators import graphs


def plain(edges, origin, direction, depth, max_nodes, max_edges):
    """One origin, node by node."""
    out, back = {}, {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    join = lambda x, y: x if x == y else "both"
    far, how, frontier, cut = {origin: 0}, {origin: "origin"}, {origin: None}, False
    for d in range(1, depth + 1):
        nxt, start = [], dict(frontier)
        for a in sorted(start):
            near = [(b, start[a] or "dependency") for b in out.get(a, []) if direction != "imported-by"] + [(b, start[a] or "dependent") for b in back.get(a, []) if direction != "imports"]
            for b, relation in sorted(near):
                if b not in far:
                    if len(far) >= max_nodes:
                        cut = True
                        continue
                    far[b], how[b] = d, relation
                    nxt.append(b)
                elif b != origin:
                    how[b] = join(how[b], relation)
        frontier = {b: how[b] for b in nxt}
    inside = [e for e in sorted(set(edges)) if e[0] in far and e[1] in far]
    return {(n, far[n], how[n]) for n in far}, inside[:max_edges], cut or len(inside) > max_edges


@pytest.mark.parametrize(("direction", "nodes", "edges_"), [("both", 9, 7), ("imports", 4, 100), ("imported-by", 100, 100)])
def test_many_origins_equal_each_alone(spark, direction, nodes, edges_):
    rng = random.Random(nodes)
    e = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(60)]
    df = spark.createDataFrame(e, "source string, target string")
    origins = sorted({a for a, _ in e})[:8]
    got = graphs.traverse_many(df, spark.createDataFrame([(o,) for o in [*origins, origins[0], None]], "origin string"), direction, 3, nodes, edges_)
    found, inside, stats = ({}, {}, {r["origin"]: (r["nodes"], r["edges"], r["truncated"]) for r in got["stats"].collect()})
    for r in got["nodes"].collect():
        found.setdefault(r["origin"], set()).add((r["path"], r["distance"], r["relation"]))
    for r in got["edges"].collect():
        inside.setdefault(r["origin"], []).append((r["source"], r["target"]))
    for o in origins:
        want, want_edges, cut = plain(e, o, direction, 3, nodes, edges_)
        assert {x[:2] for x in found[o]} == {x[:2] for x in want} and sorted(inside.get(o, [])) == want_edges
        assert stats[o] == (len(want), len(want_edges), cut)
        if nodes == 100:
            assert found[o] == want
    assert set(stats) == set(origins)


def test_limits_are_counted_by_the_job(spark):
    limits = checks.Limits()
    df = limits.on(spark.range(10).withColumn("v", F.col("id") * 2), rows=(F.lit(1), 10), total=(F.col("v"), 90))
    df.checkpoint()
    assert limits.check() == {"rows": 10, "total": 90}
    limits = checks.Limits()
    limits.on(spark.range(11), rows=(F.lit(1), 10)).checkpoint()
    with pytest.raises(checks.BoundExceeded, match="rows: 11"):
        limits.check()


@pytest.mark.parametrize(("limit", "just"), [("MAX_FILES", 3), ("MAX_IMPORTS", 4), ("MAX_EDGES", 3)])
def test_limits_of_import_graphs(spark, monkeypatch, limit, just):
    files = spark.createDataFrame([("a.ts", "typescript", ["./b", "./c"]), ("b.ts", "typescript", ["./c", "none"]), ("c.ts", "typescript", None)], "path string, language string, imports array<string>")
    monkeypatch.setattr(graphs, limit, just)
    assert graphs.import_graph(files)["edges"].count() == 3
    monkeypatch.setattr(graphs, limit, just - 1)
    with pytest.raises(checks.BoundExceeded, match=limit.split("_")[1].lower()):
        graphs.import_graph(files)


@pytest.mark.parametrize(("limit", "just"), [("MAX_SYMBOLS", 3), ("MAX_REFERENCES", 3), ("MAX_EDGES", 3)])
def test_limits_of_symbol_graphs(spark, monkeypatch, limit, just):
    files = spark.createDataFrame([("1", "a.ts", "typescript")], "id string, path string, language string")
    symbols = spark.createDataFrame([("s", "1", "f", "function", 1, 2, ["g", "h"]), ("t", "1", "g", "function", 3, 4, ["g"]), ("u", "1", "h", "function", 5, 6, [])], "id string, file_id string, name string, type string, start_line int, end_line int, references array<string>")
    monkeypatch.setattr(graphs, limit, just)
    assert graphs.symbol_graph(files, symbols)["edges"].count() == 3
    used = graphs.where_used(symbols, "g")
    assert used["references"].count() == 2 and [r["file_id"] for r in used["files"].collect()] == ["1"]
    monkeypatch.setattr(graphs, limit, just - 1)
    with pytest.raises(checks.BoundExceeded, match=limit.split("_")[1].lower()):
        graphs.symbol_graph(files, symbols)


def test_related_says_whether_there_were_more(spark):
    e = spark.createDataFrame([("a", f"t{i}") for i in range(12)] + [("b", "t1")], "source string, target string")
    got = graphs.related(spark.createDataFrame([("a",), ("b",)], "origin string"), e, limit=10).collect()
    assert {(r["origin"], r["truncated"]) for r in got} == {("a", True), ("b", False)} and sum(r["origin"] == "a" for r in got) == 10


def test_components_send_counts_alone_to_the_driver(spark, monkeypatch):
    """Random digraphs against a plain search; no step broadcasts a side of its joins, and a chain of cycles is cut in few rounds."""
    rng = random.Random(3)
    nodes = 160
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(190)} | {(7, 7)}
    pairs |= {(1000 + i, 1000 + i + 1) for i in range(40)} | {(1000 + i + 1, 1000 + i) for i in range(0, 40, 4)}  # two nodes, then a chain on
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in {x for p in pairs for x in p}}
    want = {(min(b for b in far[a] if a in far[b]), a) for a in far if a in far[a]}
    plans, frame = [], type(spark.range(1))
    with monkeypatch.context() as m:
        m.setattr(frame, "checkpoint", lambda self, f=frame.checkpoint: (plans.append(self._jdf.queryExecution().executedPlan().toString()), f(self))[1])
        got = {tuple(r) for r in graphs.strongly_connected(spark.createDataFrame(sorted(pairs), "source long, target long"), most_rounds=4).collect()}
    assert got == want and len({c for c, _ in want}) > 10
    assert not any("Broadcast" in p for p in plans)


def test_components_take_several_steps_between_checkpoints(spark, monkeypatch):
    """A ring of 40 nodes, whose least label goes round it, and a chain that leads out of it; labels are dealt once a step."""
    pairs = [(i, (i + 1) % 40) for i in range(40)] + [(100 + i, 101 + i) for i in range(3)] + [(3, 100), (200, 201), (201, 200), (39, 200)]
    plans, frame = [], type(spark.range(1))
    with monkeypatch.context() as m:
        m.setattr(frame, "checkpoint", lambda self, f=frame.checkpoint: (plans.append(self._jdf.queryExecution().executedPlan().toString()), f(self))[1])
        got = {tuple(r) for r in graphs.strongly_connected(spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert got == {(0, i) for i in range(40)} | {(200, 200), (200, 201)}
    assert len(plans) < 40
    most = max(plans, key=lambda p: p.count("SortMergeJoin"))
    assert most.count("Exchange") <= 2 * most.count("SortMergeJoin") + 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_what_a_round_leaves_is_one_jobs_work(spark, monkeypatch, kind):
    """Rings that lead into each other, so that a round finds but one or two of them: at most a spread, not one a round; without ``FEW`` the same."""
    name = (lambda i: i) if kind == "long" else (lambda i: f"n{i:03}")
    rings = [[10 * c + i for i in range(4)] for c in range(12)]
    pairs = [(r[i], r[(i + 1) % 4]) for r in rings for i in range(4)] + [(a[1], b[2]) for a, b in zip(rings, rings[1:])] + [(rings[0][0], 500), (501, rings[5][1]), (502, 502)]
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"source {kind}, target {kind}")
    want = {(name(r[0]), name(i)) for r in rings for i in r} | {(name(502), name(502))}
    spreads, spread = [], graphs._spread
    monkeypatch.setattr(graphs, "_spread", lambda e: (spreads.append(1), spread(e))[1])
    assert {tuple(r) for r in graphs.strongly_connected(edges).collect()} == want
    assert len(spreads) == 1
    if kind == "long":
        monkeypatch.setattr(graphs, "FEW", 0)
        assert {tuple(r) for r in graphs.strongly_connected(edges).collect()} == want
        assert len(spreads) > 2


def test_a_large_component_is_not_one_tasks_work(spark):
    """A ring of most of the nodes, with loops inside and outside of components; no task reads all rows of the ring."""
    pairs = [(i, (i + 1) % 30) for i in range(30)] + [(0, 0), (5, 5), (40, 40), (41, 40), (50, 51), (51, 50), (3, 60)]
    got = graphs.strongly_connected(spark.createDataFrame(pairs, "source long, target long"))
    assert sorted(map(tuple, got.collect())) == sorted([(0, i) for i in range(30)] + [(40, 40), (50, 50), (50, 51)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "count(" not in plan and "Join Inner" not in plan
