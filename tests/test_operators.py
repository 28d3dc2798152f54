"""Golden cases of single operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltwork.functions import checks
from siltwork.functions import text as X
from siltwork.operators import answers, chunks, evaluation, graphs, maintenance, report, symbols, vectors
from siltwork.sources import files


def test_binary_detection_reads_all_documents(spark, tmp_path):
    import duckdb

    from siltwork.plans import catalog

    cases = {"short": False, "\x01" * 3: True, "x" * 9000: False, "x" * 8191 + "é" * 10: False, "x" * 8190 + "😀" * 9: False, "😀" * 3000: False, "x" * 7000 + "\x01" * 2000: True, "x" * 8192 + "\x01" * 9000: False, "é" * 3500 + "\x02" * 1192 + "x" * 9: True, "": False}
    rows = list(enumerate(cases))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalog.queries()["binary_detection"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(c.sql(catalog.oracle_sql()["binary_detection"]).fetchall()) == {k: cases[t] for k, t in rows}


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_windows(spark):
    rows = [(k, "\n".join(f"line {i}" for i in range(n))) for k, n in ((1, 250), (2, 120), (3, 121))] + [(4, "a\n"), (5, "a\r\nb\rc"), (6, "")]
    got = [tuple(r) for r in chunks.windows(spark.createDataFrame(rows, "k int, content string")).orderBy("k", "chunk_index").select("k", "start_line", "end_line").collect()]
    assert got == [(1, 1, 120), (1, 101, 220), (1, 201, 250), (2, 1, 120), (3, 1, 120), (3, 101, 121), (4, 1, 2), (5, 1, 3)]
    with pytest.raises(ValueError):
        chunks.windows(spark.createDataFrame(rows, "k int, content string"), size=5, overlap=5)


def test_paths(spark):
    for a, b in (("a/./b//c/../d", "a/b/d"), ("../x/..", ".."), ("/../a", "/a"), ("a/..", "."), ("", ".")):
        assert one(spark, X.normalize_path(F.lit(a))) == b
    assert one(spark, X.import_candidates(F.lit("src/a.ts"), F.lit("./user.service"))) == ["src/user.service"]
    assert one(spark, X.import_candidates(F.lit("src/a.ts"), F.lit("./x.js"))) == ["src/x.js", "src/x.ts", "src/x.tsx", "src/x.mts", "src/x.cts"]
    assert len(one(spark, X.import_candidates(F.lit("src/a.ts"), F.lit("../lib")))) == 19
    assert one(spark, X.import_candidates(F.lit("a.ts"), F.lit("../out"))) == []
    assert one(spark, X.internal_specifier(F.lit("react"))) is None
    assert one(spark, X.internal_specifier(F.lit("./m?raw"))) == "./m"
    assert one(spark, X.canonical_path(F.lit("src\\a\\..\\b.ts"))) == "src/b.ts"
    assert one(spark, X.canonical_path(F.lit("../b.ts"))) is None
    for p, layer in (("src/controllers/a.ts", "controller"), ("src/user.service.ts", "service"), ("src/controller.ts", None), ("models/x.ts", "model")):
        assert one(spark, X.path_layer(F.lit(p))) == layer
    assert one(spark, X.language_of(F.lit(".gitignore"))) == "unknown"


def test_questions(spark):
    cases = {
        "Explain src/app/main.ts please": "file_specific", "Where is `verifyToken`?": "exact_symbol", "Describe the overall design": "architecture", "What imports does it have": "dependency",
        "show the endpoint": "api_flow", "which database is it": "database", "the environment": "configuration", "give an example": "usage", "hello there": "semantic",
    }
    for q, want in cases.items():
        assert one(spark, X.question_class(F.lit(q))) == want
    for q, want in (("Find UserService", "UserService"), ("Where is helper() defined?", "helper"), ("Where is the config file?", None)):
        assert one(spark, X.exact_symbol(F.lit(q))) == want


def test_utf16_and_uuid(spark):
    assert one(spark, X.utf16_length(F.lit("a\U0001f600b"))) == 4
    assert one(spark, X.utf16_prefix(F.lit("a\U0001f600b"), F.lit(2))) == "a"
    u = one(spark, X.uuid_of(F.lit("x"), F.lit(1)))
    assert u[14] == "8" and u[19] in "89ab" and len(u) == 36


def test_policy_and_snapshot(spark, tmp_path):
    keep = ["a.ts", "b.md", "src/c.jsx", "generated/keep.ts"]
    for p, content in {**{k: b"x" for k in keep}, "n.txt": b"x", "node_modules/x.ts": b"x", ".env": b"x", "yarn.lock": b"x", "x.min.js": b"x", "generated/a.ts": b"x", "ignored/z.ts": b"x", "bin.ts": b"a\0b", "bom.ts": b"\xef\xbb\xbfhi", ".gitignore": b"ignored/\ngenerated/*\n!generated/keep.ts\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(content)
    accepted, excluded = files.snapshot(spark, str(tmp_path))
    got = {r["path"]: r["content"] for r in accepted.collect()}
    assert sorted(got) == sorted([*keep, "bom.ts"]) and got["bom.ts"] == "hi"
    assert {r["path"]: r["reason"] for r in excluded.collect()} == {
        "n.txt": "unsupported_extension", "node_modules/x.ts": "default_ignored_directory", ".env": "secret_file", "yarn.lock": "lock_file", "x.min.js": "generated_file", "generated/a.ts": "gitignore", "ignored/z.ts": "gitignore", "bin.ts": "binary_file", ".gitignore": "gitignore_file",
    }
    with pytest.raises(checks.BoundExceeded):
        files.snapshot(spark, str(tmp_path), max_files=2)
    nested = {"src": "*.ts\n!important.ts\n"}
    assert files.ignored("src/a.ts", nested) and not files.ignored("src/important.ts", nested) and not files.ignored("a.ts", nested)
    assert files.ignored("x/build/y.ts", {"": "build/"}) and not files.ignored("build", {"": "build/"}) and files.ignored("a/b/c.ts", {"": "/a/**"})


def test_diff_modes(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, content_hash string")
    old = spark.createDataFrame([("a", "1", "ts", 4), ("b", "x", "ts", 2), ("d", "9", "ts", 1)], "file_path string, content_hash string, language string, chunk_count long")
    plan = maintenance.diff(cur, old)
    assert {r["file_path"]: r["status"] for r in plan.collect()} == {"a": "retained", "b": "changed", "c": "changed", "d": "removed"}
    new = spark.createDataFrame([("b", "js", 3), ("c", "ts", 1)], "file_path string, language string, chunk_count long")
    total = maintenance.rollup(plan, old, new).first()
    assert (total["total_files"], total["total_chunks"], total["languages"]) == (3, 8, {"ts": 2, "js": 1})
    full = maintenance.diff(cur, old.withColumn("chunk_count", F.when(F.col("file_path") != "d", F.col("chunk_count"))))
    assert {r["status"] for r in full.collect()} == {"changed", "removed"} and full.first()["mode"] == "full"
    with pytest.raises(checks.InvalidRows):
        maintenance.upsert(old, old.unionByName(old), "file_path")


GOLDEN = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "a"), ("f", "e"), ("x", "b")]


def test_traverse(spark):
    e = spark.createDataFrame(GOLDEN, "source string, target string")
    got = {(r["path"], r["distance"], r["relation"]) for r in graphs.traverse(e, "a").collect()}
    assert got == {("a", 0, "origin"), ("b", 1, "dependency"), ("c", 1, "dependency"), ("e", 1, "dependent"), ("d", 2, "dependency"), ("f", 2, "dependent"), ("x", 2, "dependency")}
    assert {r["path"] for r in graphs.traverse(e, "a", "imports", 1).collect()} == {"a", "b", "c"}
    assert {r["path"] for r in graphs.traverse(e, "a", max_nodes=3).collect()} == {"a", "b", "c"}


def test_related(spark):
    e = spark.createDataFrame(GOLDEN, "source string, target string")
    sym = spark.createDataFrame([("a", "b")], "source string, target string")
    flow = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    members = spark.createDataFrame([(1, p) for p in "abcd"], "flow int, path string")
    got = graphs.related(spark.createDataFrame([("a",)], "origin string"), e, sym, flow, members).orderBy("rank").collect()
    assert [(r["path"], r["score"]) for r in got] == [("b", 330), ("c", 160), ("d", 100), ("e", 95), ("f", 35), ("x", 30)]
    assert got[0]["reasons"] == ["DIRECT_IMPORT", "APPLICATION_FLOW", "SYMBOL_REFERENCE", "SAME_APPLICATION_FLOW"]


def test_components(spark):
    e = spark.createDataFrame([("self", "self"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "a")], "source string, target string")
    got = {(r["component"], r["node"]) for r in graphs.strongly_connected(e).collect()}
    assert got == {("self", "self"), ("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("c", "e")}


def _project(spark):
    f = spark.createDataFrame([("1", "src/routes.ts", "typescript", ["./services/user.service.js"]), ("2", "src/services/user.service.ts", "typescript", []), ("3", "src/models/user.model.ts", "typescript", [])], "id string, path string, language string, imports array<string>")
    s = spark.createDataFrame(
        [("r", "1", "GET /u", "express_route", 1, 3, ["handle"]), ("h", "1", "handle", "function", 4, 6, ["UserService"]), ("s", "2", "UserService", "class", 1, 9, ["User"]), ("m", "3", "User", "variable", 1, 2, [])],
        "id string, file_id string, name string, type string, start_line int, end_line int, references array<string>",
    )
    return f, s


def test_flow_and_report(spark):
    f, s = _project(spark)
    flow = graphs.flow_graph(f, s)
    assert [(r["nodes"], r["complete"]) for r in flow["flows"].collect()] == [(["r", "h", "s", "m"], True)]
    with pytest.raises(LookupError):
        graphs.flow_graph(f, s, route="GET /none")
    a = report.architecture(f, s)
    assert a["metrics"]["complete_flows"] == 1 and a["metrics"]["internal_imports"] == 1 and a["risks"] == []
    assert "  F0 --> F1" in a["diagrams"]["imports"]["mermaid"].replace("F1 --> F2", "F0 --> F1") and 'A0 -->|"handle"| A1' in a["diagrams"]["flow"]["mermaid"]
    used = graphs.where_used(s, "User")
    assert [r["id"] for r in used["references"].collect()] == ["s"]


SOURCE = """import React, { type FC } from 'react';
import express from "express";
const { Router } = require('express');
export interface UserRecord { id: string }
export class UserService {
  find(id: string) { return load(id); }
}
export const UserCard: FC = () => { return null; };
// comment with { brace
app.get('/users', async (req, res) => {
  res.json(new UserService().find(req.id));
});
export function getUser(id) { return `x${id}`; }
"""


def test_symbols(spark):
    p = symbols.parse(SOURCE, "src/view.tsx")
    assert {(s.type, s.name, s.start, s.end) for s in p.symbols} >= {("interface", "UserRecord", 4, 4), ("service", "UserService", 5, 7), ("method", "find", 6, 6), ("express_route", "GET /users", 10, 12), ("function", "getUser", 13, 13), ("react_component", "UserCard", 8, 8)}
    assert p.exports == ["UserRecord", "UserService", "UserCard", "getUser"] and {"react", "React", "FC", "express"} <= set(p.imports)
    assert symbols.parse("function a( {", "a.ts").strategy == "line_fallback"
    f = spark.createDataFrame([("src/view.tsx", "tsx", SOURCE), ("a.md", "markdown", "x\ny")], "path string, language string, content string")
    rows = symbols.symbol_chunks(f, symbols.extract(f)).collect()
    assert {r["strategy"] for r in rows} == {"parsed", "line"} and [r["chunk_index"] for r in rows if r["path"] == "a.md"] == [0]


def test_budgets_and_citations(spark):
    src = spark.createDataFrame([(1, 1, "x", "f.ts", "typescript", 1, 9, "c" * 2000), (1, 2, "x", "f.ts", "typescript", 1, 9, "dup"), (1, 3, "y", "g[.ts", "typescript", 2, 3, "no")], "question_id int, rank int, id string, file_path string, language string, start_line int, end_line int, content string")
    b = answers.context(src, 300, kind=None, name=None).collect()
    assert len(b) == 1 and answers.CUT in b[0]["block"] and len(b[0]["block"]) == 300
    h = spark.createDataFrame([(1, 0, "user", "x" * 30), (1, 1, "assistant", "short")], "conv_id int, turn int, role string, text string")
    assert [r["turn"] for r in answers.history(h, 40).collect()] == [1]
    blocks = answers.context(src, 100_000, kind=None, name=None)
    out = spark.createDataFrame([(1, '{"segments":[{"text":" one ","sourceIds":["S2","S1","S2"]},{"text":"two","sourceIds":["S2"]}]}'), (2, '{"segments":[]}'), (3, '{"segments":[{"text":"a [S1]","sourceIds":["S1"]}]}'), (4, "nope"), (5, '{"segments":[{"text":"a","sourceIds":["S1"],"more":1}]}')], "question_id int, output string")
    s = answers.structured(out)
    assert [r["valid"] for r in s.orderBy("question_id").collect()] == [True, False, False, False, False]
    c = answers.cited(s.where("valid"), blocks).first()
    assert c["answer"] == "one [g%5B.ts:L2-L3] [f.ts:L1-L9]\n\ntwo [g%5B.ts:L2-L3]" and [x["reference"] for x in c["citations"]] == ["S2", "S1"]


def test_ask(spark):
    texts = ["def verify token signature", "database schema of users", "render the page"]
    v = vectors.hashing_embedder(texts).tolist()
    points = spark.createDataFrame([(k, t, "f%d.ts" % k, "typescript", 1, 5, k, n, [], x) for k, (t, n, x) in enumerate(zip(texts, ["verifyToken", "User", "Page"], v, strict=True))], "point_id long, content string, file_path string, language string, start_line int, end_line int, chunk_index int, symbol_name string, references array<string>, embedding array<float>").withColumn("symbol_type", F.lit("function"))
    q = spark.createDataFrame([(1, "Where is `verifyToken`?"), (2, "users schema")], "question_id long, question string")
    got = {r["question_id"]: r for r in answers.ask(q, points).collect()}
    assert got[1]["category"] == "exact_symbol" and got[1]["citations"][0]["file_path"] == "f0.ts" and got[2]["category"] == "database"
    conversations, messages = answers.exchange(q, answers.ask(q, points))
    assert conversations.count() == 2 and messages.count() == 4


def test_evaluation(spark, tmp_path):
    cases = spark.createDataFrame([("c", "q", ["a.ts", "b.ts"], ["A", "B"], [("a.ts", 5, 8)], [("k", ["jwt", "token"]), ("l", ["redis"])], ["mongo"], []), ("miss", "q", ["a.ts"], None, None, None, None, None)], evaluation.CASE)
    obs = spark.createDataFrame([("c", "Uses  JWT", [("1", "a.ts", "A", 1, 10, .9), ("2", "c.ts", None, 1, 2, .8), ("3", "b.ts", None, 1, 3, .7), ("4", "a.ts", None, 20, 30, .6)], [("a.ts", None, 4, 6), ("z.ts", None, 1, 1)], (40.0, 1200.0, None), (1000, 100, 50), {})], evaluation.OBSERVATION)
    s = evaluation.score(cases, obs, {"embedding": 0.02, "input": 2.0, "output": 8.0})
    r = {x["id"]: x for x in s.collect()}
    c = r["c"]
    assert (c["recall_at_5"], c["precision_at_5"], c["precision_at_10"], c["mean_reciprocal_rank"], c["exact_symbol_hit_rate"], c["line_hit_rate"]) == (1, 0.4, 0.2, 1, 0.5, 1)
    assert (c["citation_precision"], c["citation_recall"], c["groundedness"], c["citation_f1"], c["completeness"], c["hallucination_rate"]) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert abs(c["total_usd"] - 0.00062) < 1e-12 and r["miss"]["success"] is False and r["miss"]["hallucination_rate"] == 0 and r["miss"]["line_hit_rate"] is None
    row = evaluation.report("d", s, {"minimumRecallAt5": 0.9, "maximumIndexingP95Ms": 5}, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 1)).first()
    assert row["passed"] is False and {v["metric"] for v in row["violations"]} == {"recall_at_5", "indexing_p95_ms"} and row["duration_ms"] == 1000
    with pytest.raises(checks.InvalidRows):
        evaluation.score(cases.where("id = 'miss'"), obs)
    assert {(x["case"], x["problem"]) for x in evaluation.problems(cases.unionByName(cases.where("id = 'c'"))).collect()} == {("c", "repeated id")}
    assert evaluation.main(["--nothing"]) == 2


def test_vectors(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, query array<float>")
    assert [(r["vec_id"], round(r["score"], 3)) for r in vectors.top_k(p, q).orderBy("rank").collect()] == [(0, 1.0), (2, 0.707), (1, 0.0)]
    assert [r["id"] for r in vectors.nearest(p.withColumnRenamed("vec_id", "id"), [1, 0], 2).collect()] == [0, 2]
    t = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z")], "id string, text string")
    e = vectors.embed(t).collect()
    assert len(e) == 3 and len({r["input_hash"] for r in e}) == 2
    with pytest.raises(ValueError):
        vectors.top_k(p, q, k=51)


def test_names(spark):
    r = one(spark, X.repository_url(F.lit("https://github.com/some-owner/a.repo.git")))
    assert (r["full_name"], r["name"]) == ("some-owner/a.repo", "a.repo")
    for u in ("http://github.com/a/b", "https://example.com/a/b", "https://github.com/a/b/c", "https://github.com/a/b?x"):
        assert one(spark, X.repository_url(F.lit(u))) is None
    for b, ok in (("main", True), ("feat/x", True), ("-x", False), ("a..b", False), ("a.lock", False), ("a/.b", False), ("", False), ("a b", False)):
        assert one(spark, X.valid_branch(F.lit(b))) is ok


def test_index_snapshot(spark, tmp_path):
    from siltwork.operators import indexing

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("import { b } from './b';\nexport function run() { return b(); }\n")
    (tmp_path / "src/b.ts").write_text("export const b = () => 1;\n")
    scope = {"user_id": "u", "repository_id": "r", "branch": "main", "commit_sha": "c1"}
    first = {k: v.checkpoint() for k, v in indexing.index_snapshot(spark, str(tmp_path), scope).items()}
    assert {r["file_path"]: r["status"] for r in first["plan"].collect()} == {"src/a.ts": "changed", "src/b.ts": "changed"}
    (tmp_path / "src/b.ts").write_text("export const b = () => 2;\n")
    (tmp_path / "c.md").write_text("# notes\n")
    second = indexing.index_snapshot(spark, str(tmp_path), scope | {"commit_sha": "c2"}, first["files"], first["points"], "c1")
    assert {r["file_path"]: r["status"] for r in second["plan"].collect()} == {"src/a.ts": "retained", "src/b.ts": "changed", "c.md": "changed"}
    points = indexing.duplicate_free(second["points"]).collect()
    assert {r["commit_sha"] for r in points} == {"c2"} and {r["file_path"] for r in points} == {"src/a.ts", "src/b.ts", "c.md"}
    assert {(r["file_path"], r["name"]) for r in second["symbols"].collect()} == {("src/b.ts", "b")}


def test_jobs_and_metrics(spark):
    import json

    from siltwork.operators import indexing

    good = {"repositoryId": "a" * 24, "userId": "b" * 24, "repositoryUrl": "https://example.org/x", "requestedAt": "2024-05-01T10:00:00.000Z"}
    rows = [good, good | {"branch": "main"}, good | {"more": 1}, good | {"requestedAt": "2024-05-01"}, good | {"requestedAt": "2024-02-31T10:00:00.000Z"}, good | {"userId": "x"}, good | {"branch": " x"}]
    got = indexing.parse_jobs(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(7, "{")], "k int, body string")).orderBy("k").collect()
    assert [r["valid"] for r in got] == [True, True, False, False, False, False, False, False]
    lines = indexing.exposition(spark.createDataFrame([('a"b', 3)], "route string, value long"), "http_requests_total", ["route"]).collect()
    assert [r["line"] for r in lines] == ["# TYPE http_requests_total counter", 'http_requests_total{route="a\\"b"} 3']
    assert one(spark, indexing.failure_class(F.lit(429)))["retryable"] and not one(spark, indexing.failure_class(F.lit(400)))["retryable"]
    assert one(spark, indexing.retry_delay(F.lit(3))) == 20.0


def test_ranked_metrics_of_groups_make_no_pairs(spark):
    """40 queries of 2 groups with 300 items each: the rows of an aggregation follow the items, and the metrics are those of the expanded pairs."""
    results = spark.createDataFrame([(q, (q * 7 + r * r) % 640, r) for q in range(40) for r in range(1, 16)], "query_id long, item long, rank int")
    groups = spark.createDataFrame([(q, q % 3) for q in range(40)], "query_id long, label int")
    items = spark.createDataFrame([(i % 2, i) for i in range(600)], "label int, item long")
    got = evaluation.ranked_metrics(results, items.unionByName(items), groups=groups, group="label")
    want = evaluation.ranked_metrics(results, groups.join(items, "label"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 27
    assert evaluation.ranked_metrics(results.limit(0), items, groups=groups, group="label").where("recall_at_10 = 0").count() == 27
