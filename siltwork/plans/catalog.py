"""All registered queries: the library's operators over the whole driver tables, each with SQL for the same rows.

The tables stand in for the data model: documents for files and chunks, embeddings for stored points, orders
and parts for symbols and references, regions to orders for layers, events for deliveries and metric samples.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.operators import answers, chunks, evaluation, graphs, ivf, maintenance, report, vectors
from siltwork.sources import files, manifest, session
from siltwork.streaming import events as streams
from siltwork.streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

SCOPE = {"user_id": "b" * 24, "repository_id": "a" * 24, "branch": "main", "commit_sha": "c" * 40}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.shared_folder(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def query(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- chunks and identifiers --

_LINES = "SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS ls FROM documents WHERE length(text) > 0"
_WINDOWS = f"""SELECT doc_id, k AS chunk_index, 1 + 6 * k AS start_line, least(6 * k + 8, len(ls)) AS end_line, array_to_string(ls[6 * k + 1 : 6 * k + 8], chr(10)) AS content
  FROM (SELECT doc_id, ls, unnest(range(CASE WHEN len(ls) <= 8 THEN 1 ELSE 1 + CAST(ceil((len(ls) - 8) / 6.0) AS BIGINT) END)) AS k FROM ({_LINES}))"""


def _windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return chunks.windows(docs, size=8, overlap=2)


@query(f"SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sha256(content) AS content_hash FROM ({_WINDOWS})")
def chunk_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "chunk_index", "start_line", "end_line", "content_hash")


@query(f"""SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-' ||
  CASE h[17:17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
    WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS id
  FROM (SELECT doc_id, chunk_index, sha256(concat_ws(chr(0), '{SCOPE["user_id"]}', '{SCOPE["repository_id"]}', 'main', '{SCOPE["commit_sha"]}', 'src/doc' || doc_id || '.md', start_line, end_line, sha256(content))) AS h FROM ({_WINDOWS}))""")
def chunk_ids(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumns({k: F.lit(v) for k, v in SCOPE.items()}).withColumn("file_path", F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    return chunks.with_ids(w, list(SCOPE)).select("doc_id", "chunk_index", "id")


@query(f"SELECT doc_id, count(*) AS chunk_count, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(length(content) + len(regexp_extract_all(content, '[\\x{{10000}}-\\x{{10FFFF}}]'))) AS BIGINT) AS characters FROM ({_WINDOWS}) GROUP BY doc_id")
def chunk_summaries(spark, sf_dir):
    return chunks.summaries(_windows(spark, sf_dir), ["doc_id"])


# -- inclusion policy --

_FILE = """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN '.env.local' WHEN 1 THEN 'yarn.lock' WHEN 2 THEN 'app.min.js' WHEN 3 THEN 'dist/a.ts' WHEN 4 THEN 'notes.txt' WHEN 5 THEN '.gitignore' WHEN 6 THEN 'server.PEM' WHEN 7 THEN 'a/Temp/b.ts'
  WHEN 8 THEN 'src/gen/keep.ts' WHEN 9 THEN 'src/gen/x.ts' WHEN 10 THEN 'src/main.tsx' ELSE 'README.md' END AS path, strlen(text) AS size, text FROM documents"""


def _file_rows(spark, sf_dir):
    names = [".env.local", "yarn.lock", "app.min.js", "dist/a.ts", "notes.txt", ".gitignore", "server.PEM", "a/Temp/b.ts", "src/gen/keep.ts", "src/gen/x.ts", "src/main.tsx", "README.md"]
    path = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 12).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").alias("size"), "text")


@query(f"""SELECT doc_id, path, CASE WHEN regexp_matches(lower(path), '(^|/)(dist|temp|tmp|build|out|vendor|node_modules)/') THEN 'default_ignored_directory' WHEN path = '.gitignore' THEN 'gitignore_file'
  WHEN path LIKE '.env%' OR lower(path) LIKE '%.pem' THEN 'secret_file' WHEN path LIKE '%.lock' THEN 'lock_file' WHEN path LIKE '%.min.js' THEN 'generated_file' WHEN path LIKE '%.txt' THEN 'unsupported_extension'
  WHEN size > 4000 THEN 'file_too_large' WHEN path = 'src/gen/x.ts' THEN 'gitignore' END AS reason,
  CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'unknown' END AS language FROM ({_FILE})""")
def doc_policy(spark, sf_dir):
    rules = spark.createDataFrame([("", "src/gen/*\n!src/gen/keep.ts\n"), ("src", "nothing/\n")], "directory string, rules string")
    judged = files.with_ignored(_file_rows(spark, sf_dir), rules)
    return judged.select("doc_id", "path", files.exclusion_reason(F.col("path"), F.col("size"), F.col("ignored"), max_bytes=4000).alias("reason"), X.language_of("path").alias("language"))


@query("""WITH d AS (SELECT doc_id, 'r' || doc_id % 3 AS snapshot, CASE doc_id % 8 WHEN 0 THEN 'gen/a' WHEN 1 THEN 'gen/keep' WHEN 2 THEN 'lib/gen/a' WHEN 3 THEN 'lib/old/x' WHEN 4 THEN 'lib/old/new/y' WHEN 5 THEN 'logs/day1' WHEN 6 THEN 'logs/dayx' ELSE 'doc' END || CASE WHEN doc_id % 5 = 0 THEN '.LOG' ELSE '.ts' END AS path FROM documents)
  SELECT doc_id, snapshot, path, CASE WHEN snapshot = 'r2' THEN false WHEN path LIKE 'gen/keep%' THEN path LIKE '%.LOG' WHEN path LIKE 'gen/%' THEN true WHEN path LIKE 'lib/old/%' THEN snapshot = 'r0' OR path LIKE '%.LOG'
    WHEN path LIKE 'logs/day1%' THEN true WHEN path LIKE 'lib/%' AND snapshot = 'r1' THEN false ELSE path LIKE '%.LOG' END AS ignored FROM d""")
def ignore_rules(spark, sf_dir):
    """Nested and negated rules of three snapshots over the paths of all documents."""
    names = F.get(F.array(*map(F.lit, ["gen/a", "gen/keep", "lib/gen/a", "lib/old/x", "lib/old/new/y", "logs/day1", "logs/dayx", "doc"])), (F.col("doc_id") % 8).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("snapshot"), F.concat(names, F.when(F.col("doc_id") % 5 == 0, ".LOG").otherwise(".ts")).alias("path"))
    root = "# all logs\n*.log\n/gen/*\n!gen/keep.ts\nlogs/day[0-9]*\n"
    rules = spark.createDataFrame([("r0", "", root + "old/\n"), ("r0", "lib/old", "!*\n"), ("r1", "", root), ("r1", "lib", "!gen/*.log\nold/**/*.log\n")], "snapshot string, directory string, rules string")
    return files.with_ignored(docs, rules, ["snapshot"]).select("doc_id", "snapshot", "path", "ignored")


_SAMPLE = "CASE WHEN strlen(text) <= 8192 THEN text ELSE coalesce(" + ", ".join(f"TRY(decode(encode(text)[1:{n}]))" for n in (8192, 8191, 8190, 8189)) + ") END"


@query(rf"""SELECT doc_id, contains(t, chr(0)) OR 10 * length(regexp_replace(t, '[^\x00-\x07\x0b\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')) > length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')) AS is_binary
  FROM (SELECT doc_id, {_SAMPLE} AS t FROM documents)""")
def binary_detection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", files.is_binary(F.encode("text", "UTF-8")).alias("is_binary"))


# -- maintenance --


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text")
def content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.sha256("text").alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


_CURRENT = "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 11 <> 0"
_OLD = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS content_hash, lang AS language, 1 + doc_id % 3 AS chunk_count FROM documents WHERE doc_id % 7 <> 0"


def _snapshots(spark, sf_dir):
    """Two snapshots of the documents: files came, went and changed between them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), "text", F.col("lang").alias("language"))
    current = docs.where("file_path % 11 <> 0").select("file_path", X.sha256("text").alias("content_hash"), "language")
    changed = F.when(F.col("file_path") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old = docs.where("file_path % 7 <> 0").select("file_path", X.sha256(changed).alias("content_hash"), "language", (1 + F.col("file_path") % 3).alias("chunk_count"))
    return current, old


_DIFF = f"SELECT coalesce(c.doc_id, o.doc_id) AS file_path, CASE WHEN c.doc_id IS NULL THEN 'removed' WHEN o.content_hash IS NULL OR o.content_hash <> c.content_hash THEN 'changed' ELSE 'retained' END AS status FROM ({_CURRENT}) c FULL JOIN ({_OLD}) o ON c.doc_id = o.doc_id"


@query(f"SELECT file_path, status, 'incremental' AS mode FROM ({_DIFF})")
def snapshot_diff(spark, sf_dir):
    current, old = _snapshots(spark, sf_dir)
    return maintenance.diff(current, old)


@query(f"""WITH p AS ({_DIFF}), u AS (SELECT o.language, o.chunk_count FROM ({_OLD}) o JOIN p ON p.file_path = o.doc_id AND status = 'retained' UNION ALL SELECT lang, 2 FROM documents JOIN p ON p.file_path = doc_id AND status = 'changed')
  SELECT language, count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM u GROUP BY language""")
def incremental_rollup(spark, sf_dir):
    current, old = _snapshots(spark, sf_dir)
    plan = maintenance.diff(current, old)
    indexed = current.join(plan.where("status = 'changed'"), "file_path", "left_semi").withColumn("chunk_count", F.lit(2).cast("long"))
    total = maintenance.rollup(plan, old, indexed)
    by = old.join(plan.where("status = 'retained'"), "file_path", "left_semi").select("language", "chunk_count").unionByName(indexed.select("language", "chunk_count"))
    by = by.groupBy("language").agg(F.sum("chunk_count").alias("chunks"))
    return total.select(F.explode("languages").alias("language", "files")).join(by, "language")


_TARGET = "SELECT doc_id AS id, source, n_chars AS version FROM documents WHERE doc_id % 3 <> 0"


@query(f"SELECT * FROM ({_TARGET}) WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE doc_id % 2 = 0")
def merge_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("version"))
    return maintenance.upsert(docs.where("id % 3 <> 0"), docs.where("id % 2 = 0").withColumn("version", F.col("version") + 1))


@query("SELECT doc_id AS id, source, n_chars AS version FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 1)")
def delete_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("version"))
    return maintenance.delete_keys(docs, docs.groupBy("source").count().where("count % 2 = 1"), ["source"])


@query("SELECT doc_id AS id, source, CASE WHEN source = 'src0' THEN 'new' ELSE 'old' END AS commit_sha FROM documents WHERE lang <> 'de' OR source <> 'src1'")
def promote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("old").alias("commit_sha"), F.col("lang").alias("user_id"), F.col("source").alias("repository_id"))
    kept = maintenance.delete_scope(docs, user_id="de", repository_id="src1")
    return maintenance.promote(kept, "new", F.col("source") == "src0").select("id", "source", "commit_sha")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 4 <> 3 OR doc_id % 9 = 0""")
def bucket_upsert(spark, sf_dir):
    """Documents in buckets of their id; every ninth is put anew, and only the buckets that hold such a one are rewritten."""
    store = manifest.Store(spark, f"{session.shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    for part in (docs.where("id % 4 <> 3"), docs.where("id % 9 = 0").withColumn("source", F.lit("new"))):
        t = store.transaction()
        t.upsert("documents", part, "id", buckets=16, keywords=("source",))
        t.commit()
    return store.read("documents")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN sha256(coalesce(text, '') || '!') ELSE sha256(coalesce(text, '')) END AS content_hash, '2' AS commit_sha, CASE WHEN d.doc_id % 7 = 0 THEN 1 ELSE coalesce(n, 0) END AS symbols
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) > 6 GROUP BY doc_id) s ON s.doc_id = d.doc_id WHERE d.doc_id % 11 <> 0""")
def atomic_commit(spark, sf_dir):
    """Documents as files and their long words as symbols, committed together, then changed together; both are read at the last version."""
    store = manifest.Store(spark, f"{session.shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("name")).where(F.length("name") > 6)
    store.begin("first")
    t = store.transaction("first")
    t.replace("files", docs.select("doc_id", X.sha256("text").alias("content_hash"), F.lit("1").alias("commit_sha")))
    t.replace("symbols", words)
    t.commit()
    store.begin("second")
    t = store.transaction("second")
    changed = docs.where("doc_id % 7 = 0 AND doc_id % 11 <> 0")
    plan = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "removed").when(F.col("doc_id") % 7 == 0, "changed").otherwise("retained").alias("status"))
    new = changed.select("doc_id", X.sha256(F.concat("text", F.lit("!"))).alias("content_hash"), F.lit("2").alias("commit_sha"))
    kept, symbols = maintenance.commit_files(t.read("files"), t.read("symbols"), plan, new, changed.select("doc_id", F.lit("changed").alias("name")), "2", key="doc_id")
    t.replace("files", kept)
    t.replace("symbols", symbols)
    tables = store.tables(t.commit())
    n = tables["symbols"].groupBy("doc_id").agg(F.count("*").alias("symbols"))
    return tables["files"].join(n, "doc_id", "left").select("doc_id", "content_hash", "commit_sha", F.coalesce("symbols", F.lit(0)).alias("symbols"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_job(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return files.latest(e, ["user_id"], "at").select("user_id", "event_id", "event_type", "value")


# -- vectors --

_SCORES = """SELECT q.vec_id AS query_id, p.vec_id AS vec_id, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings p JOIN embeddings q ON q.vec_id % 50 = 0"""
_TOP = f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_SCORES})"


def _query_set(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM ({_TOP}) WHERE rank <= 15")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.top_k(e, _query_set(e), places=6)


@query(f"SELECT query_id, vec_id, score FROM ({_SCORES}) WHERE score >= 0.5")
def vector_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.top_k(e, _query_set(e), k=None, at_least=0.5, places=6).select("query_id", "vec_id", "score")


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    none = F.array().cast("array<string>")
    return e.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("symbol_name"), F.array(F.concat(F.lit("s"), ((F.col("label") + 1) % 10).cast("string"))).alias("references"), none.alias("imports"), none.alias("exports"),
        F.concat(F.lit("f"), (F.col("vec_id") % 7).cast("string")).alias("file_path"), F.lit(1).alias("start_line"), F.col("vec_id").cast("int").alias("chunk_index"),
    )


@query("""WITH p AS (SELECT vec_id AS id, 's' || label AS name, 's' || (label + 1) % 10 AS ref, 'f' || vec_id % 7 AS file_path FROM embeddings), d AS (SELECT id, file_path, 1.0::DOUBLE AS score FROM p WHERE name = 's3' ORDER BY id LIMIT 15),
  u AS (SELECT id, file_path, 0.95::DOUBLE AS score FROM (SELECT * FROM p WHERE ref = 's3' ORDER BY id LIMIT 15) WHERE id NOT IN (SELECT id FROM d)) SELECT id, file_path, score FROM (SELECT * FROM d UNION ALL SELECT * FROM u) ORDER BY score DESC, file_path, id LIMIT 15""")
def exact_symbol(spark, sf_dir):
    return vectors.exact_symbol(_points(spark, sf_dir), "s3").select("id", "file_path", "score")


@query(f"""WITH x AS (SELECT q.vec_id AS query_id, p.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY p.vec_id) AS rank FROM embeddings q JOIN embeddings p ON p.label = q.label AND q.vec_id % 50 = 0), s AS (SELECT * FROM ({_TOP}) WHERE rank <= 15),
  u AS (SELECT query_id, vec_id, 1.0::DOUBLE AS score, 0 AS part, rank FROM x WHERE rank <= 5 UNION ALL SELECT query_id, vec_id, score, 1, rank FROM s WHERE (query_id, vec_id) NOT IN (SELECT (query_id, vec_id) FROM x WHERE rank <= 5))
  SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS r FROM u) WHERE r <= 15""")
def hybrid_merge(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    first = e.select("vec_id", "label").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rank <= 5")
    exact = q.join(first, "label")
    return vectors.merge(exact, vectors.top_k(e, _query_set(e), places=6), ["query_id", "vec_id"])


_UNITS = "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings"
_NEAR = f"""SELECT source, target, score FROM (SELECT a.vec_id AS source, b.vec_id AS target, list_dot_product(a.u, b.u) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u, b.u) DESC, b.vec_id) AS k
  FROM ({_UNITS}) a JOIN ({_UNITS}) b ON a.vec_id <> b.vec_id) WHERE k <= 3"""


@query(f"SELECT source, target, round(score, 6) AS score FROM ({_NEAR})")
def neighbour_graph(spark, sf_dir):
    """The three nearest of every vector."""
    return ivf.neighbour_graph(table(spark, sf_dir, "embeddings")).select("source", "target", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE e AS (SELECT source, target FROM ({_NEAR})), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target),
  c AS (SELECT a.source AS node, a.target AS mate FROM r a JOIN r b ON b.source = a.target AND b.target = a.source) SELECT min(mate) AS component, node FROM c GROUP BY node""")
def neighbour_components(spark, sf_dir):
    """Strongly connected components of the digraph of nearest neighbours."""
    return graphs.strongly_connected(ivf.neighbour_graph(table(spark, sf_dir, "embeddings")))


@query("SELECT vec_id, len(embedding) = 64 AS valid, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS length FROM embeddings")
def vector_checks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", X.finite_vector("embedding", 64).alias("valid"), F.round(X.norm("embedding"), 6).alias("length"))


@query("""WITH RECURSIVE n AS (SELECT doc_id // 400 AS lang, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 400 ORDER BY doc_id) AS i FROM documents), r AS (SELECT lang, doc_id, i, n_chars AS total, 1 AS n, 0 AS batch FROM n WHERE i = 1
  UNION ALL SELECT n.lang, n.doc_id, n.i, CASE WHEN r.n >= 50 OR r.total + n.n_chars > 29000 THEN n.n_chars ELSE r.total + n.n_chars END, CASE WHEN r.n >= 50 OR r.total + n.n_chars > 29000 THEN 1 ELSE r.n + 1 END,
  CASE WHEN r.n >= 50 OR r.total + n.n_chars > 29000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN n ON n.lang = r.lang AND n.i = r.i + 1) SELECT doc_id, lang AS queue, CAST(batch AS BIGINT) AS batch FROM r""")
def batch_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 400").alias("queue"), "n_chars")
    return vectors.batches(docs, ["queue"], "doc_id", "n_chars", budget=29_000).select("doc_id", "queue", "batch")


@query("""WITH RECURSIVE n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents), r AS (SELECT doc_id, i, n_chars AS total, 1 AS n, 0 AS batch FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN r.n >= 50 OR r.total + n.n_chars > 29000 THEN n.n_chars ELSE r.total + n.n_chars END, CASE WHEN r.n >= 50 OR r.total + n.n_chars > 29000 THEN 1 ELSE r.n + 1 END,
  CASE WHEN r.n >= 50 OR r.total + n.n_chars > 29000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN n ON n.i = r.i + 1) SELECT doc_id, CAST(batch AS BIGINT) AS batch FROM r""")
def batch_borders(spark, sf_dir):
    """All documents as one request queue."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("all").alias("queue"), "n_chars")
    return vectors.batches(docs, ["queue"], "doc_id", "n_chars", budget=29_000).select("doc_id", "batch")


# -- answers --


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_messages(spark, sf_dir):
    return answers.last_messages(table(spark, sf_dir, "conversations"), n=3)


_LINE = r"CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || regexp_replace(text, '^[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g')"


@query(f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length({_LINE}) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - 2 AS used FROM conversations) WHERE used <= 800")
def history_budget(spark, sf_dir):
    return answers.history(table(spark, sf_dir, "conversations"), 800).select("conv_id", "turn", "used")


_BLOCK = "'Source ID: S' || n || chr(10) || 'File: c' || conv_id || chr(10) || 'Language: ' || role || chr(10) || 'Lines: 1-' || (turn + 1)"


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), f AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE 2 END + length('{answers.BEGIN}' || chr(10) || {_BLOCK} || chr(10) || chr(10)) + length(chr(10) || '{answers.END}') AS fixed FROM s),
  r AS (SELECT *, 1500 - fixed - coalesce(sum(fixed + length(text)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f)
  SELECT conv_id, turn, 'S' || n AS reference, length(text) > room AS truncated, sha256('{answers.BEGIN}' || chr(10) || {_BLOCK} || chr(10) || chr(10) || CASE WHEN length(text) <= room THEN text WHEN room <= 20 THEN left(chr(10) || '[context truncated]', CAST(room AS BIGINT)) ELSE left(text, CAST(room - 20 AS BIGINT)) || chr(10) || '[context truncated]' END || chr(10) || '{answers.END}') AS block_hash FROM r WHERE room > 0""")
def context_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file_path"), F.col("role").alias("language"), F.lit(1).alias("start_line"), (F.col("turn") + 1).alias("end_line"), F.col("text").alias("content"))
    blocks = answers.context(c, 1500, key="conv_id", rank="turn", kind=None, name=None)
    return blocks.select("conv_id", "turn", "reference", "truncated", X.sha256("block").alias("block_hash"))


_ASK = "SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Where is helper() defined? ' WHEN 1 THEN 'What does `verifyToken` do? ' WHEN 2 THEN 'Explain the overall design ' WHEN 3 THEN 'Which module imports it ' WHEN 4 THEN 'Show the request flow ' WHEN 5 THEN 'the mongodb schema ' WHEN 6 THEN 'the env var ' ELSE 'how do i use this ' END || text AS q FROM conversations"
_NAME = r"""coalesce(nullif(regexp_extract(q, '`([A-Za-z_$][\w$]*)`', 1), ''), CASE WHEN regexp_matches(m, '[A-Z_$]|[a-z][A-Z]|\(\)$') THEN regexp_replace(m, '\(\)$', '') END)"""
_MEANT = r"""SELECT *, nullif(regexp_extract(q, '(?i)(?:where\s+is|find|used?|defined?|references?|calls?)\s+[`''"]*([A-Za-z_$][\w$]*(?:\(\))?)', 1), '') AS m, lower(q) AS l FROM"""


def _asked(spark, sf_dir):
    lead = ["Where is helper() defined? ", "What does `verifyToken` do? ", "Explain the overall design ", "Which module imports it ", "Show the request flow ", "the mongodb schema ", "the env var ", "how do i use this "]
    first = F.get(F.array(*map(F.lit, lead)), (F.col("turn") % 8).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(first, "text").alias("q"))


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)(?:^|[\s`''"(])(?:[\w.-]+/)+[\w.-]+\.[a-z0-9]+(?:$|[\s`''"),?!])') THEN 'file_specific' WHEN {_NAME} IS NOT NULL THEN 'exact_symbol'
  WHEN regexp_matches(l, '\b(architecture|end[- ]to[- ]end|complete (?:request )?flow|overall design)\b') THEN 'architecture' WHEN regexp_matches(l, '\b(dependency|dependencies|depends on|imports?|requires?)\b') THEN 'dependency'
  WHEN regexp_matches(l, '\b(route|endpoint|request flow|api flow|middleware|controller)\b') THEN 'api_flow' WHEN regexp_matches(l, '\b(database|schema|model|mongodb|mongoose|sql|query)\b') THEN 'database'
  WHEN regexp_matches(l, '\b(config|configuration|environment|env var|setting)\b') THEN 'configuration' WHEN regexp_matches(l, '\b(usage|how (?:do|can|should) i use|example)\b') THEN 'usage' ELSE 'semantic' END AS category FROM ({_MEANT} ({_ASK}))""")
def question_class(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", X.question_class("q").alias("category"))


@query(f"SELECT conv_id, turn, {_NAME} AS symbol FROM ({_MEANT} ({_ASK}))")
def symbol_extract(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", X.exact_symbol("q").alias("symbol"))


@query("""SELECT doc_id, sha256(concat_ws(chr(10), 'Repository: r', 'Branch: main', 'Commit: c', 'File: ' || source, 'Language: ' || lang, 'Lines: 1-' || n_chars, chr(10) || 'Imports:', '- ' || source || chr(10) || '- ' || lang, chr(10) || 'Exports:', '(none)', chr(10) || 'Code:', text)) AS text_hash FROM documents""")
def embedding_text(spark, sf_dir):
    none = F.array().cast("array<string>")
    t = X.embedding_text(F.lit("r"), F.lit("main"), F.lit("c"), "source", "lang", F.lit(1), "n_chars", F.array("source", "lang"), none, "text")
    return table(spark, sf_dir, "documents").select("doc_id", X.sha256(t).alias("text_hash"))


# -- graphs --

_PART = "SELECT p_partkey, concat_ws('/', p_name, p_brand, p_type, p_size) AS name FROM part"
_REFERENCES = f"SELECT DISTINCT 'o' || l_orderkey AS source, name FROM lineitem JOIN ({_PART}) ON p_partkey = l_partkey"
_EDGES = f"SELECT source, 'p' || p_partkey AS target, name AS reference, count(*) OVER (PARTITION BY source, name) > 1 AS ambiguous FROM ({_REFERENCES}) JOIN ({_PART}) USING (name)"


def _symbols(spark, sf_dir):
    """Orders refer to parts by name; parts define names, some of them more than once."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    part = part.select("p_partkey", F.concat_ws("/", "p_name", "p_brand", "p_type", "p_size").alias("p_name"))
    refs = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(F.collect_set("p_name").alias("references"))
    orders = refs.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("name"), "references")
    return orders.unionByName(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("references")))


@query(f"SELECT source, target, reference, ambiguous FROM ({_EDGES})")
def reference_edges(spark, sf_dir):
    return graphs.reference_edges(_symbols(spark, sf_dir))


@query(f"""WITH e AS ({_EDGES}), n AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT DISTINCT 'o' || l_orderkey FROM lineitem)
  SELECT id, coalesce(o, 0) AS outgoing, coalesce(i, 0) AS incoming FROM n LEFT JOIN (SELECT source, count(*) AS o FROM e GROUP BY source) ON source = id LEFT JOIN (SELECT target, count(*) AS i FROM e GROUP BY target) ON target = id""")
def degrees(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    return graphs.degrees(s.select("id"), graphs.reference_edges(s))


@query(f"SELECT count(*) AS resolved, count(DISTINCT CASE WHEN ambiguous THEN source || chr(0) || reference END) AS ambiguous FROM ({_EDGES})")
def ambiguity(spark, sf_dir):
    e = graphs.reference_edges(_symbols(spark, sf_dir))
    return e.agg(F.count("*").alias("resolved"), F.count_distinct(F.when(F.col("ambiguous"), F.struct("source", "reference"))).alias("ambiguous"))


def _modules(spark, sf_dir):
    """Documents as modules that import their neighbours by several kinds of specifier."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    s = lambda n: n.cast("string")
    path = F.concat(F.lit("src/"), "lang", F.lit("/doc"), s(F.col("doc_id")), F.when(F.col("doc_id") % 10 == 0, "/index.ts").otherwise(".ts"))
    up = F.when(F.col("doc_id") % 10 == 0, "../../").otherwise("../")
    imports = F.array(
        F.concat(up, "lang", F.lit("/doc"), s(F.col("doc_id") + 1)), F.concat(up, F.lit("en/doc"), s(F.col("doc_id") + 2), F.lit(".js?raw")), F.concat(up, F.lit("en/./doc"), s(F.col("doc_id") + 2), F.lit(".ts")), F.lit("react"), F.lit("./missing"),
    )
    return d.select(path.alias("path"), F.col("lang").alias("language"), imports.alias("imports"))


_MODULES = "SELECT doc_id, lang, 'src/' || lang || '/doc' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '/index.ts' ELSE '.ts' END AS path, CASE WHEN doc_id % 10 = 0 THEN '../../' ELSE '../' END AS up FROM documents"


@query(f"""WITH m AS ({_MODULES}) SELECT a.path AS source, b.path AS target, min(s) AS specifier FROM (
  SELECT path, up || lang || '/doc' || (doc_id + 1) AS s, lang AS l, doc_id + 1 AS d, true AS whole FROM m UNION ALL SELECT path, up || 'en/doc' || (doc_id + 2) || '.js', 'en', doc_id + 2, false FROM m
  UNION ALL SELECT path, up || 'en/./doc' || (doc_id + 2) || '.ts', 'en', doc_id + 2, false FROM m WHERE false) a
  JOIN m b ON b.doc_id = a.d AND b.lang = a.l AND (whole OR b.doc_id % 10 <> 0) GROUP BY a.path, b.path""")
def import_resolve(spark, sf_dir):
    return graphs.resolve_imports(_modules(spark, sf_dir))[0]


_LAYER = "SELECT 'r' || r_regionkey AS id, 'route' AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 'controller' FROM nation UNION ALL SELECT 'c' || c_custkey, 'service' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'model' FROM orders"


@query("""SELECT 'r' || r_regionkey AS route, concat_ws('>', 'r' || r_regionkey, 'n' || n_nationkey, 'c' || c_custkey, 'o' || o_orderkey) AS path, o_orderkey IS NOT NULL AS complete,
  CASE WHEN o_orderkey IS NOT NULL THEN 'model' WHEN c_custkey IS NOT NULL THEN 'service' WHEN n_nationkey IS NOT NULL THEN 'controller' ELSE 'route' END AS stops_at
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey""")
def flow_paths(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    levels = [("region", "r", "r_regionkey", "route"), ("nation", "n", "n_nationkey", "controller"), ("customer", "c", "c_custkey", "service"), ("orders", "o", "o_orderkey", "model")]
    nodes = None
    for n, p, c, layer in levels:
        part = t(n).select(name(p, c).alias("id"), F.lit(layer).alias("layer"))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = t("nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target")).unionByName(t("customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target"))).unionByName(t("orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target")))
    f = graphs.flows(t("region").select(name("r", "r_regionkey").alias("id")), nodes, edges)
    return f.select("route", F.array_join("nodes", ">").alias("path"), "complete", "stops_at")


_NEXT = "SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem"
_FOLLOWS = f"SELECT 'p' || a AS source, 'p' || b AS target FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS r FROM ({_NEXT}) WHERE a <> b GROUP BY a, b) WHERE r <= "


def _follows(spark, sf_dir, n):
    """The parts that most often stand on the line after each part in an order: a digraph with as many nodes as parts."""
    from pyspark.sql import Window

    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), after.alias("b")).where("a != b").groupBy("a", "b").agg(F.count("*").alias("v"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))).where(F.col("r") <= n)
    return e.select(F.concat(F.lit("p"), F.col("a").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("b").cast("string")).alias("target"))


@query(f"""WITH RECURSIVE e AS ({_FOLLOWS} 2), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target),
  c AS (SELECT a.source AS node, a.target AS mate FROM r a JOIN r b ON b.source = a.target AND b.target = a.source) SELECT min(mate) AS component, node FROM c GROUP BY node""")
def scc(spark, sf_dir):
    return graphs.strongly_connected(_follows(spark, sf_dir, 2))


@query(f"""WITH RECURSIVE e AS ({_FOLLOWS} 2), r AS (SELECT 'p1' AS path, 0 AS d UNION SELECT e.target, r.d + 1 FROM r JOIN e ON e.source = r.path WHERE r.d < 4) SELECT path, min(d) AS distance, CASE WHEN min(d) = 0 THEN 'origin' ELSE 'dependency' END AS relation FROM r GROUP BY path""")
def bfs_depth(spark, sf_dir):
    return graphs.traverse(_follows(spark, sf_dir, 2), "p1", "imports", 4)


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_FOLLOWS} 2)), o AS (SELECT DISTINCT source AS origin FROM e WHERE CAST(source[2:] AS BIGINT) % 50 = 0),
  r AS (SELECT origin, origin AS path, 0 AS d FROM o UNION SELECT r.origin, e.target, r.d + 1 FROM r JOIN e ON e.source = r.path WHERE r.d < 3) SELECT origin, path, min(d) AS distance, CASE WHEN min(d) = 0 THEN 'origin' ELSE 'dependency' END AS relation FROM r GROUP BY origin, path""")
def traverse_all(spark, sf_dir):
    """What is within three steps of each part whose number is divisible by 50."""
    e = _follows(spark, sf_dir, 2)
    origins = e.where("CAST(substring(source, 2) AS BIGINT) % 50 = 0").select(F.col("source").alias("origin"))
    return graphs.traverse_many(e, origins, "imports", 3, max_nodes=None)["nodes"]


@query("""WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target FROM lineitem), o AS (SELECT DISTINCT source AS origin FROM e WHERE CAST(source[2:] AS BIGINT) % 50 = 0),
  d AS (SELECT origin, target AS path, 100 AS w FROM o JOIN e ON source = origin), s AS (SELECT DISTINCT origin, source AS path, 30 AS w FROM d JOIN e ON target = d.path WHERE source <> origin),
  r AS (SELECT origin, path, sum(w) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM s) GROUP BY ALL) SELECT origin, path, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY score DESC, path) AS k FROM r) WHERE k <= 10""")
def related_items(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    e = line.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    origins = line.where("l_orderkey % 50 = 0").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("origin"))
    return graphs.related(origins, e).select("origin", "path", F.col("score").cast("long").alias("score"))


@query(f"""WITH e AS ({_FOLLOWS} 3), n AS (SELECT 'p' || p_partkey AS path FROM part), d AS (SELECT path, (SELECT count(*) FROM e WHERE source = path) AS imports, (SELECT count(*) FROM e WHERE target = path) AS imported_by FROM n)
  SELECT path, imports, imported_by FROM d WHERE imports > 0 OR imported_by > 0 ORDER BY imported_by DESC, imports DESC, path LIMIT 10""")
def hubs(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    d = graphs.degrees(nodes, _follows(spark, sf_dir, 3), "path").withColumnsRenamed({"outgoing": "imports", "incoming": "imported_by"})
    return report.hubs(d)


@query("SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    return report.languages(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")))


@query("SELECT s_name AS name, 'n' || s_nationkey AS path, CAST(s_suppkey AS INTEGER) AS line FROM supplier ORDER BY path, line, name LIMIT 25")
def entry_points(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("path"), F.col("s_suppkey").cast("int").alias("start_line"), F.lit("route").alias("layer"))
    return report.entry_points(s)


@query(f"""WITH e AS ({_EDGES}), a AS (SELECT count(DISTINCT CASE WHEN ambiguous THEN source || chr(0) || reference END) AS n FROM e), f AS (SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
  SELECT * FROM (SELECT 'AMBIGUOUS_REFERENCES' AS code, 'warning' AS severity, n AS count FROM a UNION ALL SELECT 'INCOMPLETE_APPLICATION_FLOWS', 'info', n FROM f) WHERE count > 0""")
def risk_report(spark, sf_dir):
    a = graphs.reference_edges(_symbols(spark, sf_dir)).agg(F.count_distinct(F.when(F.col("ambiguous"), F.struct("source", "reference"))).alias("AMBIGUOUS_REFERENCES"), F.lit(0).alias("k"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("INCOMPLETE_APPLICATION_FLOWS"), F.lit(0).alias("k"))
    return report.risks(a.join(c, "k")).select("code", "severity", "count")


# -- evaluation --

def _spans(size: int, step: int) -> str:
    """Windows of lines of all documents, as chunks.windows cuts them."""
    return f"""(SELECT doc_id, k AS chunk_index, 1 + {step} * k AS start_line, least({step} * k + {size}, len(ls)) AS end_line
  FROM (SELECT doc_id, ls, unnest(range(CASE WHEN len(ls) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(ls) - {size}) / {step}.0) AS BIGINT) END)) AS k FROM ({_LINES})))"""


#: Sources are chunk windows, citations are shorter windows, and what is wanted are longer ones: each a part of all windows of their size.
_SOURCES, _CITED, _WANTED = f"{_spans(8, 6)} s WHERE chunk_index % 2 = 0", f"{_spans(3, 2)} c WHERE chunk_index % 3 = 1", f"{_spans(12, 12)} w WHERE chunk_index % 4 <> 2"


def _ranges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    cut = lambda size, overlap: chunks.windows(docs, size=size, overlap=overlap).select("doc_id", "chunk_index", "start_line", "end_line")
    return cut(8, 2).where("chunk_index % 2 = 0"), cut(3, 1).where("chunk_index % 3 = 1"), cut(12, 0).where("chunk_index % 4 <> 2")


_WINDOW_COLUMNS = "CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line"


@query(f"SELECT doc_id, {_WINDOW_COLUMNS} FROM (SELECT * FROM {_SOURCES}) r WHERE EXISTS (SELECT 1 FROM (SELECT * FROM {_WANTED}) w WHERE w.doc_id = r.doc_id AND r.start_line <= w.end_line AND w.start_line <= r.end_line)")
def range_overlap(spark, sf_dir):
    sources, _, wanted = _ranges(spark, sf_dir)
    return evaluation.overlapping(sources, wanted, ["doc_id"]).select("doc_id", "start_line", "end_line")


@query(f"SELECT doc_id, {_WINDOW_COLUMNS} FROM (SELECT * FROM {_CITED}) r WHERE EXISTS (SELECT 1 FROM (SELECT * FROM {_SOURCES}) w WHERE w.doc_id = r.doc_id AND r.start_line >= w.start_line AND r.end_line <= w.end_line)")
def containment(spark, sf_dir):
    sources, cited, _ = _ranges(spark, sf_dir)
    return evaluation.contained(cited, sources, ["doc_id"]).select("doc_id", "start_line", "end_line")


@query(f"""WITH s AS (SELECT * FROM {_SOURCES}), c AS (SELECT * FROM {_CITED}), w AS (SELECT * FROM {_WANTED}),
  p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM w WHERE w.doc_id = c.doc_id AND w.start_line <= c.end_line AND c.start_line <= w.end_line)) AS hit,
    count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND c.start_line >= s.start_line AND c.end_line <= s.end_line)) AS grounded FROM c GROUP BY doc_id),
  r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE w.doc_id = c.doc_id AND w.start_line <= c.end_line AND c.start_line <= w.end_line)) AS hit FROM w GROUP BY doc_id),
  m AS (SELECT doc_id, coalesce(p.hit::DOUBLE / p.n, 0) AS a, coalesce(r.hit::DOUBLE / r.n, 0) AS b, coalesce(p.grounded::DOUBLE / p.n, 0) AS g FROM p FULL JOIN r USING (doc_id))
  SELECT doc_id, round(a, 6) AS citation_precision, round(b, 6) AS citation_recall, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS citation_f1, round(g, 6) AS groundedness FROM m""")
def citation_metrics(spark, sf_dir):
    sources, cited, wanted = (df.withColumn("file_path", F.lit("text")) for df in _ranges(spark, sf_dir))
    m = evaluation.citation_metrics(cited, wanted, sources, case="doc_id")
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "doc_id"])


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS said FROM conversations),
  q AS (SELECT DISTINCT conv_id, turn + 1 AS turn, w FROM (SELECT conv_id, turn, unnest(string_split(said, ' ')) AS w FROM t)),
  f AS (SELECT DISTINCT conv_id, turn - 1 AS turn, w FROM (SELECT conv_id, turn, unnest(string_split(said, ' ')) AS w FROM t) WHERE length(w) = 4),
  a AS (SELECT t.conv_id, t.turn, count(q.w) AS n, count(*) FILTER (contains(t.said, q.w)) AS hit FROM t LEFT JOIN q ON q.conv_id = t.conv_id AND q.turn = t.turn AND length(q.w) > 4 GROUP BY t.conv_id, t.turn),
  b AS (SELECT t.conv_id, t.turn, count(f.w) AS n, count(*) FILTER (contains(t.said, f.w)) AS hit FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn GROUP BY t.conv_id, t.turn)
  SELECT a.conv_id, a.turn, round(CASE WHEN a.n = 0 THEN 1 ELSE a.hit::DOUBLE / a.n END, 6) AS completeness, round(CASE WHEN b.n = 0 THEN 0 ELSE b.hit::DOUBLE / b.n END, 6) AS forbidden_claim_rate FROM a JOIN b USING (conv_id, turn)""")
def answer_metrics(spark, sf_dir):
    """Each turn as an answer to the one before it: its words of five letters or more are the concepts, the next turn's words of four are forbidden."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("case_id"), F.col("text").alias("answer"))
    words = c.select("case_id", F.explode(F.array_distinct(F.split(X.answer_text("answer"), " "))).alias("term"))
    beside = lambda k: F.struct(F.col("case_id.conv_id").alias("conv_id"), (F.col("case_id.turn") + k).alias("turn")).alias("case_id")
    asked = words.where(F.length("term") > 4).select(beside(1), F.col("term").alias("concept"), "term")
    banned = words.where(F.length("term") == 4).select(beside(-1), F.lit(None).cast("string").alias("concept"), "term")
    m = evaluation.answer_metrics(c, asked.unionByName(banned))
    return m.select("case_id.*", F.round("completeness", 6).alias("completeness"), F.round("forbidden_claim_rate", 6).alias("forbidden_claim_rate"))


@query(f"""WITH t AS (SELECT query_id, vec_id, rank FROM ({_TOP}) WHERE rank <= 15), w AS (SELECT q.vec_id AS query_id, p.vec_id FROM embeddings q JOIN embeddings p ON p.label = q.label AND q.vec_id % 50 = 0),
  h AS (SELECT t.* FROM t JOIN w USING (query_id, vec_id)), n AS (SELECT query_id, count(*) AS n FROM w GROUP BY query_id), g AS (SELECT query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) AS h, min(rank) AS b FROM h GROUP BY query_id)
  SELECT n.query_id, round(coalesce(h5, 0)::DOUBLE / n, 6) AS recall_at_5, round(coalesce(h10, 0)::DOUBLE / n, 6) AS recall_at_10, coalesce(h5, 0) / 5.0::DOUBLE AS precision_at_5, coalesce(h10, 0) / 10.0::DOUBLE AS precision_at_10, round(coalesce(1.0::DOUBLE / b, 0.0), 6) AS mean_reciprocal_rank, round(coalesce(h, 0)::DOUBLE / n, 6) AS exact_file_hit_rate FROM n LEFT JOIN g USING (query_id)""")
def ir_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    top = vectors.top_k(e, _query_set(e), places=6).withColumnRenamed("vec_id", "item")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    m = evaluation.ranked_metrics(top, e.select("label", F.col("vec_id").alias("item")), groups=q, group="label")
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def p95_latency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.p95("value").alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH a AS (SELECT avg(quality) AS r5, avg(toxic) AS h FROM labels), p AS (SELECT quantile_disc(value, 0.95) AS p FROM events)
  SELECT 'recall_at_5' AS metric, '>=' AS operator, 0.8::DOUBLE AS threshold, round(r5, 6) AS actual, r5 < 0.8 AS violated FROM a UNION ALL SELECT 'hallucination_rate', '<=', 0.05, round(h, 6), h > 0.05 FROM a UNION ALL SELECT 'retrieval_p95_ms', '<=', 2000, round(p, 6), p > 2000 FROM p UNION ALL SELECT 'total_usd', '<=', 1, NULL, true""")
def gates(spark, sf_dir):
    a = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("recall_at_5"), F.avg("toxic").alias("hallucination_rate"), F.lit(0).alias("k"))
    p = table(spark, sf_dir, "events").agg(evaluation.p95("value").alias("retrieval_p95_ms"), F.lit(0).alias("k"))
    row = a.join(p, "k").withColumn("total_usd", F.lit(None).cast("double"))
    g = evaluation.gates(row, {"minimumRecallAt5": 0.8, "maximumHallucinationRate": 0.05, "maximumRetrievalP95Ms": 2000, "maximumTotalCostUsd": 1})
    return g.withColumn("actual", F.round("actual", 6))


@query("SELECT doc_id, round(n_chars / 1000000.0::DOUBLE * 0.5 + length(source) / 1000000.0::DOUBLE * 2, 9) AS usd, CASE WHEN quality IS NULL THEN NULL ELSE round(2.0::DOUBLE * quality * 0.5 / (quality + 0.5), 6) END AS f1 FROM documents LEFT JOIN labels USING (doc_id)")
def cost_and_f1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    usd = X.price("n_chars", F.lit(0.5)) + X.price(F.length("source"), F.lit(2.0))
    return d.select("doc_id", F.round(usd, 9).alias("usd"), F.round(X.f1(F.col("quality").cast("double"), F.lit(0.5)), 6).alias("f1"))


# -- event streams (replayed over the whole log) --

_TZ = "time_bucket(INTERVAL '15 minutes', ts)"


@query(f"SELECT epoch(b)::BIGINT AS start, user_id, n, n > 100 AS limited FROM (SELECT {_TZ} AS b, user_id, count(*) AS n FROM events GROUP BY ALL)")
def rate_limit_windows(spark, sf_dir):
    r = streams.rate_windows(table(spark, sf_dir, "events"))
    return r.select(F.unix_timestamp("start").alias("start"), "user_id", "n", "limited")


@query("""WITH w AS (SELECT epoch(date_trunc('minute', ts))::BIGINT - 60 * k AS start, event_type FROM events, range(10) r(k))
  SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error' OR event_type = 'purchase') AS bad, round((count(*) FILTER (event_type = 'error' OR event_type = 'purchase') / 600.0::DOUBLE) / greatest(count(*) / 600.0::DOUBLE, 0.001), 6) AS ratio,
  (count(*) FILTER (event_type = 'error' OR event_type = 'purchase') / 600.0::DOUBLE) / greatest(count(*) / 600.0::DOUBLE, 0.001) > 0.05 AS alert FROM w GROUP BY start""")
def sliding_rate(spark, sf_dir):
    r = streams.sliding_ratio(table(spark, sf_dir, "events"), F.col("event_type").isin("error", "purchase"))
    return r.select(F.unix_timestamp("start").alias("start"), "n", "bad", F.round("ratio", 6).alias("ratio"), "alert")


_LE = ", ".join(f"({b}::DOUBLE)" for b in streams.HTTP_BUCKETS)
_HIST = f"SELECT event_type, le, count(*) FILTER (value / 100.0 <= le) AS n FROM events, (VALUES {_LE}, ('infinity'::DOUBLE)) v(le) GROUP BY ALL"


@query(f"SELECT event_type, CASE WHEN le = 'infinity'::DOUBLE THEN -1.0::DOUBLE ELSE le END AS le, n FROM ({_HIST})")
def histogram_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100.0)
    h = streams.histogram(e, ["event_type"], "seconds", streams.HTTP_BUCKETS)
    return h.select("event_type", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n")


@query(f"""WITH b AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(n) OVER w, 0) AS below, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type) AS rank FROM ({_HIST}) WINDOW w AS (PARTITION BY event_type ORDER BY le))
  SELECT event_type, round(CASE WHEN le = 'infinity'::DOUBLE THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 6) AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS r FROM b WHERE n >= rank AND rank > 0) WHERE r = 1""")
def histogram_p95(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100.0)
    q = streams.histogram_quantile(streams.histogram(e, ["event_type"], "seconds", streams.HTTP_BUCKETS), ["event_type"], 0.95)
    return q.withColumn("quantile", F.round("quantile", 6))


@query("SELECT event_type, count(*) AS value FROM events GROUP BY event_type")
def counters(spark, sf_dir):
    return streams.counters(table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def gauges(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return streams.gauges(e, ["event_type"], at="at")


@query("""WITH l AS (SELECT *, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, CASE WHEN n = 1 THEN 'accepted' WHEN f <> event_type THEN 'conflict' ELSE 'duplicate' END AS outcome FROM l""")
def delivery_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return streams.delivery_outcomes(e, key="user_id", digest="event_type").select("event_id", "outcome")


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, event_type = 'purchase' AS done, CAST(floor(value) % 5 AS VARCHAR) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT user_id, event_id, i, CASE WHEN done THEN NULL ELSE c END AS live, CAST(NULL AS VARCHAR) AS indexed, CASE WHEN done THEN 'done' ELSE 'queued' END AS outcome FROM l WHERE i = 1
  UNION ALL SELECT l.user_id, l.event_id, l.i, CASE WHEN l.done THEN NULL WHEN r.live IS NULL AND r.indexed IS NOT DISTINCT FROM l.c THEN NULL WHEN r.live IS NULL THEN l.c ELSE r.live END, CASE WHEN l.done AND r.live IS NOT NULL THEN r.live ELSE r.indexed END,
  CASE WHEN l.done THEN 'done' WHEN r.live IS NULL AND r.indexed IS NOT DISTINCT FROM l.c THEN 'dropped' WHEN r.live IS NULL THEN 'queued' ELSE 'pending' END FROM r JOIN l ON l.user_id = r.user_id AND l.i = r.i + 1) SELECT event_id, outcome FROM r""")
def push_coalesce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", "done").otherwise("push").alias("kind"), (F.floor("value") % 5).cast("string").alias("commit_sha"))
    return streams.coalesce_pushes(e, key="user_id").select("event_id", "outcome")


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS digest, CAST(NULL AS TIMESTAMP) AS since, false AS failed, CAST(NULL AS VARCHAR) AS outcome FROM events
  UNION ALL SELECT l.user_id, l.event_id, l.i, CASE WHEN r.since + INTERVAL 10 DAY > l.ts THEN r.digest WHEN NOT l.bad THEN l.d END, CASE WHEN r.since + INTERVAL 10 DAY > l.ts THEN r.since WHEN NOT l.bad THEN l.ts END,
    CASE WHEN r.since + INTERVAL 10 DAY > l.ts THEN (l.bad OR (r.failed AND r.digest <> l.d)) ELSE false END,
    CASE WHEN r.since IS NULL OR r.since + INTERVAL 10 DAY <= l.ts THEN CASE WHEN l.bad THEN 'unknown' ELSE 'accepted' END WHEN l.bad THEN 'failed' WHEN r.digest <> l.d THEN 'conflict' WHEN r.failed THEN 'retried' ELSE 'duplicate' END
  FROM r JOIN l ON l.user_id = r.user_id AND l.i = r.i + 1) SELECT event_id, outcome FROM r WHERE i > 0""")
def delivery_log(spark, sf_dir):
    """Users as delivery ids, errors as failures of their jobs; an id is forgotten after ten days."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "failed").otherwise("delivery").alias("kind"), (F.floor("value") % 2).cast("string").alias("value"))
    return jobs.replay(e, jobs.Deliveries(10 * 24 * 3600), "user_id").select("event_id", "outcome")


_JOB_LOG = """WITH RECURSIVE l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'push' END AS kind, CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS live, CAST(NULL AS VARCHAR) AS indexed, CAST(NULL AS VARCHAR) AS pending, 1 AS attempt, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS started, CAST(NULL AS TIMESTAMP) AS due FROM events
  UNION ALL SELECT user_id, event_id, i, CASE WHEN outcome = 'queued' THEN c WHEN outcome IN ('done', 'failed') THEN next ELSE live END, CASE WHEN outcome = 'done' THEN live ELSE indexed END,
    CASE WHEN outcome = 'pending' THEN c WHEN outcome IN ('done', 'failed') THEN NULL ELSE pending END, CASE WHEN outcome = 'retrying' THEN attempt + 1 WHEN outcome IN ('queued', 'done', 'failed') THEN 1 ELSE attempt END, outcome,
    CASE WHEN outcome = 'queued' THEN c WHEN outcome IN ('done', 'failed') THEN next WHEN outcome = 'retrying' THEN live END, CASE WHEN outcome = 'retrying' THEN ts + to_seconds(CAST(5 * power(2, attempt - 1) AS BIGINT)) END
  FROM (SELECT l.*, r.live, r.indexed, r.pending, r.attempt, CASE WHEN r.pending <> r.live THEN r.pending END AS next,
    CASE WHEN l.kind = 'push' THEN CASE WHEN r.live IS NOT NULL THEN 'pending' WHEN r.indexed = l.c THEN 'dropped' ELSE 'queued' END WHEN r.live IS NULL THEN 'idle' WHEN l.kind = 'done' THEN 'done' WHEN r.attempt < 3 THEN 'retrying' ELSE 'failed' END AS outcome
    FROM r JOIN l ON l.user_id = r.user_id AND l.i = r.i + 1)) SELECT event_id, outcome, started, due FROM r WHERE i > 0"""


@query(_JOB_LOG)
def job_log(spark, sf_dir):
    """Users as repositories: purchases complete a job, errors fail an attempt, all else pushes a commit."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("push")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"), (F.floor("value") % 5).cast("string").alias("value"))
    return jobs.replay(e, jobs.Jobs(attempts=3), "user_id").select("event_id", "outcome", "started", "due")


@query(f"SELECT outcome, started IS NOT NULL AS starts, count(*) AS n FROM ({_JOB_LOG}) GROUP BY ALL")
def job_outcomes(spark, sf_dir):
    log = job_log(spark, sf_dir).withColumn("starts", F.col("started").isNotNull())
    return streams.outcome_counts(log, ["starts"])


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), j AS (SELECT event_id AS job, user_id, ts FROM events WHERE event_type = 'signup')
  SELECT p.event_id, CAST(j.job AS VARCHAR) AS job_id, CASE WHEN j.job IS NULL THEN 'queued' ELSE 'pending' END AS outcome FROM p LEFT JOIN j ON j.user_id = p.user_id AND j.ts <= p.ts AND j.ts > p.ts - INTERVAL 6 HOUR""")
def pushes_with_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "repository_id")
    started = e.where("event_type = 'signup'").select("repository_id", F.col("event_id").cast("string").alias("job_id"), F.col("ts").alias("started_at"))
    return jobs.pushes_with_jobs(e.where("event_type = 'click'").select("event_id", "repository_id", "ts"), started, lease="6 hours").select("event_id", "job_id", "outcome")


# -- deliveries, jobs, citations --

_BODY = """SELECT event_id, CASE event_id % 6 WHEN 4 THEN 'installation' WHEN 5 THEN 'star' ELSE 'push' END AS event, user_id, event_id % 6 AS m FROM events"""


def _deliveries(spark, sf_dir):
    """Events as webhook bodies: pushes of branches, tags and deletions, revocations, and others."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 6).alias("m"))
    ref = F.when(F.col("m") == 1, "refs/tags/v1").otherwise("refs/heads/main")
    repository = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("o/r"), F.col("user_id").cast("string")).alias("full_name"))
    push = F.struct(ref.alias("ref"), F.lit("a" * 40).alias("after"), (F.col("m") == 2).alias("deleted"), repository.alias("repository"), F.struct((F.col("user_id") % 7).alias("id")).alias("installation"))
    gone = F.struct(F.lit("deleted").alias("action"), F.struct((F.col("user_id") % 7).alias("id")).alias("installation"))
    body = F.when(F.col("m") == 3, F.lit("{")).when(F.col("m") == 4, F.to_json(gone)).otherwise(F.to_json(push))
    return e.select("event_id", F.when(F.col("m") == 4, "installation").when(F.col("m") == 5, "star").otherwise("push").alias("event"), body.alias("body"))


@query(f"""SELECT event_id, CASE m WHEN 0 THEN 'push' WHEN 3 THEN 'invalid' WHEN 4 THEN 'installation_revoked' ELSE 'ignored' END AS kind, CASE m WHEN 1 THEN 'not a branch' WHEN 2 THEN 'deleted' WHEN 3 THEN 'malformed' WHEN 5 THEN 'other event' END AS reason,
  CASE WHEN m IN (0, 2, 5) THEN 'main' END AS branch, CASE WHEN m <> 3 THEN user_id % 7 END AS installation_id FROM ({_BODY})""")
def webhook_parse(spark, sf_dir):
    return streams.parse(_deliveries(spark, sf_dir)).select("event_id", "kind", "reason", "branch", "installation_id")


@query(f"""WITH g AS (SELECT DISTINCT user_id % 7 AS i FROM ({_BODY}) WHERE m = 4) SELECT c_custkey AS id, CASE WHEN c_nationkey % 7 IN (SELECT i FROM g) THEN 'failed' ELSE 'ready' END AS status FROM customer""")
def revocation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 7).cast("long").alias("installation_id"), F.col("c_custkey").alias("github_repository_id"), F.lit("ready").alias("status"))
    return streams.revoke(c, streams.parse(_deliveries(spark, sf_dir))).select("id", "status")


@query("""SELECT doc_id, 'see ' || source || ' ' || '[' || source || ':L1-L' || n_chars || ']' || ' ' || '[%5B' || lang || '%5D:L2-L3]' || chr(10) || chr(10) || lang || ' [' || '%5B' || lang || '%5D:L2-L3]' AS answer, 2 AS sources FROM documents""")
def cited_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "source", "lang", "n_chars")
    one = F.struct(F.concat(F.lit("see "), "source").alias("text"), F.array(F.lit("S1"), F.lit("S2")).alias("source_ids"))
    two = F.struct(F.col("lang").alias("text"), F.array(F.lit("S2")).alias("source_ids"))
    first = d.select("question_id", F.lit("S1").alias("reference"), F.col("source").alias("file_path"), F.lit(1).cast("long").alias("start_line"), F.col("n_chars").alias("end_line"))
    second = d.select("question_id", F.lit("S2").alias("reference"), F.concat(F.lit("["), "lang", F.lit("]")).alias("file_path"), F.lit(2).cast("long").alias("start_line"), F.lit(3).cast("long").alias("end_line"))
    a = answers.cited(d.select("question_id", F.array(one, two).alias("segments")), first.unionByName(second))
    return a.select(F.col("question_id").alias("doc_id"), "answer", F.size("citations").alias("sources"))


_CASES = "SELECT doc_id, n_chars % 4 AS a, doc_id % 5 AS b FROM documents"


@query(f"""SELECT 'c' || doc_id AS id, a <= b AS success, CASE WHEN a <= b THEN 1.0::DOUBLE ELSE 0.0 END AS recall_at_5, CASE WHEN a <= b THEN 0.2::DOUBLE ELSE 0.0 END AS precision_at_5, CASE WHEN a <= b THEN round(1.0::DOUBLE / (a + 1), 6) ELSE 0.0 END AS mean_reciprocal_rank,
  CASE WHEN a <= b AND b % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS groundedness, CASE WHEN a <= b AND b % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hallucination_rate, CASE WHEN a <= b THEN CASE WHEN b = 3 THEN 1.0::DOUBLE ELSE 0.0 END ELSE 0.0 END AS completeness FROM ({_CASES})""")
def case_scores(spark, sf_dir):
    """Each document as a case: its file stands at rank a + 1 of four, cited inside or outside what was retrieved."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), (F.col("n_chars") % 4).cast("int").alias("a"), (F.col("doc_id") % 5).cast("int").alias("b"))
    none = F.array().cast("array<string>")
    cases = d.select(
        "id", F.lit("q").alias("question"), F.array(F.lit("hit")).alias("expected_files"), none.alias("expected_symbols"), F.lit(None).cast("array<struct<file_path:string,start_line:int,end_line:int>>").alias("expected_line_ranges"),
        F.array(F.struct(F.lit("k").alias("id"), F.array(F.lit("Token  3")).alias("terms"))).alias("expected_answer_concepts"), none.alias("forbidden_answer_terms"), none.alias("tags"),
    )
    source = lambda i: F.struct(i.cast("string").alias("id"), F.when(i == F.col("a"), "hit").otherwise(F.concat(F.lit("f"), i.cast("string"))).alias("file_path"), F.lit(None).cast("string").alias("symbol_name"), F.lit(1).alias("start_line"), F.lit(10).alias("end_line"), F.lit(0.5).alias("score"))
    obs = d.where("a <= b").select(
        F.col("id").alias("case_id"), F.concat(F.lit(" Uses TOKEN "), F.col("b").cast("string")).alias("answer"), F.transform(F.sequence(F.lit(0), F.lit(3)), source).alias("retrieved_sources"),
        F.array(F.struct(F.lit("hit").alias("file_path"), F.lit(None).cast("string").alias("symbol_name"), F.lit(2).alias("start_line"), F.when(F.col("b") % 2 == 0, 9).otherwise(99).alias("end_line"))).alias("citations"),
        F.lit(None).cast("struct<retrieval_ms:double,generation_ms:double,indexing_ms:double>").alias("timings"), F.lit(None).cast("struct<embedding_tokens:bigint,input_tokens:bigint,output_tokens:bigint>").alias("usage"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    s = evaluation.score(cases, obs)
    return s.select("id", "success", "recall_at_5", "precision_at_5", F.round("mean_reciprocal_rank", 6).alias("mean_reciprocal_rank"), "groundedness", "hallucination_rate", "completeness")
