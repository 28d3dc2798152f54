"""Retrieval, citation and answer metrics against ground truth; aggregates, quality gates, reports, replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.functions.checks import InvalidRows
from siltwork.operators import intervals

CASE = (
    "id string, question string, expected_files array<string>, expected_symbols array<string>, expected_line_ranges array<struct<file_path:string,start_line:int,end_line:int>>, "
    "expected_answer_concepts array<struct<id:string,terms:array<string>>>, forbidden_answer_terms array<string>, tags array<string>"
)
OBSERVATION = (
    "case_id string, answer string, retrieved_sources array<struct<id:string,file_path:string,symbol_name:string,start_line:int,end_line:int,score:double>>, citations array<struct<file_path:string,symbol_name:string,start_line:int,end_line:int>>, "
    "timings struct<retrieval_ms:double,generation_ms:double,indexing_ms:double>, usage struct<embedding_tokens:long,input_tokens:long,output_tokens:long>, metadata map<string,string>"
)

# Gates as (threshold, metric, comparison).
GATES = [
    ("minimumCaseSuccessRate", "case_success_rate", ">="), ("minimumRecallAt5", "recall_at_5", ">="), ("minimumRecallAt10", "recall_at_10", ">="),
    ("minimumPrecisionAt5", "precision_at_5", ">="), ("minimumPrecisionAt10", "precision_at_10", ">="), ("minimumMeanReciprocalRank", "mean_reciprocal_rank", ">="),
    ("minimumExactFileHitRate", "exact_file_hit_rate", ">="), ("minimumExactSymbolHitRate", "exact_symbol_hit_rate", ">="), ("minimumLineHitRate", "line_hit_rate", ">="),
    ("minimumCitationPrecision", "citation_precision", ">="), ("minimumCitationRecall", "citation_recall", ">="), ("minimumCitationGroundedness", "groundedness", ">="),
    ("minimumAnswerCompleteness", "completeness", ">="), ("maximumHallucinationRate", "hallucination_rate", "<="), ("maximumRetrievalP95Ms", "retrieval_p95_ms", "<="),
    ("maximumGenerationP95Ms", "generation_p95_ms", "<="), ("maximumIndexingP95Ms", "indexing_p95_ms", "<="), ("maximumTotalCostUsd", "total_usd", "<="),
]
RETRIEVAL = ["recall_at_5", "recall_at_10", "precision_at_5", "precision_at_10", "mean_reciprocal_rank", "exact_file_hit_rate", "exact_symbol_hit_rate", "line_hit_rate"]
CITATIONS = ["citation_precision", "citation_recall", "citation_f1", "groundedness"]
ANSWERS = ["completeness", "forbidden_claim_rate", "unsupported_citation_rate", "hallucination_rate"]
NULLABLE = ["exact_symbol_hit_rate", "line_hit_rate"]


def overlap(a: Column, b: Column) -> Column:
    return (a["start_line"] <= b["end_line"]) & (b["start_line"] <= a["end_line"])


def overlapping(ranges: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Ranges(key..., start_line, end_line) that overlap any of the others with the same key."""
    return intervals.marked(ranges, others, key, name="__hit").where("__hit").drop("__hit")


def contained(ranges: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Ranges that lie inside any of the others with the same key."""
    return intervals.marked(ranges, others, key, contained=True, name="__hit").where("__hit").drop("__hit")


def citation_metrics(citations: DataFrame, units: DataFrame, sources: DataFrame, case: str = "case_id", file: str = "file_path") -> DataFrame:
    """case, citation_precision, citation_recall, citation_f1, groundedness of tables of ranges by case and file.

    A citation is relevant if it overlaps a unit, or a unit without lines names its file; a unit is found if a citation is
    relevant to it; a citation is grounded if it lies inside a source. A file of which a case names lines is no unit
    as a whole. Cases without citations have zeros; cases with neither units nor citations have no row."""
    key = [case, file]
    lined, whole = units.where("start_line IS NOT NULL AND end_line IS NOT NULL"), units.where("start_line IS NULL OR end_line IS NULL")
    whole = whole.join(lined.select(*key).distinct(), key, "left_anti")
    files = whole.select(*key).distinct().withColumn("__whole", F.lit(True))
    cited = intervals.marked(intervals.marked(citations, lined, key, name="relevant"), sources, key, contained=True, name="grounded")
    cited = cited.join(files, key, "left").groupBy(case).agg(F.count("*").alias("cited"), F.count_if(F.col("relevant") | F.col("__whole").isNotNull()).alias("relevant"), F.count_if("grounded").alias("grounded"))
    found = intervals.marked(lined, citations, key, name="found").select(case, "found")
    known = citations.select(*key).distinct().withColumn("found", F.lit(True))
    found = found.unionByName(whole.join(known, key, "left").select(case, F.coalesce("found", F.lit(False)).alias("found")))
    found = found.groupBy(case).agg(F.count("*").alias("wanted"), F.count_if("found").alias("found"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = cited.join(found, case, "full_outer").select(case, X.ratio(n("relevant"), n("cited")).alias("citation_precision"), X.ratio(n("found"), n("wanted")).alias("citation_recall"), X.ratio(n("grounded"), n("cited")).alias("groundedness"))
    return out.select(case, "citation_precision", "citation_recall", X.f1("citation_precision", "citation_recall").alias("citation_f1"), "groundedness")


def answer_metrics(replies: DataFrame, terms: DataFrame, groundedness: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """case, completeness, forbidden_claim_rate and, with groundedness(case, groundedness, citations), the rates of unsupported citations
    and of hallucination. terms(case, concept, term): a concept is met if the answer has any of its terms; terms without a
    concept are forbidden. An answer counts once for each case; without concepts completeness is 1."""
    said = replies.select(case, X.answer_text(F.coalesce("answer", F.lit(""))).alias("said"))
    met = terms.join(said, case).select(case, "concept", "term", F.col("said").contains(X.answer_text("term")).alias("holds"))
    concepts = met.where("concept IS NOT NULL").groupBy(case, "concept").agg(F.max("holds").alias("holds")).groupBy(case).agg(F.count("*").alias("concepts"), F.count_if("holds").alias("met"))
    banned = met.where("concept IS NULL").groupBy(case).agg(F.count("*").alias("forbidden"), F.count_if("holds").alias("claimed"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = said.select(case).join(concepts, case, "left").join(banned, case, "left")
    out = out.select(case, X.ratio(n("met"), n("concepts"), 1.0).alias("completeness"), X.ratio(n("claimed"), n("forbidden")).alias("forbidden_claim_rate"))
    if groundedness is None:
        return out
    bad = F.when(n("citations") == 0, 1.0).otherwise(1 - F.col("groundedness"))
    out = out.join(groundedness, case, "left").select(case, "completeness", "forbidden_claim_rate", bad.alias("unsupported_citation_rate"))
    return out.withColumn("hallucination_rate", F.greatest("forbidden_claim_rate", "unsupported_citation_rate"))


def ranked_metrics(results: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "item", rank: str = "rank", groups: DataFrame | None = None, group: str = "group") -> DataFrame:
    """Recall and precision at 5 and 10, reciprocal rank and hit rate of ranked results(query, item, rank) against relevant(query, item).
    Items count at their first rank; all is aggregated by query, so large result sets spread over the cluster.

    Where many queries share what is relevant, groups(query, group) names each query's one group and relevant is (group, item):
    items are counted once a group, and no pair of a query and an item is made but those of the results."""
    from pyspark.sql import Window

    first = results.groupBy(query, item).agg(F.min(rank).alias("r")).withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy("r", item)))
    by = query if groups is None else group
    wanted = relevant.select(by, item).distinct()
    total = wanted.groupBy(by).agg(F.count("*").alias("expected"))
    if groups is not None:
        asked = groups.select(query, group).distinct()
        first, total = first.join(asked, query), asked.join(total, group).drop(group)
    hits = first.join(wanted, [by, item]).groupBy(query).agg(F.count_if(F.col("r") <= 5).alias("h5"), F.count_if(F.col("r") <= 10).alias("h10"), F.count("*").alias("h"), F.min("r").alias("best"))
    out = total.join(hits, query, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        query, X.ratio(n("h5"), "expected").alias("recall_at_5"), X.ratio(n("h10"), "expected").alias("recall_at_10"), (n("h5") / 5).alias("precision_at_5"), (n("h10") / 10).alias("precision_at_10"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mean_reciprocal_rank"), X.ratio(n("h"), "expected").alias("exact_file_hit_rate"),
    )


def score(cases: DataFrame, observations: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """A row of metrics per case. A case without an observation is a failure with zeros; an observation without a case is an error."""
    prices = prices or {}
    if not observations.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_anti").isEmpty():
        raise InvalidRows("an observation of an unknown case")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    types = dict(cases.dtypes) | dict(observations.dtypes)
    arr = lambda c: empty(c, types[c])
    df = cases.join(observations, cases["id"] == observations["case_id"], "left").withColumn("success", F.col("case_id").isNotNull())
    df = df.withColumns({c: arr(c) for c in ("expected_files", "expected_symbols", "expected_line_ranges", "expected_answer_concepts", "forbidden_answer_terms", "retrieved_sources", "citations")})
    ranked = F.array_distinct(F.transform("retrieved_sources", lambda s: s["file_path"]))
    wanted = F.array_distinct("expected_files")
    df = df.withColumns({"ranked": ranked, "wanted": wanted})
    hits = lambda k: F.size(F.array_intersect(F.slice("ranked", 1, k), F.col("wanted")))
    places = F.filter(F.transform("ranked", lambda f, i: F.when(F.array_contains("wanted", f), i + 1)), lambda i: i.isNotNull())
    count = lambda a, f: F.size(F.filter(a, f))
    symbols = F.transform("retrieved_sources", lambda s: s["symbol_name"])
    found_symbols = count("expected_symbols", lambda s: F.coalesce(F.array_contains(symbols, s), F.lit(False)))
    found_lines = count("expected_line_ranges", lambda r: F.exists("retrieved_sources", lambda s: (s["file_path"] == r["file_path"]) & overlap(s, r)))
    null_if_empty = lambda c, v: F.when(F.size(c) > 0, v)
    df = df.withColumns({
        "recall_at_5": X.clamp(X.ratio(hits(5), F.size("wanted"))), "recall_at_10": X.clamp(X.ratio(hits(10), F.size("wanted"))), "precision_at_5": X.clamp(hits(5) / 5), "precision_at_10": X.clamp(hits(10) / 10),
        "mean_reciprocal_rank": F.coalesce(1 / F.try_element_at(places, F.lit(1)), F.lit(0.0)),
        "exact_file_hit_rate": X.ratio(count("expected_files", lambda f: F.array_contains("ranked", f)), F.size("wanted")),
        "exact_symbol_hit_rate": null_if_empty("expected_symbols", found_symbols / F.size("expected_symbols")), "line_hit_rate": null_if_empty("expected_line_ranges", found_lines / F.size("expected_line_ranges")),
    })
    ranged = F.transform("expected_line_ranges", lambda r: r["file_path"])
    unit = lambda path, a, b: F.struct(path.alias("file_path"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"))
    units = F.concat(F.transform("expected_line_ranges", lambda r: unit(r["file_path"], r["start_line"], r["end_line"])), F.transform(F.filter("expected_files", lambda f: ~F.array_contains(ranged, f)), lambda f: unit(f, F.lit(None), F.lit(None))))
    df = df.withColumn("units", units)
    match = lambda c, u: (c["file_path"] == u["file_path"]) & (u["start_line"].isNull() | u["end_line"].isNull() | overlap(c, u))
    inside = lambda c: F.exists("retrieved_sources", lambda s: (s["file_path"] == c["file_path"]) & (c["start_line"] >= s["start_line"]) & (c["end_line"] <= s["end_line"]))
    df = df.withColumns({
        "citation_precision": X.ratio(count("citations", lambda c: F.exists("units", lambda u: F.coalesce(match(c, u), F.lit(False)))), F.size("citations")),
        "citation_recall": X.ratio(count("units", lambda u: F.exists("citations", lambda c: F.coalesce(match(c, u), F.lit(False)))), F.size("units")),
        "groundedness": X.ratio(count("citations", inside), F.size("citations")),
    })
    df = df.withColumn("citation_f1", X.f1("citation_precision", "citation_recall")).withColumn("said", X.answer_text(F.coalesce("answer", F.lit(""))))
    holds = lambda t: F.col("said").contains(X.answer_text(t))
    df = df.withColumns({
        "completeness": X.ratio(count("expected_answer_concepts", lambda c: F.exists(c["terms"], holds)), F.size("expected_answer_concepts"), 1.0),
        "forbidden_claim_rate": X.ratio(count("forbidden_answer_terms", holds), F.size("forbidden_answer_terms")),
        "unsupported_citation_rate": F.when(F.size("citations") == 0, 1.0).otherwise(1 - F.col("groundedness")),
    }).withColumn("hallucination_rate", F.greatest("forbidden_claim_rate", "unsupported_citation_rate"))
    usd = {"embedding_usd": ("embedding_tokens", "embedding"), "input_usd": ("input_tokens", "input"), "output_usd": ("output_tokens", "output")}
    df = df.withColumns({name: X.price(F.col(f"usage.{tokens}"), F.lit(prices.get(key)).cast("double")) for name, (tokens, key) in usd.items()})
    some = F.coalesce(*usd)
    df = df.withColumn("total_usd", F.when(some.isNotNull(), sum((F.coalesce(F.col(c), F.lit(0.0)) for c in usd), F.lit(0.0))))
    failed = {c: F.when(F.col("success"), F.col(c)).otherwise(F.when(F.col(c).isNotNull(), 0.0) if c in NULLABLE else 0.0) for c in [*RETRIEVAL, *CITATIONS, *ANSWERS]}
    df = df.withColumns(failed | {c: F.when(F.col("success"), F.col(c)) for c in [*usd, "total_usd"]})
    return df.select("id", "success", *RETRIEVAL, *CITATIONS, *ANSWERS, *usd, "total_usd", "timings", "usage")


def p95(c: str | Column) -> Column:
    """Nearest rank: the value at position ceil(0.95 n)."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})") if isinstance(c, str) else F.percentile(c, 0.95)


def aggregate(scored: DataFrame) -> DataFrame:
    """One row: means over all cases (of nullable metrics over those that have them), latencies and tokens over successful ones, costs."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    flat = scored.select("*", *[ok(f"timings.{t}").alias(t) for t in ("retrieval_ms", "generation_ms", "indexing_ms")], *[ok(f"usage.{t}").alias(t) for t in ("embedding_tokens", "input_tokens", "output_tokens")])
    mean = lambda c: F.avg(c) if c in NULLABLE else F.coalesce(F.avg(c), F.lit(0.0))
    out = flat.agg(
        F.count("*").alias("case_count"), F.count_if("success").alias("successful_case_count"), *[mean(c).alias(c) for c in [*RETRIEVAL, *CITATIONS, *ANSWERS]],
        *[F.avg(f"{t}_ms").alias(f"{t}_avg_ms") for t in ("retrieval", "generation", "indexing")], *[p95(f"{t}_ms").alias(f"{t}_p95_ms") for t in ("retrieval", "generation", "indexing")],
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in ("embedding_tokens", "input_tokens", "output_tokens")], *[F.sum(c).alias(c) for c in ("embedding_usd", "input_usd", "output_usd", "total_usd")],
    )
    return out.withColumn("case_success_rate", X.ratio("successful_case_count", "case_count"))


def gates(aggregated: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metric, operator, threshold, actual, violated of the gates that have a threshold; a missing actual violates."""
    rows = [F.struct(F.lit(metric).alias("metric"), F.lit(op).alias("operator"), F.lit(float(thresholds[key])).alias("threshold"), F.col(metric).cast("double").alias("actual")) for key, metric, op in GATES if key in thresholds]
    if not rows:
        return aggregated.sparkSession.createDataFrame([], "metric string, operator string, threshold double, actual double, violated boolean")
    wrong = F.when(F.col("operator") == ">=", F.col("actual") < F.col("threshold")).otherwise(F.col("actual") > F.col("threshold"))
    return aggregated.select(F.explode(F.array(*rows)).alias("g")).select("g.*").withColumn("violated", F.coalesce(wrong, F.lit(True)))


def report(name: str, scored: DataFrame, thresholds: dict[str, float], started, completed) -> DataFrame:
    """One row with the whole report; passed: no case failed and no gate is violated."""
    total = aggregate(scored).withColumn("k", F.lit(1))
    broken = gates(total, thresholds).where("violated").agg(F.sort_array(F.collect_list(F.struct("metric", "operator", "threshold", "actual"))).alias("violations")).withColumn("k", F.lit(1))
    cases = scored.agg(F.sort_array(F.collect_list(F.struct("id", "success", *RETRIEVAL, *CITATIONS, *ANSWERS, "total_usd"))).alias("cases")).withColumn("k", F.lit(1))
    columns = [c for c in total.columns if c != "k"]
    return total.join(broken, "k").join(cases, "k").select(
        F.lit(1).alias("schema_version"), F.lit(name).alias("dataset_name"), F.lit(started).cast("timestamp").alias("started_at"), F.lit(completed).cast("timestamp").alias("completed_at"),
        F.greatest(F.lit(0), (F.unix_millis(F.lit(completed).cast("timestamp")) - F.unix_millis(F.lit(started).cast("timestamp")))).alias("duration_ms"),
        ((F.col("successful_case_count") == F.col("case_count")) & (F.size("violations") == 0)).alias("passed"), F.struct(*columns).alias("aggregate"), "violations", "cases",
    )


def replay(recording: DataFrame) -> DataFrame:
    """Observations from a recording whose ``observations`` is a map by case id."""
    return recording.select(F.explode("observations").alias("case_id", "o")).select("case_id", "o.*")


def run_live(cases: DataFrame, target: Callable[[str, str], dict], workers: int = 16, timeout: float | None = None, order: str | None = None) -> DataFrame:
    """case_id, observation (JSON), error of each case: failures become rows, so one bad case does not end the run. A case of over
    ``timeout`` seconds has the error TimeoutError. ``order``: a column of the cases by which the rows are put in the dataset's order."""
    import json
    from concurrent.futures import ThreadPoolExecutor

    if not 1 <= workers <= 16:
        raise ValueError("workers must be between 1 and 16")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for case, question in zip(p["id"], p["question"], strict=True):
                pool = ThreadPoolExecutor(1)  # one a case: what has timed out may still be running
                try:
                    rows.append((case, json.dumps(pool.submit(target, case, question).result(timeout)), None))
                except Exception as e:  # noqa: BLE001  the contract: any failure of the target is a row
                    rows.append((case, None, type(e).__name__))
                finally:
                    pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(rows, columns=["case_id", "observation", "error"])

    out = cases.select("id", "question").repartition(workers).mapInPandas(run, "case_id string, observation string, error string")
    if order is None:
        return out
    at = cases.groupBy(F.col("id").alias("case_id")).agg(F.min(order).alias("__at"))
    return out.join(at, "case_id").orderBy("__at", "case_id").drop("__at")


def problems(cases: DataFrame) -> DataFrame:
    """case, problem of the rules that cases break."""
    rules = {
        "id": F.coalesce(X.trimmed("id") != "", F.lit(False)), "question": F.coalesce(X.trimmed("question") != "", F.lit(False)), "expected_files": F.coalesce(F.size("expected_files") > 0, F.lit(False)),
        "repeated file": F.coalesce(F.size(F.array_distinct("expected_files")) == F.size("expected_files"), F.lit(True)),
        "path": F.coalesce(F.forall("expected_files", lambda f: ~f.rlike(r"^/|\\|\x00|(^|/)\.{0,2}(/|$)")), F.lit(True)),
        "lines": F.coalesce(F.forall("expected_line_ranges", lambda r: (r["start_line"] >= 1) & (r["end_line"] >= r["start_line"])), F.lit(True)),
    }
    each = cases.select(F.col("id").alias("case"), F.explode(F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))).alias("problem"))
    return each.unionByName(cases.groupBy(F.col("id").alias("case")).count().where("count > 1").select("case", F.lit("repeated id").alias("problem")))


#: The most sources and citations of an observation, and characters of an answer (fixed values).
MAX_SOURCES, MAX_ANSWER = 10_000, 1_000_000
PRICES = ["embedding", "input", "output"]


def _path_ok(f: Column) -> Column:
    return f.isNotNull() & (X.trimmed(f) != "") & ~f.rlike(r"^/|\\|\x00|(^|/)\.{0,2}(/|$)")


def observation_problems(observations: DataFrame) -> DataFrame:
    """case, problem of the rules that observations break; null arrays are empty, null usage and its parts are absent."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    lines = lambda s: (s["start_line"] >= 1) & (s["end_line"] >= s["start_line"]) & _path_ok(s["file_path"])
    each = lambda c, rule: F.coalesce(F.forall(c, lambda x: F.coalesce(rule(x), F.lit(False))), F.lit(True))
    time = lambda c: finite(F.col(f"timings.{c}")) & (F.col(f"timings.{c}") >= 0)
    needed = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "id": needed(X.trimmed("case_id") != ""), "answer": needed((X.trimmed("answer") != "") & (X.utf16_length(F.col("answer")) <= MAX_ANSWER)),
        "sources": F.coalesce(F.size("retrieved_sources") <= MAX_SOURCES, F.lit(True)), "citations": F.coalesce(F.size("citations") <= MAX_SOURCES, F.lit(True)),
        "source": each("retrieved_sources", lambda s: lines(s) & F.coalesce(finite(s["score"]), F.lit(True))), "citation": each("citations", lines),
        "timings": needed(time("retrieval_ms")) & needed(time("generation_ms")) & F.coalesce(time("indexing_ms"), F.lit(True)),
        "usage": F.coalesce(F.least(*[F.coalesce(F.col(f"usage.{t}"), F.lit(0)) for t in ("embedding_tokens", "input_tokens", "output_tokens")]) >= 0, F.lit(True)),
    }
    found = observations.select(F.col("case_id").alias("case"), F.explode(F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))).alias("problem"))
    return found.unionByName(observations.groupBy(F.col("case_id").alias("case")).count().where("count > 1").select("case", F.lit("repeated id").alias("problem")))


def setting_problems(thresholds: dict | None = None, prices: dict | None = None) -> list[str]:
    """The names in thresholds and prices that are unknown or have a value out of bounds: rates lie between 0 and 1, all others are finite and not negative."""
    known = {key: metric for key, metric, _ in GATES}
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and 0 <= v < float("inf")
    free = {"retrieval_p95_ms", "generation_p95_ms", "indexing_p95_ms", "total_usd"}
    wrong = [k for k, v in (thresholds or {}).items() if k not in known or not number(v) or (known[k] not in free and v > 1)]
    return wrong + [k for k, v in (prices or {}).items() if k not in PRICES or not number(v)]


def main(argv: list[str] | None = None) -> int:
    """Scores a dataset against a recording: 0 passed, 1 a gate or case failed, 2 the input is wrong."""
    import argparse
    import datetime
    import json
    import sys

    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(prog="python -m siltwork.operators.evaluation")
    for name in ("--cases", "--recording", "--output"):
        p.add_argument(name, required=name != "--output")
    p.add_argument("--thresholds")
    try:
        a = p.parse_args(argv)
    except SystemExit:
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        started = datetime.datetime.now(datetime.UTC)
        cases = spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(a.cases)
        recording = spark.read.schema(f"observations map<string, struct<{OBSERVATION.replace('case_id string, ', '').replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct').replace(' map', ':map')}>>").option("multiLine", True).json(a.recording)
        thresholds = json.loads("".join(r[0] for r in spark.read.text(a.thresholds).collect())) if a.thresholds else {}
        held = replay(recording)
        if setting_problems(thresholds) or not problems(cases).isEmpty() or not observation_problems(held).isEmpty():
            return 2
        row = report(a.cases, score(cases, held), thresholds, started, datetime.datetime.now(datetime.UTC))
        if a.output:
            row.write.mode("overwrite").json(a.output)
        return 0 if row.first()["passed"] else 1
    except Exception as e:  # noqa: BLE001  the exit code is the contract
        print(type(e).__name__, file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
