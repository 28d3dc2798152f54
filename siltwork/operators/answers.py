"""Question answering in batches: budgets for context and history, structured answers, citations, the pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.functions.checks import InvalidRows
from siltwork.operators import vectors as V
from siltwork.sources.session import shared_folder

# Fixed texts of a context block and of an answer without context.
BEGIN, END, CUT = "--- BEGIN UNTRUSTED REPOSITORY SOURCE ---", "--- END UNTRUSTED REPOSITORY SOURCE ---", "\n[context truncated]"
NO_CONTEXT = "I could not find enough relevant evidence in the indexed repository to answer that question."
HISTORY_MESSAGES = 10


def last_messages(messages: DataFrame, key: str = "conv_id", order: str = "turn", n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last n messages of each conversation, in ascending order within it."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def history(messages: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """The newest messages that fit a budget of UTF-16 units with their separators: kept until the first that does not fit."""
    line = F.concat(F.when(F.col(role) == "user", "User").otherwise("Assistant"), F.lit(": "), X.trimmed(content))
    w = W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    sized = messages.withColumn("line", line).withColumn("used", F.sum(X.utf16_length("line") + 2).over(w) - 2)
    return sized.where(F.col("used") <= budget)


def history_text(messages: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", **names) -> DataFrame:
    kept = history(messages, budget, key, order, **names)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n\n").alias("history"))


def heading(reference: Column, path: str = "file_path", language: str = "language", start: str = "start_line", end: str = "end_line", kind: str | None = "symbol_type", name: str | None = "symbol_name") -> Column:
    optional = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in (("Symbol type", kind), ("Symbol name", name)) if c]
    return F.concat_ws(
        "\n", F.concat(F.lit("Source ID: "), reference), F.concat(F.lit("File: "), F.col(path)), F.concat(F.lit("Language: "), F.col(language)),
        F.concat(F.lit("Lines: "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")), *optional,
    )


def context(sources: DataFrame, budget: int, key: str = "question_id", rank: str = "rank", item: str = "id", **columns) -> DataFrame:
    """Sources as blocks while they fit: each id once, numbered S1, S2, ...; the block that does not fit is cut, and is the last.
    No block is left out before that one, so a running sum decides."""
    first = W.partitionBy(key, item).orderBy(rank)
    by = W.partitionBy(key).orderBy(rank)
    once = sources.withColumn("__n", F.row_number().over(first)).where("__n = 1").withColumn("__n", F.row_number().over(by))
    once = once.withColumn("reference", F.concat(F.lit("S"), F.col("__n").cast("string")))
    prefix = F.concat(F.lit(BEGIN + "\n"), heading(F.col("reference"), **columns), F.lit("\n\n"))
    gap = F.when(F.col("__n") == 1, 0).otherwise(2)
    sized = once.withColumn("__prefix", prefix).withColumn("__fixed", gap + X.utf16_length("__prefix") + len("\n" + END)).withColumn("__own", X.utf16_length("content"))
    before = F.coalesce(F.sum(F.col("__fixed") + F.col("__own")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - before - F.col("__fixed")
    sized = sized.withColumn("__room", room).where("__room > 0")
    cut = F.when(F.col("__own") <= F.col("__room"), F.col("content")).when(F.col("__room") <= len(CUT), F.left(F.lit(CUT), F.col("__room").cast("int"))).otherwise(F.concat(X.utf16_prefix("content", F.col("__room") - len(CUT)), F.lit(CUT)))
    out = sized.withColumn("block", F.concat("__prefix", cut, F.lit("\n" + END))).withColumn("truncated", F.col("__own") > F.col("__room"))
    return out.drop("__n", "__prefix", "__fixed", "__own", "__room")


def context_text(blocks: DataFrame, key: str = "question_id", rank: str = "rank") -> DataFrame:
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "block"))), lambda x: x["block"]), "\n\n").alias("context"))


ANSWER_SCHEMA = "struct<segments:array<struct<text:string,sourceIds:array<string>>>>"


def structured(answers: DataFrame, column: str = "output") -> DataFrame:
    """Adds ``segments`` of a provider's JSON and ``valid``: exact keys, no empty segment, no citation marks inside the text."""
    parsed = F.from_json(column, ANSWER_SCHEMA)
    raw = F.get_json_object(column, "$.segments")
    each = F.from_json(raw, "array<map<string,string>>")
    keys = F.forall(each, lambda m: F.array_sort(F.map_keys(m)) == F.array(F.lit("sourceIds"), F.lit("text")))
    exact = (F.json_object_keys(column) == F.array(F.lit("segments"))) & F.coalesce(keys, F.lit(False))
    good = lambda s: (X.trimmed(s["text"]) != "") & ~s["text"].rlike(r"\[(?:S\d+|[^\]\r\n]+:L\d+-L\d+)\]") & (F.size(s["sourceIds"]) > 0) & F.forall(s["sourceIds"], lambda i: i.isNotNull())
    segments = F.transform(parsed["segments"], lambda s: F.struct(X.trimmed(s["text"]).alias("text"), F.array_distinct(s["sourceIds"]).alias("source_ids")))
    valid = F.coalesce(exact & (F.size(parsed["segments"]) > 0) & F.forall(parsed["segments"], good), F.lit(False))
    return answers.withColumn("segments", segments).withColumn("valid", valid)


def cited(segments: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    """question, answer, citations: each segment with its citations, sources in the order of first use. An unknown source fails."""
    s = segments.select(key, F.posexplode("segments").alias("pos", "s")).select(key, "pos", "s.text", F.posexplode("s.source_ids").alias("at", "reference"))
    own = s.join(sources.select(key, "reference", "file_path", "start_line", "end_line"), [key, "reference"], "left")
    if not own.where("file_path is null").isEmpty():
        raise InvalidRows("an answer cites an unknown source")
    own = own.withColumn("mark", X.citation("file_path", "start_line", "end_line"))
    marks = own.groupBy(key, "pos", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "mark"))), lambda x: x["mark"]), " ").alias("marks"))
    text = marks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "text", "marks").alias("t")))), lambda x: x["t"]), "\n\n").alias("answer"))
    used = own.groupBy(key, "reference", "file_path", "start_line", "end_line").agg(F.min(F.struct("pos", "at")).alias("first"))
    cites = used.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "reference", "file_path", "start_line", "end_line"))), lambda x: F.struct(x["reference"].alias("reference"), x["file_path"].alias("file_path"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))).alias("citations"))
    return text.join(cites, key)


def extractive_answer(question: str, references: list[str], context: str) -> str:
    """A deterministic provider for tests: says which sources were found."""
    import json

    return json.dumps({"segments": [{"text": f"Relevant code for: {question.strip()}", "sourceIds": references}]})


def ask(questions: DataFrame, points: DataFrame, embed: Callable = V.hashing_embedder, answer: Callable[[str, list[str], str], str] = extractive_answer, k: int = V.TOP, budget: int = 24_000, size: int = 64) -> DataFrame:
    """question_id, category, answer, citations of questions(question_id, question). points: stored chunks with embeddings, all of one scope.
    Symbols are sought exactly only for questions of that class; a question that nothing is found for gets the fixed answer."""
    shared_folder(questions.sparkSession)
    asked = questions.select("question_id", "question", X.question_class("question").alias("category"), X.exact_symbol("question").alias("symbol"))
    vectors = V.embed(asked.select(F.col("question_id").alias("id"), F.col("question").alias("text")), embed, size)
    semantic = V.top_k(points, vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), k, key="point_id").select(F.col("query_id").alias("question_id"), "point_id", "score", "rank")
    named = asked.where("category = 'exact_symbol'").select("question_id", "symbol")
    defined = points.join(named, points["symbol_name"] == named["symbol"]).select("question_id", "point_id", F.lit(0).alias("part"), "file_path", "start_line", "chunk_index")
    used = defined.limit(0)
    if "references" in points.columns:
        refers = points.select("point_id", "file_path", "start_line", "chunk_index", F.explode(F.array_distinct("references")).alias("symbol"))
        used = refers.join(named, "symbol").select("question_id", "point_id", F.lit(1).alias("part"), "file_path", "start_line", "chunk_index")
    both = defined.unionByName(used).groupBy("question_id", "point_id", "file_path", "start_line", "chunk_index").agg(F.min("part").alias("part"))
    exact = both.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("part", "file_path", "start_line", "chunk_index"))).where(F.col("rank") <= k)
    found = V.merge(exact.select("question_id", "point_id", "rank"), semantic, ["question_id", "point_id"], k)
    blocks = context(found.join(points.drop("embedding"), "point_id").withColumn("id", F.col("point_id")), budget).checkpoint()
    text = context_text(blocks).join(blocks.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reference"))), lambda x: x["reference"]).alias("references")), "question_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"question_id": p["question_id"], "output": [answer(q, list(r), c) for q, r, c in zip(p["question"], p["references"], p["context"], strict=True)]})

    output = structured(text.join(asked, "question_id").select("question_id", "question", "references", "context").mapInPandas(run, "question_id long, output string"))
    if not output.where("not valid").isEmpty():
        raise InvalidRows("the provider returned an invalid structured answer")
    answers = cited(output, blocks)
    return asked.select("question_id", "category").join(answers, "question_id", "left").withColumn("answer", F.coalesce("answer", F.lit(NO_CONTEXT)))


def exchange(questions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) to append: a title of the first 200 characters, and two messages for each question."""
    both = questions.join(answers, "question_id")
    conversations = both.select(F.col("question_id").alias("conversation_id"), X.utf16_prefix(X.trimmed("question"), F.lit(200)).alias("title"))
    user = both.select(F.col("question_id").alias("conversation_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content"))
    return conversations, user.unionByName(both.select(F.col("question_id").alias("conversation_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
