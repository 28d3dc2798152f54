"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame functions only.

The fixed patterns give the base spans. They are the seeds: the words around them become lexical patterns
(a kind, and the two words before, or the words before and after). Instances of the same kind of shape that
no fixed pattern takes (an address written with "(at)", a telephone number without "+", ...) stand in a
graph with the patterns in which they occur. Scores go to and fro: a pattern's score is the mean score of
its instances (smoothed), an instance's is one minus the product of what its patterns leave open; seeds
stay at 1. Rounds go on until the scores settle. Instances of a score of at least ``accept`` become spans of the kind ``context``.

A text is read once: its base spans and candidates are a narrow row, which is checkpointed. Positions come
from splitting at marks put around each match; the mark's own character is first exchanged for another one,
so positions hold for any text. The words of a context are whole words, however long; one of over ``LONG_WORD``
characters stands for itself by its digest.

Defined results: a null or empty text has no span; texts of any length are read whole; repeated rows keep their own
spans; spans of different kinds may overlap; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.sources.session import shared_folder

#: Fixed patterns of the base kinds, in the order in which kinds are listed. Possessive where nothing can be
#: given back, so that long runs neither recurse nor are tried again from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Shapes of candidates: addresses with a written-out sign, and groups of digits as long as the identifiers of the base
#: kinds may be (7 to 19 digits, two neighbours parted by two signs at most).
CANDIDATE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9.-]++|(?<![A-Za-z0-9])[0-9](?:[ ().-]{0,2}[0-9]){6,18}+(?![A-Za-z0-9])"
_CANDIDATE_NEEDS = r"@|[(\[](?:at|AT)[)\]]|[0-9](?:[ ().-]{0,2}[0-9]){6}"
LONG_WORD = 64
#: So many patterns are broadcast to their instances. More are joined by shuffle, from checkpoints, so that Spark can split a
#: pattern that holds a large part of all instances.
BROADCAST_PATTERNS = 200_000
KINDS = [*PATTERNS, "context"]


def _parts(text: Column, pattern: str, needs: str) -> Column:
    """What stands before, in and between the matches, in turn; null if the text has none."""
    marked = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x01"), "\x01", -1)
    return F.when(text.rlike(needs), marked)


_SPAN = "array<struct<start:int,end:int,text:string>>"
#: Parts are summed up in blocks of so many (an even number), so that a text with very many matches takes no square of them.
_BLOCK = 512


def _ends(lengths: Column) -> Column:
    """The running sums of an array."""

    def grow(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    inside = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(_BLOCK)), lambda k: F.aggregate(F.slice(lengths, k, F.lit(_BLOCK)), zero, grow))
    whole = F.aggregate(F.transform(inside, lambda b: b["at"]), zero, grow, lambda acc: acc["ends"])
    return F.flatten(F.zip_with(inside, whole, lambda b, end: F.transform(b["ends"], lambda e: e + end - b["at"])))


def _placed(parts: Column) -> Column:
    """Starts, ends and texts of the matches among parts; ends are exclusive, in code points."""
    at = F.struct(parts.alias("parts"), _ends(F.transform(parts, F.char_length)).alias("ends"))
    spans = F.transform(F.array(at), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["parts"]) - 1, F.lit(2)), lambda i: F.struct(F.get(x["ends"], i - 1).alias("start"), F.get(x["ends"], i).alias("end"), F.get(x["parts"], i).alias("text"))))
    return F.when(F.size(parts) > 1, F.get(spans, F.lit(0)).cast(_SPAN))


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """True if one of the spans, which are sorted and apart, meets start..end: by binary search for the last that begins before ``end``."""
    n = F.size(spans)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        before = F.get(spans, middle)["start"] < end
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda acc: acc["low"] - 1)
    return F.when(n > 0, F.coalesce(F.get(spans, last)["end"] > start, F.lit(False))).otherwise(False)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _holds(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(text)
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _held(kind: str) -> Column:
    return F.filter(F.coalesce(F.col(kind), F.array().cast(_SPAN)), lambda s: _holds(kind, s["text"]))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _context(part: Column, pattern: str, group: int, back: bool) -> Column:
    """A word next to a match in lower case, digits as 0; null if there is none. What stands before is read backwards, so
    that the pattern is tried at one place only."""
    word = F.regexp_extract(F.reverse(part) if back else part, pattern, group)
    word = F.regexp_replace(F.lower(F.reverse(word) if back else word), "[0-9]", "0")
    return F.nullif(F.when(F.length(word) > LONG_WORD, F.sha2(F.encode(word, "UTF-8"), 256)).otherwise(word), F.lit(""))


_BEFORE, _BEFORE2, _AFTER = r"^[+(]*+\s++(\S++)", r"^[+(]*+\s++\S++\s++(\S++)", r"^\s*+(\S++)"


def base(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row, an array of base spans of each kind, and the candidates with the words around them. One pass, no shuffle."""
    text = F.translate(F.coalesce(docs[text_column], F.lit("")), "\x01", "\x02")
    src = docs.select(docs[id_column].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    cut = src.select("doc_id", "row", *[_parts(F.col("text"), p, _NEEDS[k]).alias(k) for k, p in PATTERNS.items()], _parts(F.col("text"), CANDIDATE, _CANDIDATE_NEEDS).alias("parts"))
    placed = cut.select("doc_id", "row", *[_placed(F.col(k)).alias(k) for k in PATTERNS], "parts", _placed(F.col("parts")).alias("found"))
    kept = placed.select("doc_id", "row", *[_held(k).alias(k) for k in PATTERNS], "parts", "found")
    def seed(s: Column) -> Column:
        kind = F.lit(None).cast("string")
        for k in reversed(list(PATTERNS)):
            kind = F.when(_meets(F.col(k), s["start"], s["end"]), k).otherwise(kind)
        return kind

    around = F.transform(
        F.col("found"),
        lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lower(s["text"]).alias("text"),
            _context(F.get(F.col("parts"), 2 * i), _BEFORE, 1, True).alias("l1"), _context(F.get(F.col("parts"), 2 * i), _BEFORE2, 1, True).alias("l2"),
            _context(F.get(F.col("parts"), 2 * i + 2), _AFTER, 1, False).alias("r"), seed(s).alias("seed"),
        ),
    )
    return kept.select("doc_id", "row", *PATTERNS, F.when(F.col("found").isNotNull(), around).alias("candidates"))


def candidates(narrow: DataFrame) -> DataFrame:
    """A row per candidate: its kind of shape, whether a base span meets it, and its lexical patterns."""
    c = narrow.select("row", F.explode("candidates").alias("c"))
    n = F.length(_digits(F.col("c.text")))
    shape = F.when(F.col("c.text").rlike(r"@|[(\[]at[)\]]"), "email").when(F.col("c.text").rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(n >= 13, "card").when(n.between(7, 12), "phone")
    c = c.select("row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.text").alias("text"), "c.seed", F.coalesce("c.seed", shape).alias("kind"), "c.l1", "c.l2", "c.r")
    patterns = F.filter(F.array(F.concat(F.lit("before "), "l2", F.lit(" "), "l1"), F.concat(F.lit("around "), "l1", F.lit(" _ "), "r")), lambda p: p.isNotNull())
    return c.where("kind is not null").select("row", "start", "end", "text", "seed", "kind", patterns.alias("patterns"))


def bootstrap(found: DataFrame, rounds: int = 1000, support: int = 3, accept: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """kind, text, score of the accepted instances that no base span meets. found: rows of :func:`candidates`.

    Rounds go on until no score moves by ``tolerance`` and no pattern joins; more than ``rounds`` are an error. A
    pattern scores once ``support`` of its instances are seeds or accepted. From 0, scores only rise, so
    the outcome does not depend on the order. Instances of one pattern alone are solved at once with its score.
    """
    edges = found.select("kind", "text", F.explode("patterns").alias("pattern"), F.col("seed").isNotNull().alias("is_seed"))
    edges = edges.groupBy("kind", "pattern", "text").agg(F.max("is_seed").alias("is_seed"))
    # Only patterns with other instances can find any, and fewer instances than the support never score.
    of = edges.groupBy("kind", "pattern").agg(F.sum(F.col("is_seed").cast("long")).alias("seeds"), F.count("*").alias("instances"))
    of = of.where((F.col("instances") >= support) & (F.col("instances") > F.col("seeds")))
    of = of.checkpoint()
    edges = edges.where("not is_seed").join(F.broadcast(of) if of.count() <= BROADCAST_PATTERNS else of, ["kind", "pattern"]).select("kind", "pattern", "text", "seeds", "instances").checkpoint()
    scored = edges.select("kind", "text").distinct().withColumn("score", F.lit(0.0)).checkpoint()
    for _ in range(rounds):
        now = edges.join(scored, ["kind", "text"])
        backed = F.max("seeds") + F.sum((F.col("score") >= accept).cast("long"))
        able = now.groupBy("kind", "pattern").agg(backed.alias("backed")).where(F.col("backed") >= support).drop("backed").checkpoint()
        few = able.count() <= BROADCAST_PATTERNS
        now = now.join(F.broadcast(able) if few else able, ["kind", "pattern"], "left_semi")
        now = now.join(now.groupBy("kind", "text").agg(F.count("*").alias("of")), ["kind", "text"]).checkpoint()
        others, alone = F.sum(F.when(F.col("of") > 1, F.col("score")).otherwise(0.0)), F.sum((F.col("of") == 1).cast("long"))
        patterns = now.groupBy("kind", "pattern").agg(((F.max("seeds") + others) / (F.max("instances") + 2 - alone)).alias("p"))
        new = now.join(F.broadcast(patterns) if few else patterns.checkpoint(), ["kind", "pattern"]).groupBy("kind", "text").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.99)))))).alias("new"))
        moved = scored.join(new, ["kind", "text"], "left").withColumn("new", F.greatest("score", F.coalesce("new", F.lit(0.0))))
        moved = moved.select("kind", "text", F.col("new").alias("score"), (F.col("new") - F.col("score")).alias("step"), ((F.col("new") >= accept) & (F.col("score") < accept)).alias("joined")).checkpoint()
        scored = moved.select("kind", "text", "score")
        step, joined = moved.agg(F.coalesce(F.max("step"), F.lit(0.0)), F.coalesce(F.max("joined"), F.lit(False))).first()
        if step < tolerance and not joined:
            return scored.where(F.col("score") >= accept)
    raise RuntimeError(f"scores of contextual patterns still move after {rounds} rounds")


def private_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans, and the number of spans found by context."""
    shared_folder(docs.sparkSession)
    narrow = base(docs, id_column, text_column).checkpoint()
    found = candidates(narrow)
    accepted = bootstrap(found, **options)
    new = found.where("seed is null").join(accepted, ["kind", "text"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("new"))
    all_base = F.flatten(F.array(*[_joined(k, F.col(k)) for k in PATTERNS]))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    out = narrow.select("doc_id", "row", *counts, all_base.alias("all")).join(new, "row", "left")
    more = F.coalesce(_joined("context", F.col("new")), F.array().cast("array<string>"))
    return out.select(
        "doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(F.encode(F.array_join("all", ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.concat("all", more), ",").alias("spans"), F.size(more).cast("long").alias("n_context"),
    )
