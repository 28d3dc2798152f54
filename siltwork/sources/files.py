"""Snapshots of files: scan, inclusion policy, text decoding, JSON documents, catalogs of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions import text as X
from siltwork.functions.checks import BoundExceeded, at_most, total_at_most
from siltwork.sources import listing
from siltwork.sources.session import shared_folder

# The inclusion policy.
EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".json", ".md", ".css", ".scss", ".html"]
IGNORED_DIRECTORIES = [".git", ".next", ".cache", ".output", ".turbo", "build", "coverage", "dist", "node_modules", "out", "temp", "tmp", "vendor"]
SECRET_NAMES = [".env", ".npmrc", ".pypirc", "credentials.json", "service-account.json", "id_rsa", "id_ed25519"]
SECRET_ENDINGS = [".pem", ".key", ".p12", ".pfx"]
LOCK_NAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "npm-shrinkwrap.json"]
GENERATED_ENDINGS = [".min.js", ".min.css", ".map"]
MAX_FILES, MAX_BYTES, MAX_FILE_BYTES, MAX_ENTRIES, MAX_DEPTH, SAMPLE_BYTES = 5_000, 100 << 20, 500 << 10, 100_000, 64, 8 << 10


def scan(spark: SparkSession, root: str, enter: Column | None = None, include: Column | None = None, max_entries: int | None = MAX_ENTRIES) -> DataFrame:
    """path (relative), name, depth, size, modified, content of the files below ``root``. enter, include: conditions on ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).unionByName(_dot_files(spark, root))
    plain = re.sub(r"^file:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(plain) + "/+", "")
    out = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    out = out.withColumn("name", X.name_of("path")).withColumn("depth", F.size(F.split("path", "/")) - 1).where(F.col("depth") <= MAX_DEPTH)
    for condition in (enter, include):
        out = out if condition is None else out.where(condition)
    return out if max_entries is None else at_most(out, max_entries, "directory entries")


def _dot_files(spark: SparkSession, root: str) -> DataFrame:
    """The files that Spark's own listing passes over: with names, or in directories, that begin with '.' or '_'. Tasks walk the tree."""
    found = listing.tree(spark, root, max_entries=MAX_ENTRIES, max_depth=MAX_DEPTH, max_bytes=MAX_FILE_BYTES, prune="/".join(IGNORED_DIRECTORIES))
    hidden = found.where(F.exists(F.split("path", "/"), lambda n: n.rlike("^[._]")))
    top = re.sub(r"^file:/*", "/", root).rstrip("/")
    return hidden.select(F.concat(F.lit(f"file:{top}/"), F.col("path")).alias("path"), F.col("modified").alias("modificationTime"), F.col("size").alias("length"), F.coalesce("content", F.lit(b"")).alias("content"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_secret(name: Column) -> Column:
    low = F.lower(name)
    return _any([low.isin(SECRET_NAMES), low.startswith(".env."), *[low.endswith(e) for e in SECRET_ENDINGS]])


def is_lock(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(LOCK_NAMES) | low.endswith(".lock")


def is_generated(name: Column) -> Column:
    return _any([F.lower(name).endswith(e) for e in GENERATED_ENDINGS])


def in_ignored_directory(path: Column) -> Column:
    parents = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parents, 1, F.greatest(F.size(parents) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRECTORIES)))


def exclusion_reason(path: Column, size: Column, ignored: Column | None = None, extensions: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first rule that keeps a file out, null if none does."""
    name = X.name_of(path)
    chain = F.when(in_ignored_directory(path), "default_ignored_directory").when(name == ".gitignore", "gitignore_file").when(is_secret(name), "secret_file").when(is_lock(name), "lock_file")
    chain = chain.when(is_generated(name), "generated_file").when(~X.extension_of(path).isin(extensions or EXTENSIONS), "unsupported_extension").when(size > max_bytes, "file_too_large")
    return chain if ignored is None else chain.when(ignored, "gitignore")


def is_binary(content: Column, size: Column | None = None) -> Column:
    """By the first 8 KiB: a NUL byte, bytes that are not UTF-8 (a cut last character is allowed), or over a tenth of control characters."""
    size = F.octet_length(content) if size is None else size
    sample = F.substring(content, 1, SAMPLE_BYTES)
    whole = lambda n: F.decode(F.substring(content, 1, n), "UTF-8")
    valid = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    cut = [SAMPLE_BYTES, SAMPLE_BYTES - 1, SAMPLE_BYTES - 2, SAMPLE_BYTES - 3]
    utf8 = F.when(size <= SAMPLE_BYTES, valid(SAMPLE_BYTES)).otherwise(_any([valid(n) for n in cut]))
    text = F.when(size <= SAMPLE_BYTES, F.try_validate_utf8(sample.cast("string"))).otherwise(F.coalesce(*[F.try_validate_utf8(F.substring(content, 1, n).cast("string")) for n in cut]))
    controls = F.length(F.regexp_replace(text, r"[^\x00-\x07\x0b\x0e-\x1f\x7f-\x{9f}]", ""))
    nul = F.locate("\0", F.decode(sample, "ISO-8859-1")) > 0
    return F.when(size == 0, False).when(nul, True).when(~utf8, True).otherwise(controls > 0.1 * X.utf16_length(text))


def source_text(content: Column) -> Column:
    """The text of a file, without a leading byte order mark; null if it is not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"^\x{FEFF}", "")


# -- ignore rules --


def patterns(text: str) -> list[tuple[str, bool, bool]]:
    """(regular expression of a whole path below the file's directory, negated, directories only) of the lines of an ignore file."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)((?:\\\\)*)\s+$", r"\1", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\") if line[negated:].startswith(("\\#", "\\!")) else line[negated:]
        only_directories = line.endswith("/")
        line = line.rstrip("/") if only_directories else line
        anchored = "/" in line
        parts, i = [], 0
        line = line.removeprefix("/")
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
                parts.append("(?:.*/)?")
                i += 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                parts.append("/.*")
                i += 3
            elif c == "*":
                while i + 1 < len(line) and line[i + 1] == "*":
                    i += 1
                parts.append("[^/]*")
                i += 1
            elif c == "?":
                parts.append("[^/]")
                i += 1
            elif c == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                body = re.sub(r"[\\\[&~]", r"\\\g<0>", line[i + 1 : end])
                parts.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
                i = end + 1
            else:
                if c == "\\" and i + 1 < len(line):
                    i += 1
                    c = line[i]
                parts.append(re.escape(c))
                i += 1
        out.append((("" if anchored else "(?:.*/)?") + "".join(parts), negated, only_directories))
    return out


@lru_cache(maxsize=1024)
def _rules(text: str) -> tuple[tuple[re.Pattern, bool, bool], ...]:
    return tuple((re.compile(p + r"\Z", re.I), negated, only) for p, negated, only in patterns(text))


def _verdict(rules, path: str, directory: bool) -> bool | None:
    """True: ignored, False: taken back, None: no rule."""
    found = None
    for pattern, negated, only_directories in rules:
        if (directory or not only_directories) and pattern.match(path):
            found = not negated
    return found


def ignored(path: str, rule_files: dict[str, str]) -> bool:
    """rule_files: directory ('' for the root) -> text. A file below an ignored directory is ignored; deeper rules win."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        part, state = "/".join(parts[:k]), False
        for d in ["/".join(parts[:j]) for j in range(k)]:
            if d in rule_files:
                inner = part[len(d) + 1 :] if d else part
                found = _verdict(_rules(rule_files[d]), inner, k < len(parts))
                state = state if found is None else found
        if state:
            return True
    return False


#: So many lines of ignore files are broadcast; more are joined by shuffle.
BROADCAST_RULES = 200_000


def rule_table(rules: DataFrame, key: list[str]) -> DataFrame:
    """key..., directory, nth, pattern, negated, only_directories: a row for each line of rules(key..., directory, rules)."""
    kinds = dict(rules.dtypes)

    def compiled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(*r[:-1], n, f"(?iu)^{line}\\z", negated, only) for r in p.itertuples(index=False, name=None) for n, (line, negated, only) in enumerate(patterns(r[-1] or ""))]
            yield pd.DataFrame(rows, columns=[*key, "directory", "nth", "pattern", "negated", "only_directories"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, "directory"])
    return rules.select(*key, "directory", "rules").mapInPandas(compiled, f"{fields}, nth int, pattern string, negated boolean, only_directories boolean")


def with_ignored(files: DataFrame, rules: DataFrame, key: list[str] | None = None) -> DataFrame:
    """files(key..., path) with ``ignored`` by rules(key..., directory, rules), the texts of ignore files.

    A path is ignored if it or a directory above it is. Each distinct path and directory is joined with the lines of the ignore
    files in the directories above it; the last line that matches, of the deepest file, decides. Directories are judged once,
    however many files they hold. Null paths are not ignored."""
    shared_folder(files.sparkSession)
    key = key or []
    lines = rule_table(rules, key).checkpoint()
    lines = F.broadcast(lines) if lines.count() <= BROADCAST_RULES else lines
    parts = F.split("path", "/")
    # a, a/b and a/b/c.ts of a/b/c.ts
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    paths = files.select(*key, "path").where("path IS NOT NULL").distinct().withColumn("n", F.size(parts))
    at = paths.select(*key, "path", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.struct(prefix(k).alias("part"), (k < F.col("n")).alias("is_directory")))).alias("p")).select(*key, "path", "p.*")
    judged = at.select(*key, "part", "is_directory").distinct()
    own = F.split("part", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(own, 1, k), "/").alias("directory"), F.array_join(F.slice(own, k + 1, F.size(own)), "/").alias("inner")))
    rows = judged.select(*key, "part", "is_directory", F.explode(above).alias("a")).select(*key, "part", "is_directory", "a.*").join(lines, [*key, "directory"])
    rows = rows.where((F.col("is_directory") | ~F.col("only_directories")) & F.rlike("inner", F.col("pattern")))
    gone = rows.groupBy(*key, "part", "is_directory").agg(F.max_by("negated", F.struct("depth", "nth")).alias("negated")).where("NOT negated").drop("negated")
    out = at.join(gone, [*key, "part", "is_directory"], "left_semi").select(*key, "path").distinct().withColumn("__ignored", F.lit(True))
    return files.join(out, [*key, "path"], "left").withColumn("ignored", F.coalesce("__ignored", F.lit(False))).drop("__ignored")


def snapshot(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded): accepted files with text and hash, and path, reason of the others. Binary files are looked at last."""
    files = scan(spark, root)
    rules = files.where("name = '.gitignore'").where(~in_ignored_directory(F.col("path"))).select(F.when(F.col("path").contains("/"), X.directory_of("path")).otherwise("").alias("directory"), source_text(F.col("content")).alias("rules"))
    judged = with_ignored(files, rules) if not rules.isEmpty() else files.withColumn("ignored", F.lit(False))
    judged = judged.withColumn("reason", exclusion_reason(F.col("path"), F.col("size"), F.col("ignored")))
    kept = total_at_most(at_most(judged.where("reason is null"), max_files, "files"), F.col("size"), max_bytes, "bytes")
    kept = kept.withColumn("reason", F.when(is_binary(F.col("content"), F.col("size")), "binary_file"))
    text = source_text(F.col("content"))
    accepted = kept.where("reason is null").select("path", "name", "size", "modified", text.alias("content"), X.sha256(text).alias("content_hash"), X.language_of("path").alias("language")).orderBy("path")
    return accepted, judged.where("reason is not null").select("path", "reason").unionByName(kept.where("reason is not null").select("path", "reason"))


# -- documents and tables --

MAX_JSON_BYTES = 25 << 20


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document in a file of bounded size, read strictly by a schema."""
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or size[0] > MAX_JSON_BYTES:
        raise BoundExceeded(f"{path}: not a file of at most {MAX_JSON_BYTES} bytes")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def lookup(table: DataFrame, columns: list[str], order: list[str] | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Equality scan with projection, order and limit; a value of None asks for null. Filters and columns reach the file scan."""
    for name, value in equal.items():
        table = table.where(F.col(name).isNull() if value is None else F.col(name) == value)
    table = table.select(*columns)
    table = table.orderBy(*order) if order else table
    return table if limit is None else table.limit(limit)


def members(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the ids, however many there are."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def latest(table: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, by one aggregation with partial results."""
    rest = [c for c in table.columns if c not in key]
    return table.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def union_sources(*pages: DataFrame, valid: Column | None = None) -> DataFrame:
    """Pages of listings as one table without malformed rows."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)
    return out if valid is None else out.where(valid)
