"""Scalar functions as Column expressions: text, paths, classification, formats, rates. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# File extension -> language.
LANGUAGES = {
    ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".json": "json", ".md": "markdown", ".css": "css", ".scss": "scss", ".html": "html",
}
# Extensions that an import without one may stand for, in order of preference.
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".json"]
# Extensions of compiled JavaScript, and what each may have been compiled from.
EMITTED_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs"]
COMPILED_FROM = [".ts", ".tsx", ".mts", ".cts"]
# The order of layers in a flow.
LAYERS = ["route", "controller", "service", "model"]
# Fixed pattern: the white space of the text standard that answers are compared by.
BLANKS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: ColumnLike) -> Column:
    return F.regexp_replace(_c(c), f"^{BLANKS}+|{BLANKS}+$", "")


def utf16_length(c: ColumnLike) -> Column:
    """Length in UTF-16 units: caps and budgets count these."""
    return (F.octet_length(F.encode(_c(c), "UTF-16BE")) / 2).cast("long")


def utf16_prefix(c: ColumnLike, units: Column) -> Column:
    """The first ``units`` UTF-16 units; a surrogate pair that would be cut is left out."""
    c = _c(c)
    raw = F.encode(c, "UTF-16BE")
    split = F.hex(F.substring(raw, (units * 2 - 1).cast("int"), F.lit(2))).rlike("^D[89AB]")
    cut = F.decode(F.substring(raw, F.lit(1), (F.when(split, units - 1).otherwise(units) * 2).cast("int")), "UTF-16BE")
    return F.when(utf16_length(c) <= units, c).otherwise(cut)


def sha256(c: ColumnLike) -> Column:
    return F.sha2(_c(c), 256)


def uuid_of(*parts: ColumnLike) -> Column:
    """A UUID (version 8) from the SHA-256 of the parts joined by NUL."""
    h = F.sha2(F.concat_ws("\0", *[_c(p).cast("string") for p in parts]), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def name_of(path: ColumnLike) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension_of(path: ColumnLike) -> Column:
    """The last dot of the last name and what follows, in lower case; '' for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+?(\.[^.]*)$", 1))


def language_of(path: ColumnLike) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension_of(path)), F.lit("unknown"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is named: expressions with lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_path(path: ColumnLike) -> Column:
    """A POSIX path without '.', inner '..' and double slashes."""
    path = _c(path)
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        lost = (x == "..") & (F.size(acc) == 0) & rooted
        return F.when(up, F.slice(acc, 1, F.size(acc) - 1)).when(lost, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return once(F.array_join(kept, "/"), lambda joined: F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined))


def directory_of(path: ColumnLike) -> Column:
    path = _c(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def join_path(a: ColumnLike, b: ColumnLike) -> Column:
    return normalize_path(F.concat(_c(a), F.lit("/"), _c(b)))


def canonical_path(path: ColumnLike) -> Column:
    """A repository path with forward slashes, normalised; null if it is absolute, leaves the root or is unsafe."""
    empty = (trimmed(path) == "") | _c(path).contains("\0")
    bad = lambda clean: empty | clean.startswith("/") | clean.rlike(r"^\.\.(/|$)|^[A-Za-z]:") | (clean == ".")
    return once(normalize_path(F.replace(trimmed(path), F.lit("\\"), F.lit("/"))), lambda clean: F.when(~bad(clean), clean))


def inside(root: str, path: ColumnLike) -> Column:
    """True if the path stays at or below the root once normalised."""
    clean, root = normalize_path(path), root.rstrip("/")
    return (clean == root) | clean.startswith(root + "/")


def internal_specifier(s: ColumnLike) -> Column:
    """An import of a file of the same repository, without its query; null for packages and bindings."""
    s = trimmed(s)
    ok = s.rlike(r"^\.\.?/") & (utf16_length(s) <= 2048) & ~s.contains("\0")
    return F.when(ok, F.nullif(F.regexp_replace(s, r"(?s)[?#].*$", ""), F.lit("")))


def import_candidates(source: ColumnLike, specifier: ColumnLike) -> Column:
    """The paths that an import may mean, in order of preference; empty if it leaves the repository."""
    return once(join_path(directory_of(source), specifier), _candidates)


def _candidates(base: Column) -> Column:
    extension = extension_of(base)
    stem = F.left(base, F.length(base) - F.length(extension))
    compiled = F.concat(F.array(base), F.array(*[F.concat(stem, F.lit(e)) for e in COMPILED_FROM]))
    bare = F.array(base, *[F.concat(base, F.lit(e)) for e in SOURCE_EXTENSIONS], *[F.concat(base, F.lit(f"/index{e}")) for e in SOURCE_EXTENSIONS])
    found = F.when(extension == "", bare).when(extension.isin(EMITTED_EXTENSIONS), compiled).otherwise(F.array(base))
    return F.when(base.rlike(r"^\.\.(/|$)|^/"), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


# Fixed patterns: a path's layer, in order.
PATH_LAYERS = [
    ("controller", r"(?:^|/)controllers?(?:/|$)|(?:^|[.-])controller(?:[.-]|$)"),
    ("service", r"(?:^|/)services?(?:/|$)|(?:^|[.-])service(?:[.-]|$)"),
    ("model", r"(?:^|/)models?(?:/|$)|(?:^|[.-])(?:model|schema)(?:[.-]|$)"),
]


def path_layer(path: ColumnLike) -> Column:
    clean = F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/")))
    return F.coalesce(*[F.when(clean.rlike(p), layer) for layer, p in PATH_LAYERS])


def symbol_layer(kind: ColumnLike, path: ColumnLike) -> Column:
    kind = _c(kind)
    return F.when(kind == "express_route", "route").when(kind.isin("controller", "service", "model"), kind).otherwise(path_layer(path))


def layer_order(layer: ColumnLike) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), _c(layer))


# Fixed patterns: a question's class, in order, on the text in lower case.
_QUESTION_CLASSES = [
    ("architecture", r"\b(architecture|end[- ]to[- ]end|complete (?:request )?flow|overall design)\b"),
    ("dependency", r"\b(dependency|dependencies|depends on|imports?|requires?)\b"),
    ("api_flow", r"\b(route|endpoint|request flow|api flow|middleware|controller)\b"),
    ("database", r"\b(database|schema|model|mongodb|mongoose|sql|query)\b"),
    ("configuration", r"\b(config|configuration|environment|env var|setting)\b"),
    ("usage", r"\b(usage|how (?:do|can|should) i use|example)\b"),
]
_FILE_PATTERN = r"""(?i)(?:^|[\s`'"(])(?:[\w.-]+/)+[\w.-]+\.[a-z0-9]+(?=$|[\s`'"),?!])"""
_QUOTED_PATTERN = r"`([A-Za-z_$][\w$]*)`"
_INTENT_PATTERN = r"""(?i)(?:where\s+is|find|used?|defined?|references?|calls?)\s+[`'"]*([A-Za-z_$][\w$]*(?:\(\))?)"""
_CODE_LIKE = r"[A-Z_$]|[a-z][A-Z]|\(\)$"


def exact_symbol(question: ColumnLike) -> Column:
    """The symbol that a question names: in back-ticks, or a code-like word after a word of intent; null if none."""
    q = _c(question)
    quoted = F.nullif(F.regexp_extract(q, _QUOTED_PATTERN, 1), F.lit(""))
    meant = F.nullif(F.regexp_extract(q, _INTENT_PATTERN, 1), F.lit(""))
    return F.coalesce(quoted, F.when(meant.rlike(_CODE_LIKE), F.regexp_replace(meant, r"\(\)$", "")))


def question_class(question: ColumnLike) -> Column:
    q = _c(question)
    low = F.lower(trimmed(q))
    found = F.when(q.rlike(_FILE_PATTERN), "file_specific").when(exact_symbol(q).isNotNull(), "exact_symbol")
    return reduce(lambda acc, x: acc.when(low.rlike(x[1]), x[0]), _QUESTION_CLASSES, found).otherwise("semantic")


def single_line(c: ColumnLike) -> Column:
    return trimmed(F.regexp_replace(_c(c), r"[\r\n\t]+", " "))


def listed(values: ColumnLike) -> Column:
    values = F.coalesce(_c(values), F.array().cast("array<string>"))
    return F.when(F.size(values) == 0, "(none)").otherwise(F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), single_line(v))), "\n"))


def embedding_text(
    repository: ColumnLike, branch: ColumnLike, commit: ColumnLike, path: ColumnLike, language: ColumnLike, start: ColumnLike, end: ColumnLike, imports: ColumnLike, exports: ColumnLike, content: ColumnLike,
    symbol_type: ColumnLike | None = None, symbol_name: ColumnLike | None = None, references: ColumnLike | None = None, label: ColumnLike | None = None,
) -> Column:
    """The text of a chunk that is embedded: a header of its place and lists, then its content."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), single_line(c))
    maybe = lambda name, c: [F.when(_c(c).isNotNull(), line(name, c))] if c is not None else []
    shown = F.coalesce(_c(label), _c(repository)) if label is not None else _c(repository)
    own = [F.when(single_line(shown) != single_line(repository), line("Repository ID", repository))] if label is not None else []
    refs = [F.when(_c(references).isNotNull(), F.concat(F.lit("\nReferences:\n"), listed(references)))] if references is not None else []
    return F.concat_ws(
        "\n", line("Repository", shown), *own, line("Branch", branch), line("Commit", commit), line("File", path), line("Language", language), *maybe("Symbol type", symbol_type), *maybe("Symbol name", symbol_name),
        F.concat(F.lit("Lines: "), _c(start).cast("string"), F.lit("-"), _c(end).cast("string")), F.lit("\nImports:"), listed(imports), F.lit("\nExports:"), listed(exports), *refs, F.lit("\nCode:"), _c(content),
    )


def with_task(text: ColumnLike, task: str) -> Column:
    """The prefix that asymmetric embedding models expect before documents and queries."""
    return F.concat(F.lit({"document": "title: repository code | text: ", "query": "task: code retrieval | query: "}[task]), _c(text))


def citation(path: ColumnLike, start: ColumnLike, end: ColumnLike) -> Column:
    clean = _c(path)
    for a, b in (("[", "%5B"), ("]", "%5D"), ("\r", "%0D"), ("\n", "%0A")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    return F.concat(F.lit("["), clean, F.lit(":L"), _c(start).cast("string"), F.lit("-L"), _c(end).cast("string"), F.lit("]"))


def diagram_label(c: ColumnLike, longest: int = 180) -> Column:
    """A one-line label of bounded length, escaped for diagrams."""
    flat = trimmed(F.regexp_replace(F.regexp_replace(_c(c), r"[\x00-\x1f\x7f]", " "), f"{BLANKS}+", " "))
    flat = utf16_prefix(flat, F.lit(longest))
    out = F.when(flat == "", "Unnamed").otherwise(flat)
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("`", "&#96;"), ("{", "&#123;"), ("}", "&#125;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def answer_text(c: ColumnLike) -> Column:
    """An answer as it is compared: lower case, white space collapsed, trimmed."""
    return trimmed(F.regexp_replace(F.lower(_c(c)), f"{BLANKS}+", " "))


def ratio(a: ColumnLike, b: ColumnLike, empty: float = 0.0) -> Column:
    return F.when(_c(b) == 0, F.lit(empty)).otherwise(_c(a).cast("double") / _c(b))


def clamp(c: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(c)))


def f1(precision: ColumnLike, recall: ColumnLike) -> Column:
    p, r = _c(precision), _c(recall)
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def price(tokens: ColumnLike, usd_per_million: ColumnLike) -> Column:
    """Null if there is no price."""
    return F.coalesce(_c(tokens), F.lit(0)) / 1_000_000 * _c(usd_per_million)


def status_class(code: ColumnLike) -> Column:
    return F.concat(F.floor(_c(code) / 100).cast("string"), F.lit("xx"))


def finite_duration(c: ColumnLike) -> Column:
    c = _c(c)
    return F.when(c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf")), 0.0).otherwise(c)


def finite_vector(v: ColumnLike, size: int) -> Column:
    return (F.size(_c(v)) == size) & F.forall(_c(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: ColumnLike) -> Column:
    return F.sqrt(dot(v, v))


def repository_url(url: ColumnLike) -> Column:
    """struct(owner, name, full_name, url) of an https repository address; null if it is not one."""
    u = trimmed(url)
    shape = r"^(?i)https://(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?$"
    owner, name = F.regexp_extract(u, shape, 1), F.regexp_extract(u, shape, 2)
    ok = (owner != "") & (name != "") & ~name.isin(".", "..")
    return F.when(ok, F.struct(owner.alias("owner"), name.alias("name"), F.concat(owner, F.lit("/"), name).alias("full_name"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")).alias("url")))


def valid_branch(b: ColumnLike) -> Column:
    """The rules of git for a branch name."""
    b = _c(b)
    bad = r"(?s)^$|^@$|^-|^/|/$|\.$|(?i:\.lock)(/|$)|//|\.\.|@\{|(^|/)\.|[\x00-\x20\x7f~^:?*\[\\]"
    return b.isNotNull() & ~b.rlike(bad) & (F.length(b) <= 255)
