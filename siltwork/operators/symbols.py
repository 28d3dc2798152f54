"""Symbols of JavaScript and TypeScript sources by a tokenizer and brace matching, behind a replaceable parser.

A grammar is more exact: generics with unusual nesting and regular expressions after a closing bracket may
be misread here. Sources whose brackets do not balance fall back to line windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.operators import chunks as K

# Route methods, and the names of what they are called on.
ROUTE_METHODS = ["all", "delete", "get", "head", "options", "patch", "post", "put", "route", "trace", "use"]
_RECEIVER = re.compile(r"(?:app|api|router|server)$", re.I)
MAX_TOKENS, MAX_REFERENCES = 250_000, 500
LANGUAGES = ["javascript", "jsx", "typescript", "tsx"]
SCHEMA = "path string, strategy string, imports array<string>, exports array<string>, symbols array<struct<type:string,name:string,start_line:int,end_line:int,exported:boolean,references:array<string>>>"

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<mark>[^\w\s])",
    re.S,
)
_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of from as interface type enum implements public private protected readonly abstract declare namespace null true false undefined".split())


@dataclass
class Symbol:
    type: str
    name: str
    start: int
    end: int
    exported: bool = False
    references: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    strategy: str
    imports: list[str] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)


def role(kind: str, name: str, path: str) -> str:
    """A component, else the role of the path, else of the name, else the plain kind."""
    low = path.replace("\\", "/").lower()
    if kind in ("function", "variable_function") and name[:1].isupper() and low.endswith((".tsx", ".jsx")):
        return "react_component"
    for layer, pattern in X.PATH_LAYERS:
        if kind not in ("interface", "type", "enum") and (re.search(pattern, low) or layer == "model" and re.search(r"schema\.[jt]s$", low)):
            return layer
    for layer in ("Controller", "Service", "Model"):
        if name.endswith(layer):
            return layer.lower()
    return {"variable_function": "function"}.get(kind, kind)


def parse(source: str, path: str) -> Parsed:
    """Symbols, imports and exports of one source."""
    tokens, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0], line))
            if len(tokens) > MAX_TOKENS:
                return Parsed("line_fallback")
    closes, stack, pairs = {")": "(", "]": "[", "}": "{"}, [], {}
    for i, (kind, t, _) in enumerate(tokens):
        if kind == "mark" and t in "([{":
            stack.append(i)
        elif kind == "mark" and t in ")]}":
            if not stack or tokens[stack[-1]][1] != closes[t]:
                return Parsed("line_fallback")
            pairs[stack.pop()] = i
    if stack:
        return Parsed("line_fallback")
    out = Parsed("parsed")
    word = lambda i: tokens[i][1] if 0 <= i < len(tokens) else ""
    unquote = lambda s: s[1:-1] if s[:1] in "\"'`" else s

    def body_end(i: int) -> int:
        """The last token of a declaration from token i: its first block at depth 0, else up to ';' or the end of the line."""
        k = i
        while k < len(tokens):
            t = word(k)
            if k in pairs:
                if t == "{":
                    return pairs[k]
                k = pairs[k]
            elif t == ";":
                return k
            k += 1
        return len(tokens) - 1

    def statement_end(i: int) -> int:
        k, last = i, i
        while k < len(tokens):
            t = word(k)
            if t == ";":
                return k
            if k > i and tokens[k][2] > tokens[last][2] and word(last) not in ("=", "=>", ",", "(", "{", "[", "+", "?", ":", "|", "&", "<", ".") and t not in (".", "?", ":", "=", "=>", "|", "&", ")", ">", "+"):
                return last
            k = pairs.get(k, k)
            last = k
            k += 1
        return len(tokens) - 1

    def add(kind: str, name: str, a: int, b: int, start: int, exported: bool) -> None:
        seen, refs = {name}, []
        for k in range(a, b + 1):
            if tokens[k][0] == "name" and word(k) not in _WORDS and word(k) not in seen:
                seen.add(word(k))
                refs.append(word(k))
        out.symbols.append(Symbol(role(kind, name, path), name, tokens[start][2], tokens[b][2] + tokens[b][1].count("\n"), exported, refs[:MAX_REFERENCES]))

    depth_end: list[tuple[int, str]] = []
    i = 0
    while i < len(tokens):
        while depth_end and depth_end[-1][0] < i:
            depth_end.pop()
        top = not depth_end
        kind, t, _ = tokens[i]
        start = i
        if kind == "name" and t == "import" and top and word(i + 1) != "(":
            k = i + 1
            while k < len(tokens) and tokens[k][0] != "string" and word(k) != ";":
                if tokens[k][0] == "name" and word(k) not in ("from", "as", "type"):
                    out.imports.append(word(k))
                k += 1
            if k < len(tokens) and tokens[k][0] == "string":
                out.imports.append(unquote(word(k)))
            i = k + 1
            continue
        if kind == "name" and t == "require" and word(i + 1) == "(" and i + 2 < len(tokens) and tokens[i + 2][0] == "string":
            if word(i - 1) == "=" and tokens[i - 2][0] == "name":
                out.imports.append(word(i - 2))
            out.imports.append(unquote(word(i + 2)))
        exported = False
        if kind == "name" and t == "export" and top:
            exported = True
            i += 1
            if word(i) == "default":
                out.exports.append("default")
                i += 1
            elif word(i) == "{":
                names = [word(k) for k in range(i + 1, pairs[i]) if tokens[k][0] == "name" and word(k + 1) != "as" and word(k) not in ("as", "type")]
                out.exports += names
                i = pairs[i] + 1
                continue
        while word(i) in ("async", "declare", "abstract") and tokens[i][0] == "name" and i + 1 < len(tokens) and (tokens[i + 1][0] == "name"):
            i += 1
        t = word(i)
        nested_ok = top or depth_end[-1][1] == "class"
        if tokens[min(i, len(tokens) - 1)][0] == "name" and t == "function" and nested_ok:
            k = i + 1 + (word(i + 1) == "*")
            if k < len(tokens) and tokens[k][0] == "name":
                end = body_end(k)
                add("function", word(k), k, end, start, exported)
                if exported:
                    out.exports.append(word(k))
                depth_end.append((end, "body"))
                i = k + 1
                continue
        elif t in ("class", "interface", "enum") and top and i + 1 < len(tokens) and tokens[i + 1][0] == "name":
            end = body_end(i + 1)
            add(t, word(i + 1), i + 1, end, start, exported)
            if exported:
                out.exports.append(word(i + 1))
            depth_end.append((end, "class" if t == "class" else "body"))
            while i < end and word(i) != "{":
                i += 1
            i += 1
            continue
        elif t == "type" and top and i + 2 < len(tokens) and tokens[i + 1][0] == "name" and word(i + 2) in ("=", "<"):
            end = statement_end(i)
            add("type", word(i + 1), i + 1, end, start, exported)
            if exported:
                out.exports.append(word(i + 1))
            i = end + 1
            continue
        elif t in ("const", "let", "var") and top and i + 1 < len(tokens) and tokens[i + 1][0] == "name":
            name, end = word(i + 1), statement_end(i)
            text = [word(k) for k in range(i + 2, min(end + 1, i + 60))]
            callable_ = "=>" in text or "function" in text[:4]
            model = any(x in ("Schema", "model") for x in text[:8])
            add("variable_function" if callable_ else "model" if model else "variable", name, i + 1, end, start, exported)
            if exported:
                out.exports.append(name)
            for k in range(i, end):  # bound requires inside the statement
                if word(k) == "require" and word(k + 1) == "(" and tokens[k + 2][0] == "string":
                    out.imports += [name, unquote(word(k + 2))]
            depth_end.append((end, "body"))
            i += 2
            continue
        elif not top and depth_end[-1][1] == "class" and tokens[i][0] == "name" and t not in ("return", "new") and (i + 1) in pairs and word(i + 1) == "(":
            k = pairs[i + 1] + 1
            while k < depth_end[-1][0] and word(k) not in ("{", ";"):
                k = pairs.get(k, k) + 1
            if word(k) == "{" and k in pairs:
                add("method", t, i, pairs[k], start, False)
                depth_end.append((pairs[k], "body"))
                i += 1
                continue
        elif not top and depth_end[-1][1] == "class" and i not in pairs and tokens[i][0] == "name" and word(i + 1) == "=":
            end = statement_end(i)
            if "=>" in [word(k) for k in range(i, min(end, i + 40))]:
                add("method", t, i, end, start, False)
                depth_end.append((end, "body"))
        if tokens[min(i, len(tokens) - 1)][0] == "name" and word(i + 1) == "." and word(i + 2) in ROUTE_METHODS and word(i + 3) == "(" and _RECEIVER.search(word(i)) and i + 4 < len(tokens) and tokens[i + 4][0] == "string":
            add("express_route", f"{word(i + 2).upper()} {unquote(word(i + 4))}", i + 4, pairs[i + 3], start, False)
            out.symbols[-1].type = "express_route"
        i += 1
    out.imports, out.exports = list(dict.fromkeys(out.imports)), list(dict.fromkeys(out.exports))
    unique = {(s.start, s.end, s.type, s.name): s for s in reversed(out.symbols)}
    out.symbols = [unique[k] for k in sorted(unique)]
    return out


def extract(files: DataFrame, parser: Callable[[str, str], Parsed] = parse) -> DataFrame:
    """path, strategy, imports, exports, symbols of files(path, language, content); sources of other languages have the strategy ``line``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                p = parser(content or "", path) if language in LANGUAGES else Parsed("line")
                symbols = [{"type": s.type, "name": s.name, "start_line": s.start, "end_line": s.end, "exported": s.exported, "references": s.references} for s in p.symbols]
                rows.append((path, p.strategy, p.imports, p.exports, symbols))
            yield pd.DataFrame(rows, columns=["path", "strategy", "imports", "exports", "symbols"])

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def symbol_chunks(files: DataFrame, parsed: DataFrame, size: int = K.SIZE, overlap: int = K.OVERLAP) -> DataFrame:
    """Line windows of each symbol; of the whole file where it has none. Exports of a symbol's chunk: its own name or default."""
    both = files.join(parsed, "path")
    whole = both.where(F.size("symbols") == 0).select("path", "strategy", "imports", "exports", F.lit(None).cast("string").alias("symbol_type"), F.lit(None).cast("string").alias("symbol_name"), F.lit(1).alias("first"), F.array().cast("array<string>").alias("references"), "content")
    s = both.where(F.size("symbols") > 0).select("path", "strategy", "imports", "exports", F.explode("symbols").alias("s"), K.lines_of(F.col("content")).alias("lines"))
    own = F.when(F.col("s.exported"), F.filter("exports", lambda e: (e == F.col("s.name")) | (e == "default"))).otherwise(F.array().cast("array<string>"))
    part = F.array_join(F.slice("lines", F.col("s.start_line"), F.col("s.end_line") - F.col("s.start_line") + 1), "\n")
    named = s.select("path", "strategy", "imports", own.alias("exports"), F.col("s.type").alias("symbol_type"), F.col("s.name").alias("symbol_name"), F.col("s.start_line").alias("first"), F.col("s.references").alias("references"), part.alias("content"))
    cut = K.windows(whole.unionByName(named).withColumn("base", F.col("first")), size=size, overlap=overlap, first_line=F.col("first")).drop("first", "base")
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("start_line", "end_line", "symbol_type", "symbol_name")
    return cut.withColumn("chunk_index", F.row_number().over(order) - 1)
