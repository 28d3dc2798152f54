"""The architecture report over the graphs: languages, entry points, hubs, risks, diagrams, overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as X
from siltwork.operators import graphs as G

DIAGRAM_NODES, DIAGRAM_EDGES, ENTRY_POINTS, HUBS = 100, 200, 25, 10

# The risks of a report.
RISKS = [
    ("UNRESOLVED_IMPORTS", "warning", "Some repository-relative imports could not be resolved."),
    ("IMPORT_CYCLES", "warning", "Circular file dependencies were detected."),
    ("AMBIGUOUS_REFERENCES", "warning", "Some identifier references match more than one definition."),
    ("INCOMPLETE_APPLICATION_FLOWS", "info", "Some discovered route flows stop before reaching a model."),
    ("TRUNCATED_FLOW_ENUMERATION", "info", "Application-flow path enumeration reached its safety limit."),
    ("TRUNCATED_DIAGRAMS", "info", "One or more diagrams were reduced to their configured display limits."),
]
# The styles of layers in a diagram.
STYLES = {
    "route": "fill:#e9f7c9,stroke:#4d7c0f,color:#17210b", "controller": "fill:#dbeafe,stroke:#2563eb,color:#172554",
    "service": "fill:#fef3c7,stroke:#d97706,color:#451a03", "model": "fill:#f3e8ff,stroke:#9333ea,color:#3b0764",
}


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def entry_points(nodes: DataFrame, n: int = ENTRY_POINTS) -> DataFrame:
    return nodes.where("layer = 'route'").orderBy("path", "start_line", "name").limit(n).select("name", "path", F.col("start_line").alias("line"))


def hubs(nodes: DataFrame, n: int = HUBS, columns: tuple[str, str] = ("imports", "imported_by"), key: str = "path") -> DataFrame:
    """The most depended-on nodes that have any edge."""
    out, into = columns
    return nodes.where((F.col(out) > 0) | (F.col(into) > 0)).orderBy(F.desc(into), F.desc(out), key).limit(n)


def risks(counts: DataFrame) -> DataFrame:
    """code, severity, message, count of the risks with a count. counts: one row with a column per code."""
    rows = [F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(message).alias("message"), F.col(code).cast("long").alias("count")) for code, level, message in RISKS if code in counts.columns]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("count > 0")


def _numbered(nodes: DataFrame, order: list, prefix: str) -> DataFrame:
    """Nodes with ids by order: they are at most a diagram's number."""
    from pyspark.sql import Window

    return nodes.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("label_id", F.concat(F.lit(prefix), F.col("pos").cast("string")))


def _lines(nodes: DataFrame, edges: DataFrame) -> str:
    rows = nodes.select(F.lit(0).alias("part"), "pos", "line").unionByName(edges.select(F.lit(1).alias("part"), "pos", "line")).orderBy("part", "pos").collect()
    return "\n".join(r["line"] for r in rows)


def import_diagram(nodes: DataFrame, edges: DataFrame, max_nodes: int = DIAGRAM_NODES, max_edges: int = DIAGRAM_EDGES) -> dict:
    """The diagram's text, its numbers of nodes and edges, and whether anything was left out. Bounded by the display limits."""
    top = nodes.orderBy(F.desc("imported_by"), F.desc("imports"), "path").limit(max_nodes)
    named = _numbered(top, ["path"], "F")
    inner = G.induced(edges, top).orderBy("source", "target", "specifier").limit(max_edges)
    a, b = named.select(F.col("path").alias("source"), F.col("label_id").alias("a")), named.select(F.col("path").alias("target"), F.col("label_id").alias("b"))
    shown = _numbered(inner.join(F.broadcast(a), "source").join(F.broadcast(b), "target"), ["source", "target", "specifier"], "E").withColumn("line", F.concat(F.lit("  "), "a", F.lit(" --> "), "b"))
    boxes = named.withColumn("line", F.concat(F.lit("  "), "label_id", F.lit('["'), X.diagram_label("path"), F.lit('"]')))
    n, m = top.count(), inner.count()
    body = _lines(boxes, shown) if n else '  EMPTY["No indexed source files"]'
    return {"mermaid": "flowchart LR\n" + body, "nodes": n, "edges": m, "truncated": n < nodes.count() or m < edges.count()}


def flow_diagram(nodes: DataFrame, edges: DataFrame, max_nodes: int = DIAGRAM_NODES, max_edges: int = DIAGRAM_EDGES) -> dict:
    order = [X.layer_order("layer"), F.col("path"), F.col("start_line"), F.col("name"), F.col("id")]
    top = nodes.orderBy(*order).limit(max_nodes)
    named = _numbered(top, order, "A")
    inner = G.induced(edges, top, "id").orderBy("source", "target", "reference").limit(max_edges)
    a, b = named.select(F.col("id").alias("source"), F.col("label_id").alias("a")), named.select(F.col("id").alias("target"), F.col("label_id").alias("b"))
    arrow = F.when(F.col("ambiguous"), "-.->").otherwise("-->")
    shown = _numbered(inner.join(F.broadcast(a), "source").join(F.broadcast(b), "target"), ["source", "target", "reference"], "E")
    shown = shown.withColumn("line", F.concat(F.lit("  "), "a", F.lit(" "), arrow, F.lit('|"'), X.diagram_label("reference"), F.lit('"| '), "b"))
    label = F.concat(X.diagram_label("layer"), F.lit(": "), X.diagram_label("name"), F.lit("<br/>"), X.diagram_label("path"), F.lit(":"), F.col("start_line").cast("string"))
    boxes = named.withColumn("line", F.concat(F.lit("  "), "label_id", F.lit('["'), label, F.lit('"]')))
    n, m = top.count(), inner.count()
    if not n:
        body = '  EMPTY["No application flow discovered"]'
    else:
        kinds = [f"  class {r['label_id']} {r['layer']}" for r in named.orderBy("pos").select("label_id", "layer").collect()]
        body = "\n".join([_lines(boxes, shown), *kinds, *[f"  classDef {k} {v}" for k, v in STYLES.items()]])
    return {"mermaid": "flowchart LR\n" + body, "nodes": n, "edges": m, "truncated": n < nodes.count() or m < edges.count()}


def architecture(files: DataFrame, symbols: DataFrame) -> dict:
    """The whole report of one snapshot: files(id, path, language, imports), symbols(id, file_id, ...)."""
    imports, used, flow = G.import_graph(files.drop("id")), G.symbol_graph(files, symbols), G.flow_graph(files, symbols)
    flows, complete = flow["flows"].limit(G.MAX_FLOWS + 1).agg(F.count("*"), F.count_if("complete")).first()
    imports_diagram, flow_picture = import_diagram(imports["nodes"], imports["edges"]), flow_diagram(flow["nodes"], flow["edges"])
    by_layer = {r["layer"]: r["n"] for r in flow["nodes"].groupBy("layer").agg(F.count("*").alias("n")).collect()}
    f, s = imports["stats"].first(), used["stats"].first()
    cycles, ambiguous = imports["cycles"].count(), flow["edges"].where("ambiguous").select("source", "reference").distinct().count()
    by_language = [r.asDict() for r in languages(imports["nodes"]).collect()]
    counts = files.sparkSession.createDataFrame(
        [(imports["unresolved"].count(), cycles, max(s["ambiguous_references"], ambiguous), flows - complete, int(flows > G.MAX_FLOWS), int(imports_diagram["truncated"]) + int(flow_picture["truncated"]))],
        ", ".join(f"{code} long" for code, _, _ in RISKS),
    )
    n_symbols = symbols.count()
    # Fixed wording.
    overview = (
        f"This indexed commit contains {f['files']} files and {n_symbols} symbols across {len(by_language)} languages. "
        f"It exposes {by_layer.get('route', 0)} route entry points, with {complete} complete route-to-model flows."
    )
    metrics = {"files": f["files"], "languages": len(by_language), "internal_imports": f["internal_imports"] or 0, "import_cycles": cycles, "symbols": n_symbols, "resolved_references": s["resolved_references"], **{f"{k}s": by_layer.get(k, 0) for k in X.LAYERS}, "complete_flows": complete, "incomplete_flows": flows - complete}
    return {
        "overview": overview, "metrics": metrics, "languages": by_language, "entry_points": [r.asDict() for r in entry_points(flow["nodes"]).collect()],
        "hubs": [r.asDict() for r in hubs(imports["nodes"]).collect()], "risks": [r.asDict() for r in risks(counts).collect()], "diagrams": {"imports": imports_diagram, "flow": flow_picture},
    }
