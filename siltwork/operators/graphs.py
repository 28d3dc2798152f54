"""Graphs of imports, symbols and layered flows; components, bounded traversal, related files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions import text as X
from siltwork.functions.checks import InvalidRows, Limits, at_most, unique
from siltwork.sources.session import shared_folder

# Limits of graphs, and kinds of symbols that a route can call.
MAX_FILES, MAX_IMPORTS, MAX_SYMBOLS, MAX_REFERENCES, MAX_EDGES, MAX_FLOWS = 5_000, 50_000, 10_000, 100_000, 50_000, 1_000
CALLABLE = ["function", "arrow_function", "method", "controller"]
#: Steps that labels spread between two checkpoints.
STEPS = 6
#: Edges, of those that a round of components leaves, that one task takes.
FEW = 1 << 16


def resolve_imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(source, target, specifier), unresolved(source, specifier)) of files(path, imports): each specifier means the
    first of its candidates that exists; of several specifiers for one edge the first one written stays."""
    named = unique(files.select(X.canonical_path("path").alias("path"), "imports"), "path")
    spec = named.select(F.col("path").alias("source"), F.posexplode("imports").alias("pos", "raw")).withColumn("specifier", X.internal_specifier("raw")).where("specifier is not null")
    first = spec.groupBy("source", "specifier").agg(F.min("pos").alias("pos"))
    options = first.select("source", "specifier", "pos", F.posexplode(X.import_candidates("source", "specifier")).alias("priority", "target"))
    found = options.join(named.select(F.col("path").alias("target")), "target").groupBy("source", "specifier", "pos").agg(F.min_by("target", "priority").alias("target"))
    edges = found.groupBy("source", "target").agg(F.min_by("specifier", "pos").alias("specifier"))
    return edges, first.join(found, ["source", "specifier"], "left_anti").select("source", "specifier")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """The nodes with ``outgoing`` and ``incoming``, 0 where there is no edge: one aggregation over both ends."""
    ends = edges.select(F.col(source).alias(key), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(target).alias(key), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy(key).agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return nodes.join(n, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("outgoing", "incoming")})


def strongly_connected(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """component, node of the components with more than one node or a self loop; component: the least node.

    Rounds of colouring: labels of the least node that reaches a node, and of the least that it reaches, spread along the
    edges, both ways at once and ``STEPS`` steps between checkpoints. Nodes with equal labels both ways form a component and leave; of the other edges
    those stay whose ends have the same two labels, as the nodes of one component have. Edges that lead out of what is left
    are pruned as long as many do. What rounds leave, once it is ``FEW`` edges at most, is one task's work, since a round of few
    edges takes as long as one of many. Every other step is distributed; its joins are sorted and not broadcast, and what changed is
    counted by the job that changes it, so that the driver gets numbers alone."""
    shared_folder(edges.sparkSession)
    edges = edges.select("source", "target").distinct().checkpoint()
    loops = edges.where("source = target").select(F.col("source").alias("component"), F.col("source").alias("node"))
    live, n = _counted(edges.where("source != target"), F.lit(True))
    done, out = [], T.StructType([T.StructField(c, edges.schema["source"].dataType) for c in ("component", "node")])
    for _ in range(most_rounds):
        while n:
            # A node on a cycle has an edge in and an edge out.
            ends = live.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(live.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
            both = ends.groupBy("node").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 AND i = 1").select("node").hint("merge")
            before = n
            live, n = _counted(live.join(both.withColumnRenamed("node", "source"), "source", "left_semi").join(both.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target"), F.lit(True))
            if n > 0.9 * before:
                break
        if not n:
            break
        if done and n <= FEW:
            done.append(live.coalesce(1).mapInPandas(_components, out))
            break
        labels = _spread(live)
        done.append(labels.where("ahead = back").select(F.col("ahead").alias("component"), "node"))
        left = labels.where("ahead != back").select("node", F.struct("ahead", "back").alias("own"))
        end = lambda c: left.select(F.col("node").alias(c), F.col("own").alias(f"{c}_own")).hint("merge")
        live, n = _counted(live.join(end("source"), "source").join(end("target"), "target").where("source_own = target_own").select("source", "target"), F.lit(True))
    else:
        raise RuntimeError("components did not settle")
    found = reduce(DataFrame.unionByName, done) if done else loops.limit(0)
    # Of a large component one row, that of its least node, looks for another member or a loop.
    more = found.where("component != node")
    known = more.select("component").unionByName(loops.select("component")).distinct().hint("merge")
    heads = found.where("component = node").unionByName(loops.join(found.select("node").hint("merge"), "node", "left_anti").select("component", "node"))
    return more.unionByName(heads.join(known, "component", "left_semi").select("component", "node"))


def _components(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """component, node for the edges of one task, by the same rounds."""
    edges = pd.concat(parts, ignore_index=True)
    names, ends = np.unique(edges[["source", "target"]].to_numpy().ravel(), return_inverse=True)
    source, target = ends.reshape(-1, 2).T
    while len(source):
        labels = []
        for a, b in ((source, target), (target, source)):
            label, old = np.arange(len(names)), None
            while old is None or (label != old).any():
                old = label.copy()
                np.minimum.at(label, b, old[a])
            labels.append(label)
        node = np.unique(np.r_[source, target])
        found = node[labels[0][node] == labels[1][node]]
        yield pd.DataFrame({"component": names[labels[0][found]], "node": names[found]})
        left = (labels[0][source] != labels[1][source]) & (labels[0][source] == labels[0][target]) & (labels[1][source] == labels[1][target])
        source, target = source[left], target[left]


def _counted(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """The checkpointed rows, and for how many of them ``what`` holds; counted by the job that writes them."""
    seen = Observation()
    out = df.observe(seen, F.count_if(what).alias("n")).checkpoint()
    return out, seen.get["n"]


def _spread(edges: DataFrame) -> DataFrame:
    """node, ahead, back: the least node that reaches each node, and the least that it reaches.

    Every node also tells itself, so a step is one join and one aggregation by the node, and the next step's join finds its
    labels where they are; the edges are dealt once for all steps up to a checkpoint."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    ways = [(True, "source", "target"), (False, "target", "source")]
    step = reduce(DataFrame.unionByName, [edges.select(F.lit(way).alias("ahead"), F.col(a).alias("at"), F.col(b).alias("node")) for way, a, b in ways] + [ends.select(F.lit(way).alias("ahead"), F.col("node").alias("at"), "node") for way, _, _ in ways]).checkpoint()
    labels = step.where("at = node").select("ahead", "node", F.col("node").alias("label"))
    more = 1
    while more:
        for _ in range(STEPS):
            told = step.join(labels.select("ahead", F.col("node").alias("at"), "label").hint("merge"), ["ahead", "at"])
            least = told.groupBy("ahead", "node").agg(F.min("label").alias("label"), F.min(F.when(F.col("at") == F.col("node"), F.col("label"))).alias("own"))
            labels = least.select("ahead", "node", "label", (F.col("label") < F.col("own")).alias("moved"))
        labels, more = _counted(labels, F.col("moved"))
    return labels.groupBy("node").agg(F.min(F.when(F.col("ahead"), F.col("label"))).alias("ahead"), F.min(F.when(~F.col("ahead"), F.col("label"))).alias("back")).checkpoint()


def import_graph(files: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, unresolved, cycles and stats of files(path, language, imports) of one snapshot."""
    shared_folder(files.sparkSession)
    limits = Limits()
    files = limits.on(files.select("path", "language", "imports"), files=(F.lit(1), MAX_FILES), imports=(F.greatest(F.coalesce(F.size("imports"), F.lit(0)), F.lit(0)), MAX_IMPORTS)).checkpoint()
    limits.check()
    files = files.withColumn("path", X.canonical_path("path"))
    edges, unresolved = resolve_imports(files)
    edges = limits.on(edges, edges=(F.lit(1), MAX_EDGES)).checkpoint()
    limits.check()
    cycles = strongly_connected(edges)
    cyclic = cycles.select(F.col("node").alias("path"), F.lit(True).alias("in_cycle"))
    nodes = degrees(files.select("path", "language"), edges, "path").join(cyclic, "path", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    nodes = nodes.withColumnsRenamed({"outgoing": "imports", "incoming": "imported_by"})
    groups = cycles.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"))
    stats = nodes.agg(F.count("*").alias("files"), F.sum("imports").alias("internal_imports"), F.count_if("in_cycle").alias("cyclic_files"))
    return {"nodes": nodes, "edges": edges, "unresolved": unresolved, "cycles": groups.select("members"), "stats": stats}


def _checked(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path and language of their file; a symbol without one fails."""
    joined = symbols.join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id", "left")
    if not joined.where("path is null or start_line < 1 or end_line < start_line").isEmpty():
        raise InvalidRows("a symbol without its file, or with odd lines")
    return joined.withColumn("references", F.array_distinct("references"))


def reference_edges(symbols: DataFrame) -> DataFrame:
    """source, target, reference, ambiguous: every definition of each referenced name, self loops too."""
    refs = symbols.select(F.col("id").alias("source"), F.explode(F.array_distinct("references")).alias("reference"))
    defs = symbols.select(F.col("id").alias("target"), F.col("name").alias("reference"))
    n = defs.groupBy("reference").agg(F.count("*").alias("definitions"))
    return refs.join(defs, "reference").join(n, "reference").select("source", "target", "reference", (F.col("definitions") > 1).alias("ambiguous"))


def symbol_graph(files: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and stats of symbols(id, file_id, name, type, start_line, end_line, references)."""
    shared_folder(symbols.sparkSession)
    limits = Limits()
    refs = F.greatest(F.coalesce(F.size("references"), F.lit(0)), F.lit(0))
    symbols = limits.on(symbols, symbols=(F.lit(1), MAX_SYMBOLS), references=(refs, MAX_REFERENCES)).checkpoint()
    limits.check()
    own = _checked(symbols, files)
    edges = limits.on(reference_edges(own), edges=(F.lit(1), MAX_EDGES)).checkpoint()
    limits.check()
    nodes = degrees(own.drop("references"), edges)
    stats = edges.agg(F.count("*").alias("resolved_references"), F.count_distinct(F.when(F.col("ambiguous"), F.struct("source", "reference"))).alias("ambiguous_references"))
    return {"nodes": nodes, "edges": edges, "stats": stats}


def where_used(symbols: DataFrame, name: str, most: int = 1_000) -> dict[str, DataFrame]:
    """definitions of a name, the symbols that refer to it and the files of these, each once; no definition is an error."""
    definitions = symbols.where(F.col("name") == name)
    if definitions.isEmpty():
        raise LookupError(name)
    references = at_most(symbols.where(F.array_contains("references", name)), most, "references")
    return {"definitions": definitions, "references": references, "files": references.select("file_id").distinct().orderBy("file_id")}


def flow_graph(files: DataFrame, symbols: DataFrame, route: str | None = None) -> dict[str, DataFrame]:
    """nodes, edges and flows over the layers route < controller < service < model. Layers grow along an edge, so reach
    and paths are at most three joins."""
    own = _checked(symbols, files).withColumn("role", X.symbol_layer("type", "path"))
    called = own.where("role = 'route'").select(F.explode("references").alias("name")).distinct().withColumn("called", F.lit(True))
    own = own.join(called, "name", "left").withColumn("layer", F.coalesce("role", F.when(F.col("called") & F.col("type").isin(CALLABLE), "controller")))
    nodes = own.where("layer is not null").select("id", "name", "layer", "type", "path", "language", "start_line", "end_line", "references").withColumn("level", X.layer_order("layer"))
    refs = nodes.select(F.col("id").alias("source"), F.col("level").alias("low"), F.explode("references").alias("reference"))
    defs = nodes.select(F.col("id").alias("target"), F.col("name").alias("reference"), F.col("level").alias("high"))
    pairs = refs.join(defs, (refs["reference"] == defs["reference"]) & (F.col("low") < F.col("high"))).select("source", "target", refs["reference"])
    n = pairs.groupBy("source", "reference").agg((F.count("*") > 1).alias("ambiguous"))
    edges = pairs.join(n, ["source", "reference"]).groupBy("source", "target").agg(F.min(F.struct("reference", "ambiguous")).alias("r")).select("source", "target", "r.*")
    roots = nodes.where("layer = 'route'" if route is None else (F.col("layer") == "route") & (F.col("name") == route)).select("id")
    if route is not None:
        if roots.isEmpty():
            raise LookupError(route)
        reach = [roots]
        for _ in range(3):
            reach.append(edges.join(reach[-1].withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")))
        kept = reduce(DataFrame.union, reach).distinct()
        nodes = nodes.join(kept, "id", "left_semi")
        edges = edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi")
    nodes = degrees(nodes, edges)
    return {"nodes": nodes.drop("references", "level"), "edges": edges, "flows": flows(roots, nodes.select("id", "layer"), edges)}


def flows(roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """route, nodes (the path), complete, stops_at of all maximal paths of up to four layers."""
    step = edges.select("source", "target")
    out = roots.select(F.col("id").alias("n0"))
    for k in (1, 2, 3):
        out = out.join(step.select(F.col("source").alias(f"n{k - 1}"), F.col("target").alias(f"n{k}")), f"n{k - 1}", "left")
    path = F.filter(F.array("n0", "n1", "n2", "n3"), lambda x: x.isNotNull())
    out = out.select(path.alias("nodes")).withColumn("last", F.element_at("nodes", -1))
    out = out.join(nodes.select(F.col("id").alias("last"), F.col("layer").alias("stops_at")), "last")
    return out.select(F.element_at("nodes", 1).alias("route"), "nodes", (F.col("stops_at") == "model").alias("complete"), "stops_at")


def truncated(df: DataFrame, n: int, *order: str | Column) -> tuple[DataFrame, bool]:
    """The first n rows in order, and whether there are more."""
    more = df.limit(n + 1).count() > n
    return df.orderBy(*order).limit(n), more


def traverse_many(edges: DataFrame, origins: DataFrame, direction: str = "both", depth: int = 2, max_nodes: int | None = 250, max_edges: int | None = None) -> dict[str, DataFrame]:
    """nodes(origin, path, distance, relation), edges(origin, source, target) and stats(origin, nodes, edges, truncated) of what is
    within ``depth`` steps of each of the origins(origin). relation: origin, dependency, dependent, both.

    A level is one join of the edges with the frontiers of all origins. New nodes get the merge of the relations that reach
    them; nodes seen before merge too but are not gone through again. An origin's cap takes nodes in the order of (frontier
    path, path), and edges in order; ``truncated`` says that either was passed."""
    if direction not in ("imports", "imported-by", "both") or not 1 <= depth <= 4:
        raise ValueError("direction or depth")
    shared_folder(edges.sparkSession)
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("dependency").alias("how"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit("dependent").alias("how"))
    step = out if direction == "imports" else back if direction == "imported-by" else out.unionByName(back)
    at = ["origin", "path"]
    seen = origins.select("origin").where("origin IS NOT NULL").distinct().select("origin", F.col("origin").alias("path"), F.lit(0).alias("distance"), F.lit("origin").alias("relation")).checkpoint()
    cut = seen.select("origin").limit(0)
    frontier = seen.select("origin", F.col("path").alias("a"), F.lit(None).cast("string").alias("own"))
    merge = F.when(F.count_distinct("relation") > 1, "both").otherwise(F.max("relation"))
    for k in range(1, depth + 1):
        hits = step.join(frontier, "a").select("origin", F.col("b").alias("path"), F.coalesce("own", "how").alias("relation"), "a").checkpoint()
        fresh = hits.join(seen.select(*at), at, "left_anti")
        if max_nodes is not None:
            order = W.partitionBy("origin").orderBy("a", "path")
            firsts = fresh.groupBy(*at).agg(F.min("a").alias("a")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_nodes)
            held = seen.groupBy("origin").agg(F.count("*").alias("held"))
            firsts = firsts.join(held, "origin").withColumn("fits", F.col("nth") + F.col("held") <= max_nodes).checkpoint()
            cut = cut.union(firsts.where("NOT fits").select("origin"))
            fresh = fresh.join(firsts.where("fits").select(*at), at, "left_semi")
        new = fresh.groupBy(*at).agg(merge.alias("relation")).withColumn("distance", F.lit(k))
        again = hits.join(seen.where(F.col("relation") != "origin").select(*at), at, "left_semi").select(*at, "relation")
        old = seen.where("relation != 'origin'").select(*at, "relation").unionByName(again).groupBy(*at).agg(merge.alias("relation"))
        seen = seen.join(old.withColumnRenamed("relation", "now"), at, "left").select(*at, "distance", F.coalesce("now", "relation").alias("relation")).unionByName(new.select(*at, "distance", "relation")).checkpoint()
        frontier = seen.where(F.col("distance") == k).select("origin", F.col("path").alias("a"), F.col("relation").alias("own"))
        if frontier.isEmpty():
            break
    ends = lambda name: seen.select("origin", F.col("path").alias(name))
    inside = edges.select("source", "target").distinct().join(ends("source"), "source").join(ends("target"), ["origin", "target"]).select("origin", "source", "target")
    if max_edges is not None:
        inside = inside.withColumn("nth", F.row_number().over(W.partitionBy("origin").orderBy("source", "target"))).where(F.col("nth") <= max_edges + 1).checkpoint()
        cut = cut.union(inside.where(F.col("nth") > max_edges).select("origin"))
        inside = inside.where(F.col("nth") <= max_edges).drop("nth")
    nodes = seen.groupBy("origin").agg(F.count("*").alias("nodes"))
    stats = nodes.join(inside.groupBy("origin").agg(F.count("*").alias("edges")), "origin", "left").join(cut.distinct().withColumn("truncated", F.lit(True)), "origin", "left")
    return {"nodes": seen, "edges": inside, "stats": stats.select("origin", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("truncated", F.lit(False)).alias("truncated"))}


def traverse(edges: DataFrame, origin: str, direction: str = "both", depth: int = 2, max_nodes: int | None = 250) -> DataFrame:
    """path, distance, relation of what is within ``depth`` steps of one origin, as :func:`traverse_many`."""
    origins = edges.sparkSession.createDataFrame([(origin,)], "origin string")
    return traverse_many(edges, origins, direction, depth, max_nodes)["nodes"].drop("origin")


def induced(edges: DataFrame, nodes: DataFrame, key: str = "path") -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = nodes.select(F.col(key).alias("__n"))
    return edges.join(ends, F.col("source") == F.col("__n"), "left_semi").join(ends, F.col("target") == F.col("__n"), "left_semi")


# The reasons for which a file is related, and their weights.
REASONS = {
    "DIRECT_IMPORT": 100, "DIRECT_DEPENDENT": 95, "APPLICATION_FLOW": 90, "SYMBOL_REFERENCE": 80, "SAME_APPLICATION_FLOW": 60,
    "SECOND_DEGREE_IMPORT": 40, "SECOND_DEGREE_DEPENDENT": 35, "SHARED_DEPENDENCY": 30,
}


def related(origins: DataFrame, imports: DataFrame, symbol_edges: DataFrame | None = None, flow_edges: DataFrame | None = None, flow_members: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """origin, path, score, reasons, rank, truncated (there were more) for each of the origins(origin). imports, symbol_edges, flow_edges: (source, target) as
    paths; flow_members: (flow, path). Each reason is a join from the origins; scores are sums over distinct reasons."""
    e = imports.select("source", "target").distinct()
    o = origins.select("origin").distinct()
    reason = lambda df, code: df.select("origin", "path", F.lit(code).alias("code"))
    ahead = o.join(e, F.col("origin") == F.col("source")).select("origin", F.col("target").alias("path"))
    behind = o.join(e, F.col("origin") == F.col("target")).select("origin", F.col("source").alias("path"))
    second = ahead.join(e, F.col("path") == F.col("source")).select("origin", F.col("target").alias("path"))
    before = behind.join(e, F.col("path") == F.col("target")).select("origin", F.col("source").alias("path"))
    shared = ahead.join(e, F.col("path") == F.col("target")).select("origin", F.col("source").alias("path"))
    parts = [reason(ahead, "DIRECT_IMPORT"), reason(behind, "DIRECT_DEPENDENT"), reason(second, "SECOND_DEGREE_IMPORT"), reason(before, "SECOND_DEGREE_DEPENDENT"), reason(shared, "SHARED_DEPENDENCY")]
    for edges, code in ((symbol_edges, "SYMBOL_REFERENCE"), (flow_edges, "APPLICATION_FLOW")):
        if edges is not None:
            both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
            parts.append(reason(o.join(both, F.col("origin") == F.col("source")).select("origin", F.col("target").alias("path")), code))
    if flow_members is not None:
        mine = o.join(flow_members, F.col("origin") == F.col("path")).select("origin", "flow")
        parts.append(reason(mine.join(flow_members, "flow"), "SAME_APPLICATION_FLOW"))
    weight = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    each = reduce(DataFrame.unionByName, parts).where("path != origin").distinct().withColumn("weight", weight[F.col("code")])
    out = each.groupBy("origin", "path").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "code"))).alias("r"))
    out = out.select("origin", "path", "score", F.transform("r", lambda x: x["code"]).alias("reasons"))
    order = W.partitionBy("origin").orderBy(F.desc("score"), F.desc(F.size("reasons")), "path")
    out = out.withColumn("rank", F.row_number().over(order))
    if limit is None:
        return out.withColumn("truncated", F.lit(False))
    out = out.where(F.col("rank") <= limit + 1).withColumn("truncated", F.max("rank").over(W.partitionBy("origin")) > limit)
    return out.where(F.col("rank") <= limit)
