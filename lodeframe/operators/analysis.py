"""Questions over facts, symbols and the graph: entrypoints, anchors, impact, slices, flow."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.rows import cut, first_groups, first_wins
from ..functions.text import sha_id
from .facts import payload

#: Entrypoint kind of each canonical kind, and the payload keys that name one.
ENTRYPOINT_KINDS = {"workflow": "workflow", "package_script": "script", "workspace_task": "worker", "quality_gate": "test", "config_artifact": "entrypoint", "entrypoint_candidate": "entrypoint"}
ENTRYPOINT_NAMES = ("workflowName", "scriptName", "taskName", "artifactName", "tool")
CALLS = ("caller-callee-candidate",)
REFERENCES = ("symbol-references-symbol-candidate",)
IMPORTS = ("file-imports-file", "file-imports-package")
CONFIG = ("package-depends-on-package", "config-selects-entrypoint-candidate", "task-runs-command", "quality-gate-runs-command", "quality-gate-runs-script-candidate")
WORKFLOW = ("workflow-contains-job", "job-runs-step", "workflow-runs-package-script-candidate")
#: Edge kinds for what a flow or slice includes.
FLOW_INCLUDE = {"calls": CALLS, "exports": ("symbol-exported-from-file",), "imports": IMPORTS, "config": CONFIG, "workflow": WORKFLOW}
SLICE_INCLUDE = {"calls": CALLS + REFERENCES, "imports": IMPORTS, "config": CONFIG, "control": (), "data": ()}
#: Fact kinds and direction of each impact mode (all: any kind, both directions).
IMPACT_MODES = {
    "callers": (CALLS, "backward"),
    "callees": (CALLS, "forward"),
    "dependents": (REFERENCES + IMPORTS + ("package-depends-on-package",), "forward"),
    "tests": (("quality-gate-runs-command", "quality-gate-runs-script-candidate"), "forward"),
    "runtime": (("task-runs-command", "file-declares-entrypoint-candidate", "config-selects-entrypoint-candidate") + WORKFLOW, "forward"),
}
#: Defaults and caps.
LIMITS = {"impact": (25, 200), "slice": (40, 200), "entrypoints": (20, 100), "depth": (4, 8), "nodes": (200, 800), "time_ms": (1500, 5000)}


@dataclass(frozen=True)
class Anchor:
    kind: str
    name: str = ""
    id: str | None = None
    path: str | None = None
    source_type: str | None = None

    @property
    def key(self) -> str:
        return self.id or f"{self.kind}:{self.path or self.name}"


def limit(what: str, asked: int | None) -> int:
    default, most = LIMITS[what]
    if asked is None:
        return default
    if isinstance(asked, bool) or not isinstance(asked, int) or asked <= 0:
        raise EngineError("INVALID_INPUT", f"{what} limit must be a positive integer")
    return min(asked, most)


def entrypoints(facts: DataFrame, symbols: DataFrame | None = None, declared: DataFrame | None = None, query: str | None = None, kind: str | None = None, path: str | None = None, package: str | None = None, confidence_min: float = 0.0, most: int | None = None) -> DataFrame:
    """name, kind, path, confidence, tier, symbol_id of entrypoints in order of rank. Of rows with one kind, path and name the first in input order stays, before ranking."""
    kinds = F.create_map(*[F.lit(x) for kv in ENTRYPOINT_KINDS.items() for x in kv])
    rows = facts.filter(F.col("kind").isin(*ENTRYPOINT_KINDS)).select(F.coalesce(*map(payload, ENTRYPOINT_NAMES), F.col("path")).alias("name"), F.element_at(kinds, F.col("kind")).alias("kind"), "path", "confidence", F.lit("derived").alias("tier"), F.col("fact_id").alias("_order"), F.lit(0).alias("_part"))
    if declared is not None:
        d = declared.filter("kind = 'file-declares-entrypoint-candidate'")
        rows = rows.unionByName(d.select(F.coalesce("to_label", "to_id").alias("name"), F.lit("entrypoint").alias("kind"), "path", "confidence", F.lit("possible").alias("tier"), F.col("derived_fact_id").alias("_order"), F.lit(1).alias("_part")))
    keep = F.col("confidence") >= confidence_min
    if kind:
        keep &= F.col("kind") == kind
    if path:
        keep &= F.col("path") == path
    if package:
        keep &= F.contains("path", F.lit(package))
    if query:
        keep &= F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("path"), F.lit(query.lower()))
    one = first_wins(rows.filter(keep), ["kind", "path", "name"], "_part", "_order")
    if symbols is None:
        one = one.withColumn("symbol_id", F.lit(None).cast("string"))
    else:
        firsts = symbols.groupBy("path").agg(F.min("evidence_id").alias("symbol_id"))
        one = one.join(firsts, "path", "left")
    return one.drop("_part", "_order").orderBy(F.desc("confidence"), "path", "name", "kind").limit(limit("entrypoints", most))


def candidates(symbols: DataFrame, anchor: Anchor) -> DataFrame:
    """Symbols with the anchor's name in order of score."""
    out = symbols.filter(F.col("name") == anchor.name)
    sure = F.when(F.col("signature").isNotNull(), 0.95).otherwise(0.75)
    same = F.when(F.col("path") == anchor.path, 100).otherwise(0) if anchor.path else F.lit(0)
    if anchor.path:
        out = out.filter(F.col("path") == anchor.path)
    if anchor.source_type and "source_type" in symbols.columns:
        out = out.filter(F.col("source_type") == anchor.source_type)
    return out.withColumn("score", F.lit(1000) + same + sure).orderBy(F.desc("score"), "path", "start_line", "evidence_id")


def resolve(symbols: DataFrame | None, anchor: Anchor) -> Anchor:
    """An anchor with an id; at most six rows reach the driver."""
    if anchor.id or anchor.kind != "symbol" or symbols is None:
        return Anchor(anchor.kind, anchor.name, anchor.key, anchor.path, anchor.source_type)
    rows = candidates(symbols, anchor).select("evidence_id", "path", "score").limit(6).collect()
    if not rows:
        raise EngineError("ANCHOR_NOT_FOUND", f"no symbol {anchor.name}")
    if len(rows) > 1 and rows[0]["score"] == rows[1]["score"]:
        raise EngineError("AMBIGUOUS_ANCHOR", f"several symbols {anchor.name}", {"candidates": [r["evidence_id"] for r in rows[:5]]})
    return Anchor("symbol", anchor.name, rows[0]["evidence_id"], rows[0]["path"], anchor.source_type)


def matched_side(anchor: Anchor) -> Column:
    """from, to or null: the end of a fact that the anchor names, from first."""
    end = lambda x: (F.col(f"{x}_id") == anchor.key) | ((F.lower(f"{x}_kind") == anchor.kind.lower()) & (F.col(f"{x}_label") == anchor.name) & F.lit(not anchor.path))
    return F.when(end("from"), "from").when(end("to"), "to")


def _sided(facts: DataFrame, anchor: Anchor, direction: str) -> DataFrame:
    out = facts.withColumn("side", matched_side(anchor)).filter("side IS NOT NULL")
    if direction != "both":
        out = out.filter(F.col("side") == ("from" if direction == "forward" else "to"))
    other = lambda x: F.when(F.col("side") == "from", F.col(f"to_{x}")).otherwise(F.col(f"from_{x}"))
    return out.withColumn("other_id", other("id")).withColumn("other_kind", other("kind")).withColumn("other_label", other("label"))


def impact(facts: DataFrame, anchor: Anchor, mode: str = "all", confidence_min: float = 0.0, most: int | None = None, order: str = "derived_fact_id") -> DataFrame:
    """Facts that touch the anchor: the first of the order within the limit, with the other end, a classification and an id."""
    kinds, direction = IMPACT_MODES.get(mode, (None, "both"))
    rows = facts.filter(F.col("kind").isin(*kinds)) if kinds else facts
    rows = _sided(rows.filter(F.col("confidence") >= confidence_min), anchor, direction)
    sure = F.when(F.col("kind").isin(*CALLS), "direct").otherwise("possible")
    return rows.orderBy(order).limit(limit("impact", most)).select("derived_fact_id", "kind", "path", "confidence", "side", "other_id", "other_kind", "other_label", sure.alias("classification"), sha_id(F.col("evidence_id"), anchor.key).alias("impact_id"))


def impact_summary(rows: DataFrame, most: int | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(F.count_if(F.col("classification") == "direct").alias("direct"), F.count_if(F.col("classification") == "possible").alias("possible"), n.alias("total"), (n >= limit("impact", most)).alias("truncated"))


def evidence_slice(facts: DataFrame, anchor: Anchor, direction: str = "both", include: tuple[str, ...] = (), max_files: int | None = None, most: int | None = None, order: str = "derived_fact_id") -> DataFrame:
    """Facts around the anchor in order, of the first max_files paths, within the limit."""
    chosen = include or tuple(SLICE_INCLUDE)
    kinds = [k for name in chosen for k in SLICE_INCLUDE.get(name, ())]
    rows = _sided(facts.filter(F.col("kind").isin(*kinds)), anchor, direction)
    if max_files is not None:
        rows = first_groups(rows, "path", order, max_files)
    return rows.orderBy(order).limit(limit("slice", most)).select("derived_fact_id", "kind", "path", "confidence", "side", "other_id", sha_id(F.col("evidence_id"), anchor.key).alias("slice_id"))


def flow(edges: DataFrame, start: Anchor, target: Anchor | None = None, direction: str = "forward", include: tuple[str, ...] = (), max_depth: int | None = None, max_nodes: int | None = None, time_budget_ms: int | None = None) -> tuple[list[dict], dict]:
    """Segments of a trace in breadth-first order and its summary. edges: derived facts.

    A level is one query: the edges of all nodes of the frontier, ranked by their node's turn and then by their far end, as many as there is room for. So a trace takes as many queries as it has levels, and no more rows than the depth reach the driver: the depth bounds all segments, not a path. The frontier stands in the query as literals, so that it reaches the scan.
    """
    room, nodes = limit("depth", max_depth), limit("nodes", max_nodes)
    until = None if time_budget_ms is None else time.monotonic() + limit("time_ms", time_budget_ms) / 1000
    known = [i for i in include if i in FLOW_INCLUDE]
    kinds = [k for i in known or FLOW_INCLUDE for k in FLOW_INCLUDE[i]]
    here, there = ("to", "from") if direction == "backward" else ("from", "to")
    usable = edges.filter(F.col("kind").isin(*kinds)).select("derived_fact_id", "kind", "path", "confidence", F.col(f"{here}_id").alias("here"), F.col(f"{there}_id").alias("there"), F.col(f"{there}_kind").alias("end_kind"), F.col(f"{there}_label").alias("end_label"))
    segments: list[dict] = []
    met, frontier, asked, status = {start.key}, [start.key], 0, None
    while frontier and status is None:
        turns = frontier[: nodes - asked]
        if not turns or until is not None and time.monotonic() > until:
            status = "truncated"
            break
        turn = F.array_position(F.array(*map(F.lit, turns)), F.col("here"))
        level = usable.filter(F.col("here").isin(*turns)).dropDuplicates(["derived_fact_id"]).withColumn("turn", turn)
        rows = level.orderBy("turn", "end_kind", "end_label", "path", "there", "derived_fact_id").limit(room - len(segments)).collect()
        if asked + len(frontier) >= nodes:  # the last node that may be asked gives one segment, and the trace ends there
            last = [i for i, r in enumerate(rows) if r["turn"] == nodes - asked]
            rows, status = (rows[: last[0] + 1], "truncated") if last else (rows, "truncated" if len(frontier) > len(turns) else None)
        hits = [i for i, r in enumerate(rows) if target is not None and r["there"] == target.key]
        if hits:
            rows, status = rows[: hits[0] + 1], "complete"
        segments += [{"seq": len(segments) + i, "from_id": r["here"], "to_id": r["there"], "kind": r["kind"], "path": r["path"], "confidence": r["confidence"], "edge_id": r["derived_fact_id"]} for i, r in enumerate(rows)]
        if status is None and len(segments) >= room:
            status = "truncated"
        asked += len(turns)
        frontier = [x for x in dict.fromkeys(r["there"] for r in rows) if x not in met]
        met.update(frontier)
    limits = ["unsupported-include"] * (len(known) < len(include)) + ["budget"] * (status == "truncated") + ["no-match"] * (not segments) + ["coverage"] * (not include)
    status = status or ("ambiguous" if target is not None and segments else "partial")
    confidence = round(min([1.0, *(s["confidence"] for s in segments)]), 6) if segments else 0.0
    return segments, {"completeness": status, "confidence": confidence, "limitations": limits, "end": segments[-1]["to_id"] if segments else (target.key if target else None)}


def reachable(edges: DataFrame, start: str, depth: int = 4) -> DataFrame:
    """node, depth of all that the start reaches, by joins of the frontier with the edges; the number of rounds is the depth."""
    spark = edges.sparkSession
    step = edges.select("from_id", "to_id").distinct().persist()
    rounds = [spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"))]
    for level in range(1, depth + 1):
        found = reduce(DataFrame.unionByName, rounds).select("node")
        ends = step.join(rounds[-1].select(F.col("node").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("node")).distinct()
        rounds.append(cut(ends.join(found, "node", "left_anti").withColumn("depth", F.lit(level))))
    return reduce(DataFrame.unionByName, rounds)


#: The payload key that labels each kind of context.
CONTEXT_LABELS = {"symbol_export": "exportedName", "file_import": "specifier", "workflow": "workflowName", "workspace_task": "taskName", "quality_gate": "tool", "config_artifact": "artifactName"}
REPOSITORY = ("workflow", "workspace_task", "quality_gate", "config_artifact")


def contexts(facts: DataFrame, kinds: tuple[str, ...], name: str) -> DataFrame:
    """fact_id, kind, path, evidence_id, label of the facts of some kinds with any payload value equal to the name; the label falls back to the kind."""
    labels = F.create_map(*[F.lit(x) for kv in CONTEXT_LABELS.items() for x in kv])
    hit = facts.filter(F.col("kind").isin(*kinds) & F.array_contains(F.map_values("payload"), name))
    return hit.select("fact_id", "kind", "path", "evidence_id", F.coalesce(F.try_element_at("payload", F.try_element_at(labels, F.col("kind"))), F.col("kind")).alias("label"))


def graph_contexts(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of symbols and tasks that carry the name."""
    return nodes.filter(F.col("kind").isin("Symbol", "Task") & (F.col("label") == name))


def matching_symbols(symbols: DataFrame, path: str, name: str) -> DataFrame:
    """Symbols of one path with exactly this name, with their confidence, in order of rank."""
    rows = symbols.filter((F.col("path") == path) & (F.col("name") == name)).withColumn("confidence", F.when(F.col("signature").isNotNull(), 0.95).otherwise(0.75))
    return rows.orderBy(F.desc("confidence"), "start_line", "evidence_id")


def relations(derived: DataFrame, key: str, end: str, kinds: tuple[str, ...] = CALLS) -> DataFrame:
    """Derived facts of some kinds with the symbol at one end: from (callers, as the contract names edges out of it) or to (callees)."""
    return derived.filter(F.col("kind").isin(*kinds) & (F.col(f"{end}_id") == key))


def symbol_detail(symbols: DataFrame, facts: DataFrame, derived: DataFrame, path: str, name: str, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The symbol, its callers and callees, exports, imports, references, repository contexts and, with graph nodes, its tests. Two symbols of equal confidence are ambiguous."""
    rows = matching_symbols(symbols, path, name)
    top = rows.limit(2).collect()
    if not top:
        raise EngineError("SYMBOL_NOT_FOUND", f"no symbol {name} in {path}")
    if len(top) > 1 and top[0]["confidence"] == top[1]["confidence"]:
        raise EngineError("AMBIGUOUS_SYMBOL", f"several symbols {name} in {path}")
    key = top[0]["evidence_id"]
    best = facts.filter((F.col("kind") == "symbol_definition") & (payload("name") == name)).agg(F.max("confidence").alias("c"))  # one row
    out = {
        "symbol": rows.filter(F.col("evidence_id") == key).join(F.broadcast(best)).withColumn("confidence", F.greatest("confidence", "c")).drop("c"),
        "callers": relations(derived, key, "from"),
        "callees": relations(derived, key, "to"),
        "references": relations(derived, key, "from", REFERENCES),
        "exports": contexts(facts, ("symbol_export",), name),
        "imports": contexts(facts, ("file_import",), name),
        "contexts": contexts(facts, REPOSITORY, name),
    }
    return out if nodes is None else out | {"tests": graph_contexts(nodes, name)}
