"""The property graph and its overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import last_wins
from ..functions.text import packed, sha_id, unpacked
from .facts import payload

VERSION = "milestone-4.1"
#: For each kind of fact the payload key that names its node, and the node's kind.
DESCRIPTORS = {
    "symbol_definition": ("name", "Symbol"), "symbol_export": ("exportedName", "Symbol"), "package_dependency": ("dependencyName", "Package"), "package_script": ("scriptName", "PackageScript"), "workspace_task": ("taskName", "Task"),
    "config_artifact": ("artifactName", "ConfigArtifact"), "workflow": ("workflowName", "Workflow"), "workflow_job": ("jobName", "WorkflowJob"), "workflow_step": ("stepName", "WorkflowStep"), "quality_gate": ("tool", "QualityGate"),
}
ENTRYPOINT_NAMES = ("name", "scriptName", "workflowName", "taskName", "artifactName", "tool")
OVERLAYS = {"caller-callee-candidate": ("cfg", "cfg-next"), "symbol-references-symbol-candidate": ("data_flow", "data-flow")}
PDG_KINDS = ("file-imports-file", "file-imports-package", "workflow-runs-package-script-candidate", "quality-gate-runs-script-candidate", "config-selects-entrypoint-candidate")

#: Fixed value: nodes that a query names as literals at most.
FEW = 1000


def node_id(kind: Column, name: Column) -> Column:
    return sha_id(kind, name)


def edge_id(a: Column, kind: Column, b: Column) -> Column:
    return sha_id(a, kind, b)


def node_key(kind: Column, name: Column) -> Column:
    """What a node id is the hash of, or the hash's bytes where they are shorter: equal for equal ids, and 33 bytes at most."""
    text = F.concat_ws(":", kind, name)
    return F.when(F.octet_length(text) <= 32, F.concat(F.lit(b"\0"), text.cast("binary"))).otherwise(F.concat(F.lit(b"\1"), F.unhex(F.sha2(text.cast("binary"), 256))))


def id_of_key(key: Column) -> Column:
    rest = F.substring(key, 2, 33)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(F.sha2(rest, 256))


def descriptor() -> Column:
    """Struct of id and kind of the domain node that a canonical fact stands for, null where it names none."""
    out = F.when(F.col("kind") == "file_import", F.struct(payload("specifier").alias("id"), F.when(payload("isPackage") == "true", "Package").otherwise("File").alias("kind")))
    for kind, (key, node) in DESCRIPTORS.items():
        out = out.when(F.col("kind") == kind, F.struct(payload(key).alias("id"), F.lit(node).alias("kind")))
    out = out.when(F.col("kind") == "entrypoint_candidate", F.struct(F.coalesce(*map(payload, ENTRYPOINT_NAMES)).alias("id"), F.lit("EntrypointCandidate").alias("kind")))
    return F.when(out["id"].isNotNull(), out)


def project(symbols: DataFrame | None, facts: DataFrame | None, derived: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind, label, path) and edges (edge_id, from_node_id, kind, to_node_id, path, evidence_id, confidence); of rows with one id and path the last wins: symbols, then canonical, then derived facts, from before to. Keys and packed ids are shuffled, hex ids are made of them afterwards."""
    nodes, edges = [], []

    def add(df: DataFrame, ends: list[tuple], links: list[tuple]) -> None:
        """ends: order, kind, name, label of nodes (a null name is none); links: order, from, kind, to, confidence, with keys for from and to. Each table is read once for all its nodes."""
        tie = packed(F.col("_key")).alias("tie")
        made = F.array(*[F.struct(F.lit(seq).cast("byte").alias("seq"), kind.alias("kind"), name.alias("name"), label.alias("label")) for seq, kind, name, label in ends])
        rows = df.select("path", tie, F.explode(made).alias("n")).filter("n.name IS NOT NULL")
        nodes.append(rows.select(node_key(F.col("n.kind"), F.col("n.name")).alias("node"), "n.kind", packed(F.col("n.label")).alias("label"), "path", "n.seq", "tie"))
        for seq, a, kind, b, confidence in links:
            edges.append(df.select(a.alias("a"), kind.alias("kind"), b.alias("b"), "path", packed(F.col("evidence_id")).alias("evidence_id"), confidence.cast("double").alias("confidence"), F.lit(seq).cast("byte").alias("seq"), tie).filter("b IS NOT NULL"))

    if symbols is not None:
        s = symbols.withColumn("_key", F.col("evidence_id"))
        file, candidate = F.lit("File"), F.lit("SymbolCandidate")
        add(s, [(0, file, F.col("path"), F.col("path")), (1, candidate, F.col("evidence_id"), F.col("name"))], [(0, node_key(file, F.col("path")), F.lit("DEFINES_CANDIDATE"), node_key(candidate, F.col("evidence_id")), F.lit(1.0))])
    if facts is not None:
        f = facts.withColumn("_key", F.col("fact_id")).withColumn("_d", descriptor())
        own = F.concat(F.lit("CanonicalFact:"), F.col("kind"))
        to = F.when(F.col("_d").isNotNull(), node_key(F.col("_d.kind"), F.col("_d.id")))
        add(f, [(2, own, F.col("fact_id"), F.col("kind")), (3, F.col("_d.kind"), F.col("_d.id"), F.col("_d.id"))], [(1, node_key(own, F.col("fact_id")), F.lit("REPRESENTS"), to, F.col("confidence"))])
    if derived is not None:
        d = derived.withColumn("_key", F.col("derived_fact_id"))
        a_kind, b_kind = F.coalesce("from_kind", F.lit("Entity")), F.coalesce("to_kind", F.lit("Entity"))
        a_id, b_id = F.coalesce("from_id", "path"), F.coalesce("to_id", "derived_fact_id")
        add(d, [(4, a_kind, a_id, F.coalesce("from_label", a_id)), (5, b_kind, b_id, F.coalesce("to_label", b_id))], [(2, node_key(a_kind, a_id), F.col("kind"), node_key(b_kind, b_id), F.col("confidence"))])
    one = lambda parts, *keys: last_wins(reduce(DataFrame.unionByName, parts), [*keys, "path"], "seq", unpacked(F.col("tie")))
    a, b = id_of_key(F.col("a")), id_of_key(F.col("b"))
    return (
        one(nodes, "node").select(id_of_key(F.col("node")).alias("node_id"), "kind", unpacked(F.col("label")).alias("label"), "path"),
        one(edges, "a", "kind", "b").select(edge_id(a, F.col("kind"), b).alias("edge_id"), a.alias("from_node_id"), "kind", b.alias("to_node_id"), "path", unpacked(F.col("evidence_id")).alias("evidence_id"), "confidence"),
    )


def edges_by_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("from_node_id") == node) | (F.col("to_node_id") == node))


def by_path(rows: DataFrame, path: str) -> DataFrame:
    """Nodes or edges of one path."""
    return rows.filter(F.col("path") == path)


def edges_by_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch any of a table of nodes, an edge once. Up to ``FEW`` nodes stand in the query as literals, so that they reach the scan; more take two equality joins."""
    some = nodes.select(F.col("node_id").alias("_n")).distinct()
    few = [r["_n"] for r in some.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        hits = edges.filter(F.col("from_node_id").isin(few) | F.col("to_node_id").isin(few))
    else:
        hits = edges.join(some, edges.from_node_id == some._n, "left_semi").unionByName(edges.join(some, edges.to_node_id == some._n, "left_semi"))
    return hits.dropDuplicates(["edge_id", "path"])


def overlay_edges(derived: DataFrame) -> DataFrame:
    """overlay, edge_id, kind, from_id, to_id, path, confidence."""
    kind = F.col("kind")
    overlay = F.when(kind.isin(*PDG_KINDS), "pdg_lite")
    name = F.when(kind.isin(*PDG_KINDS), kind)
    for k, (o, n) in OVERLAYS.items():
        overlay, name = overlay.when(kind == k, o), name.when(kind == k, n)
    rows = derived.withColumn("overlay", overlay).withColumn("_name", name).filter("overlay IS NOT NULL")
    return rows.select("overlay", F.concat_ws(":", "_name", "derived_fact_id").alias("edge_id"), F.col("_name").alias("kind"), "from_id", "to_id", "path", "confidence", "from_kind", "from_label", "to_kind", "to_label", "derived_fact_id")


def overlay_nodes(edges: DataFrame) -> DataFrame:
    """overlay, id, kind, label of the ends of the kept edges; the last edge's attributes win. Ids are shuffled packed."""
    ends = F.array(*[F.struct(packed(F.col(f"{x}_id")).alias("id"), F.col(f"{x}_kind").alias("kind"), packed(F.col(f"{x}_label")).alias("label"), F.lit(k).cast("byte").alias("side")) for k, x in enumerate(("from", "to"))])
    rows = edges.select("overlay", packed(F.col("derived_fact_id")).alias("tie"), F.explode(ends).alias("e")).select("overlay", "tie", "e.*")
    return last_wins(rows, ["overlay", "id"], unpacked(F.col("tie")), "side").select("overlay", unpacked(F.col("id")).alias("id"), "kind", unpacked(F.col("label")).alias("label"))
