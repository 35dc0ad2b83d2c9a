"""Canonical facts and derived facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import last_wins
from ..functions.text import packed, sha_id, unpacked
from .parse import NPM_RUN

PAYLOAD = ("from_id", "from_kind", "from_label", "to_id", "to_kind", "to_label")
#: Names of the payload keys in the hashed JSON.
JSON_KEYS = ("fromId", "fromKind", "fromLabel", "toId", "toKind", "toLabel")

#: Fixed value: pairs of symbols for each task.
PAIRS = 1_000_000


def canonical(df: DataFrame, kind: str, id_parts: list[Column], confidence: Column | float, payload: dict[str, Column]) -> DataFrame:
    """fact_id, kind, confidence, path, evidence_id, payload, seq. Nulls are left out of the payload; evidence_id is the fact's own id unless the rows have one."""
    fact = sha_id(F.col("path"), F.lit(kind), *id_parts)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(payload.items())]), lambda e: e["value"].isNotNull())
    return df.select(
        fact.alias("fact_id"), F.lit(kind).alias("kind"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), "path",
        (F.col("evidence_id") if "evidence_id" in df.columns else fact).alias("evidence_id"), F.map_from_entries(pairs).alias("payload"), (F.col("seq") if "seq" in df.columns else F.lit(0)).cast("long").alias("seq"),
    )


def symbol_definitions(symbols: DataFrame) -> DataFrame:
    c = F.col
    return canonical(symbols, "symbol_definition", [c("kind"), c("name")], 1.0, {"language": c("language"), "name": c("name"), "scope": F.lit("file"), "symbolCandidateId": c("evidence_id"), "symbolKind": c("kind")})


def file_imports(imports: DataFrame) -> DataFrame:
    c = F.col
    return canonical(imports, "file_import", [c("specifier")], F.when(c("is_package"), 0.95).otherwise(0.9), {"specifier": c("specifier"), "isPackage": c("is_package")})


def package_dependencies(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "package_dependency", [c("name")], 1.0, {"packageName": c("package_name"), "dependencyName": c("name"), "version": c("version")})


def package_scripts(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "package_script", [c("name")], 1.0, {"packageName": c("package_name"), "scriptName": c("name"), "command": c("command")})


def workflow_steps(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "workflow_step", [c("name"), c("command")], 0.95, {"stepName": c("name"), "command": c("command"), "scriptName": c("script_name")})


def quality_gates(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "quality_gate", [c("tool"), c("command")], 0.95, {"tool": c("tool"), "command": c("command"), "scriptName": c("script_name")})


def workspace_tasks(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "workspace_task", [c("name")], 0.9, {"taskName": c("name"), "command": c("command"), "taskType": F.lit("package-script")})


def workflows(rows: DataFrame) -> DataFrame:
    return canonical(rows, "workflow", [F.col("name")], 0.9, {"workflowName": F.col("name")})


def config_artifacts(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "config_artifact", [c("name")], 0.9, {"artifactName": c("name"), "artifactKind": c("artifact_kind")})


def symbol_exports(rows: DataFrame) -> DataFrame:
    c = F.col
    return canonical(rows, "symbol_export", [c("name"), c("symbol_kind")], c("confidence"), {"exportedName": c("name"), "symbolKind": c("symbol_kind")})


def settle_facts(*facts: DataFrame) -> DataFrame:
    """All facts, one per id: the last of the last table wins. Ids are shuffled packed, evidence that is the fact's own id not at all."""
    every = reduce(DataFrame.unionByName, [f.withColumn("_t", F.lit(k)) for k, f in enumerate(facts)])
    evidence = F.when(F.col("evidence_id") == F.col("fact_id"), F.lit(b"")).otherwise(packed(F.col("evidence_id")))
    one = last_wins(every.withColumns({"evidence_id": evidence, "fact_id": packed(F.col("fact_id"))}), ["fact_id"], "_t", "seq").drop("_t")
    own = unpacked(F.col("fact_id"))
    return one.withColumns({"evidence_id": F.when(F.octet_length("evidence_id") == 0, own).otherwise(unpacked(F.col("evidence_id"))), "fact_id": own})


def payload(key: str) -> Column:
    return F.try_element_at(F.col("payload"), F.lit(key))


def derived(df: DataFrame, kind: Column | str, confidence: Column | None = None, identifier: Column | None = None, **ends: Column) -> DataFrame:
    """Derived facts of rows with path, confidence, evidence_id: the six ends as columns, and an id over path, kind and their JSON."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    ends = {k: ends[k].cast("string") for k in PAYLOAD}
    as_json = F.to_json(F.struct(*[ends[k].alias(j) for k, j in zip(PAYLOAD, JSON_KEYS)]))
    made = sha_id(F.col("path"), kind, as_json) if identifier is None else identifier
    return df.select(made.alias("derived_fact_id"), kind.alias("kind"), (F.col("confidence") if confidence is None else confidence).cast("double").alias("confidence"), "evidence_id", "path", *[v.alias(k) for k, v in ends.items()])


def _ends(a_id, a_kind, b_id, b_kind) -> dict:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return {"from_id": lit(a_id), "from_kind": lit(a_kind), "from_label": lit(a_id), "to_id": lit(b_id), "to_kind": lit(b_kind), "to_label": lit(b_id)}


def crowded(symbols: DataFrame, most: int) -> DataFrame:
    """path and n of files with more than ``most`` symbols, whose pairs would be too many."""
    return symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def symbol_pairs(symbols: DataFrame) -> DataFrame:
    """All ordered pairs of distinct symbols of a file as reference candidates, and those of two functions as call candidates too. The contract is all pairs within a file; :func:`crowded` tells the files that are too large for it. Files are dealt over as many tasks as their pairs ask for, about ``PAIRS`` each, so that what groups or sorts the pairs takes no more memory for more files."""
    n = symbols.groupBy("path").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    symbols = symbols.repartition(int(n // PAIRS) + 1, "path").hint("merge")
    a = symbols.select("path", F.col("evidence_id").alias("a"), F.col("name").alias("an"), F.col("kind").alias("ak"))
    b = symbols.select("path", F.col("evidence_id").alias("b"), F.col("name").alias("bn"), F.col("kind").alias("bk"))
    pairs = a.join(b, "path").filter("a <> b")
    roles = F.when((F.col("ak") == "function") & (F.col("bk") == "function"), F.array(F.lit("symbol-references-symbol-candidate"), F.lit("caller-callee-candidate"))).otherwise(F.array(F.lit("symbol-references-symbol-candidate")))
    rows = pairs.withColumn("k", F.explode(roles))
    return rows.select(
        sha_id(F.col("path"), F.col("k"), F.col("a"), F.col("b")).alias("derived_fact_id"), F.col("k").alias("kind"), F.when(F.col("k") == "caller-callee-candidate", 0.55).otherwise(0.6).alias("confidence"), F.col("a").alias("evidence_id"), "path",
        F.col("a").alias("from_id"), F.lit("SymbolCandidate").alias("from_kind"), F.col("an").alias("from_label"), F.col("b").alias("to_id"), F.lit("SymbolCandidate").alias("to_kind"), F.col("bn").alias("to_label"),
    )


def derive(facts: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """All derived facts of canonical facts and of the symbols' pairs; one per id."""
    p, of = payload, lambda kind: facts.filter(F.col("kind") == kind)
    steps, gates, scripts = of("workflow_step"), of("quality_gate"), of("package_script")
    run = F.when(p("command").rlike(NPM_RUN), F.regexp_extract(p("command"), NPM_RUN, 1))
    imports = of("file_import")
    package = p("isPackage") == "true"
    jobs = steps.withColumn("_job", F.explode(F.array(F.lit(True), F.lit(False))))
    parts = [
        derived(of("symbol_definition"), "symbol-defined-in-file", **_ends(p("name"), "Symbol", F.col("path"), "File")),
        derived(of("symbol_export"), "symbol-exported-from-file", **_ends(p("exportedName"), "Symbol", F.col("path"), "File")),
        derived(imports, F.when(package, "file-imports-package").otherwise("file-imports-file"), **_ends(F.col("path"), "File", p("specifier"), F.when(package, "Package").otherwise("File"))),
        derived(of("package_dependency"), "package-depends-on-package", **_ends(F.coalesce(p("packageName"), F.col("path")), "Package", F.coalesce(p("dependencyName"), F.lit("unknown")), "Package")),
        derived(jobs, F.when(F.col("_job"), "workflow-contains-job").otherwise("job-runs-step"), **_ends(F.when(F.col("_job"), F.col("path")).otherwise(p("stepName")), F.when(F.col("_job"), "Workflow").otherwise("WorkflowJob"), p("stepName"), F.when(F.col("_job"), "WorkflowJob").otherwise("WorkflowStep"))),
        derived(steps.filter(p("scriptName").isNotNull()), "workflow-runs-package-script-candidate", **_ends(p("stepName"), "WorkflowStep", p("scriptName"), "PackageScript")),
        derived(of("workspace_task").filter(p("command").isNotNull()), "task-runs-command", **_ends(p("taskName"), "Task", p("command"), "Command")),
        derived(gates, "quality-gate-runs-command", **_ends(p("tool"), "QualityGate", p("command"), "Command")),
        derived(gates.filter(p("scriptName").isNotNull()), "quality-gate-runs-script-candidate", **_ends(p("tool"), "QualityGate", p("scriptName"), "PackageScript")),
        derived(scripts.filter(run.isNotNull()), "quality-gate-runs-script-candidate", **_ends(p("scriptName"), "PackageScript", run, "PackageScript")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    contained = every.filter("kind = 'workflow-contains-job'").select("from_id").distinct()
    lone = of("workflow").withColumn("_name", p("workflowName")).join(contained, F.col("_name") == F.col("from_id"), "left_anti")
    every = every.unionByName(derived(lone, "workflow-contains-job", **_ends(F.col("_name"), "Workflow", F.col("_name"), "WorkflowJob")))
    if symbols is not None:
        every = every.unionByName(symbol_pairs(symbols))
    return every.dropDuplicates(["derived_fact_id"])


def kind_counts(derived: DataFrame) -> DataFrame:
    """kind, n, paths, total (of the confidence) of each kind of derived fact."""
    return derived.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), F.round(F.sum("confidence"), 3).alias("total"))
