"""Structured observations: which analyzers read a file, and what they see in files, lines, blocks and repository artifacts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import last_wins
from ..functions.text import found, sha_id
from .parse import language

#: The languages that are known and their extensions.
LANGUAGES = {
    "js": ("js", "jsx", "cjs", "mjs"), "ts": ("ts", "tsx", "mts", "cts"), "py": ("py",), "go": ("go",), "java": ("java",), "rb": ("rb",), "rs": ("rs",), "php": ("php",), "kt": ("kt", "kts"),
    "swift": ("swift",), "scala": ("scala",), "cs": ("cs",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "sh": ("sh", "bash"),
}
#: Repository artifacts by their whole path.
ARTIFACTS = {"package.json": "package-json", "nx.json": "nx-json", ".devcontainer/devcontainer.json": "repo-config", "eslint.config.mjs": "repo-config", "commitlint.config.js": "repo-config", ".lintstagedrc.json": "repo-config"}
#: Patterns of exports and methods on a line, the export kinds in order of precedence, and the names in a block.
NAME = r"([A-Za-z_$][\w$]*)"
EXPORT = rf"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+{NAME}"
METHOD = rf"^\s*(?:public\s+|private\s+|protected\s+)?{NAME}\s*\("
EXPORT_KINDS = ("function", "class", "interface", "type", "enum")
FUNCTION, CLASS, INTERFACE, ENUM, TYPE, VARIABLE, CALL, DEF = rf"(?:export\s+default\s+)?(?:async\s+)?function\*?\s+{NAME}", rf"(?:abstract\s+)?class\s+{NAME}", rf"interface\s+{NAME}", rf"enum\s+{NAME}", rf"type\s+{NAME}", rf"(?:const|let|var)\s+{NAME}", rf"{NAME}\s*\(", r"def\s+([A-Za-z_][\w]*)"
BLOCK_NAMES = (FUNCTION, CLASS, INTERFACE, ENUM, TYPE, VARIABLE, CALL, DEF)


@dataclass(frozen=True)
class Rule:
    """A pattern over lines whose first group is the name."""

    id: str
    confidence: float
    kind: str
    pattern: str
    symbol_kind: str | None = None


#: The rules of each language that has some, and their confidences.
RULES = {
    "ts": (
        Rule("ts.function", 0.95, "symbol_definition", FUNCTION, "function"), Rule("ts.class", 0.95, "symbol_definition", CLASS, "class"), Rule("ts.interface", 0.9, "symbol_definition", INTERFACE, "interface"), Rule("ts.type", 0.9, "symbol_definition", rf"\btype\s+{NAME}\s*(?:<[^=]*>\s*)?=", "type"),
        Rule("ts.enum", 0.9, "symbol_definition", ENUM, "enum"), Rule("ts.variable", 0.85, "symbol_definition", VARIABLE, "variable"), Rule("ts.import", 0.85, "import", r"^\s*import\b.*?from\s+[\"']([^\"']+)[\"']"), Rule("ts.call", 0.65, "call", CALL), Rule("ts.reference", 0.55, "reference", NAME),
    ),
    "js": (
        Rule("js.function", 0.95, "symbol_definition", FUNCTION, "function"), Rule("js.class", 0.95, "symbol_definition", CLASS, "class"), Rule("js.variable", 0.85, "symbol_definition", VARIABLE, "variable"),
        Rule("js.import", 0.85, "import", r"^\s*import\b.*?from\s+[\"']([^\"']+)[\"']"), Rule("js.call", 0.65, "call", CALL), Rule("js.reference", 0.55, "reference", NAME),
    ),
    "py": (
        Rule("py.function", 0.95, "symbol_definition", DEF, "function"), Rule("py.class", 0.95, "symbol_definition", rf"^\s*{CLASS}", "class"), Rule("py.import", 0.85, "import", r"^\s*(?:from\s+\S+\s+)?import\s+([^\n;]+)"), Rule("py.call", 0.65, "call", CALL), Rule("py.reference", 0.55, "reference", NAME),
    ),
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def registered_language(path: Column) -> Column:
    """The language that an extension stands for, null if none is known."""
    return _lookup({e: name for name, extensions in LANGUAGES.items() for e in extensions}, language(path))


def artifact(path: Column) -> Column:
    """package-json, nx-json, github-workflow, repo-config or null."""
    return F.coalesce(_lookup(ARTIFACTS, path), F.when(path.rlike(r"^\.github/workflows/.*\.ya?ml$"), "github-workflow").when(path.startswith(".husky/"), "repo-config"))


def analyzers(docs: DataFrame) -> DataFrame:
    """docs (path, source_type) with one flag for each analyzer that reads the file: by_rules, deep, generic, by_artifact. An artifact's engines take the place of its language's; the generic analyzer has no name to be chosen by and reads all code of some language; without any capability, all analyzers that support the file do."""
    path, lang = F.col("path"), language(F.col("path"))
    code = (F.col("source_type") == "code") & lang.isNotNull()
    known, own = registered_language(path).isNotNull(), artifact(path).isNotNull()
    listed = _lookup(ARTIFACTS, path).isNotNull() | path.startswith(".github/workflows/") | path.startswith(".husky/")
    return docs.withColumns({"by_rules": F.coalesce(code & known & ~own, F.lit(False)), "deep": F.coalesce(code & lang.isin("ts", "js"), F.lit(False)), "generic": F.coalesce(code, F.lit(False)), "by_artifact": listed & (own | ~known)})


def _rows(df: DataFrame, kind: Column | str, confidence: Column | float, name: Column, symbol_kind: Column | str | None, *parts: Column | str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select(sha_id(F.col("path"), *parts).alias("evidence_id"), lit(kind).alias("kind"), sure.cast("double").alias("confidence"), name.alias("name"), lit(symbol_kind).alias("symbol_kind"), "path")


def files(docs: DataFrame, run_id: str) -> DataFrame:
    """One row per file with bytes and lines; the id depends on the run."""
    lang = F.coalesce(language(F.col("path")), F.lit("unknown"))
    base = docs.withColumn("_l", lang)
    return base.select(sha_id(F.col("path"), run_id, F.lit("file"), F.col("_l")).alias("evidence_id"), F.lit("file").alias("kind"), F.lit(1.0).alias("confidence"), F.col("_l").alias("language"), "path", F.octet_length("content").cast("long").alias("bytes"), F.size(F.split("content", "\r?\n")).cast("long").alias("line_count"))


def modules(docs: DataFrame) -> DataFrame:
    """One row per file of a language with rules."""
    lang = registered_language(F.col("path"))
    rows = docs.withColumn("_l", lang).filter(F.col("_l").isin(*RULES)).withColumn("_n", F.size(F.split("content", "\r?\n")).cast("string"))
    return _rows(rows, "module", 0.95, F.lit(None).cast("string"), None, "module", "1", F.col("_n"), F.concat(F.col("_l"), F.lit(".module")))


def by_rules(lines: DataFrame, rules: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
    """What the rules of a line's language find (path, place, line); ``rules`` takes the place of the built-in sets of its languages. All rules of a line are tried in one pass."""
    sets = RULES | (rules or {})
    line, lang = F.col("line"), registered_language(F.col("path"))
    shape = "array<struct<id: string, confidence: double, kind: string, symbol_kind: string, name: string>>"
    hits = F.lit(None).cast(shape)

    def tried(r: Rule) -> Column:
        made = lambda x: F.struct(F.lit(r.id).alias("id"), F.lit(r.confidence).alias("confidence"), F.lit(r.kind).alias("kind"), F.lit(r.symbol_kind).cast("string").alias("symbol_kind"), F.trim(x).alias("name"))
        return F.transform(F.array_distinct(F.regexp_extract_all(line, F.lit(r.pattern), 1)), made)

    for name, some in ((n, s) for n, s in sets.items() if s):
        hits = F.when(lang == name, F.concat(*map(tried, some)).cast(shape)).otherwise(hits)
    rows = lines.select("path", (F.col("place") + 1).cast("string").alias("n"), F.explode(hits).alias("h")).filter("h.name <> ''")
    return _rows(rows, F.col("h.kind"), F.col("h.confidence"), F.col("h.name"), F.col("h.symbol_kind"), F.col("h.kind"), F.col("h.name"), F.col("n"), F.col("n"), F.col("h.id"))


def script_lines(lines: DataFrame) -> DataFrame:
    """Exports and methods of TypeScript and JavaScript lines (path, place, line)."""
    line, at = F.col("line"), (F.col("place") + 1).cast("string")
    rows = lines.filter(language(F.col("path")).isin("ts", "js"))
    kind = F.coalesce(*[F.when(F.contains(line, F.lit(k)), F.lit(k)) for k in EXPORT_KINDS], F.lit("variable"))
    export = F.struct(F.lit("symbol_export").alias("kind"), found(line, EXPORT).alias("name"), kind.alias("symbol_kind"))
    method = F.struct(F.lit("symbol_definition").alias("kind"), F.when(~F.contains(line, F.lit("function ")), found(line, METHOD)).alias("name"), F.lit("method").alias("symbol_kind"))
    seen = rows.select("path", at.alias("n"), F.explode(F.array(export, method)).alias("h")).filter("h.name IS NOT NULL")
    return _rows(seen, F.col("h.kind"), 0.85, F.col("h.name"), F.col("h.symbol_kind"), F.col("h.kind"), F.col("h.name"), F.col("n"), F.col("h.symbol_kind"), "ts-js-deep")


def block_kind(kind: Column) -> Column:
    """The symbol kind of a structural block, null where it is none."""
    has = lambda *xs: reduce(Column.__or__, (F.contains(kind, F.lit(x)) for x in xs))
    return F.when(has("class"), "class").when(has("interface"), "interface").when(has("enum"), "enum").when(has("type_alias") | (kind == "type"), "type").when(has("function", "signature"), "function").when(has("method"), "method").when(has("variable", "lexical"), "variable")


def block_name(content: Column, kind: Column) -> Column:
    first = F.substring(F.trim(F.substring_index(content, "\n", 1)), 1, 120)
    return F.coalesce(*[found(content, p) for p in BLOCK_NAMES], F.when(kind == "variable", first))


def blocks(rows: DataFrame) -> DataFrame:
    """Definitions of structural blocks (path, kind, content, start_line, end_line)."""
    kinded = rows.withColumn("_k", block_kind(F.col("kind"))).filter("_k IS NOT NULL")
    named = kinded.withColumn("_n", block_name(F.col("content"), F.col("_k"))).filter("_n IS NOT NULL")
    return _rows(named, "symbol_definition", 0.7, F.col("_n"), F.col("_k"), "generic", F.col("_k"), F.col("_n"), F.col("start_line").cast("string"), F.col("end_line").cast("string"))


def repository(docs: DataFrame, scripts: DataFrame, steps: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Config artifacts, tasks, workflows, their steps and their gates."""
    kind = artifact(F.col("path"))
    known = docs.withColumn("_a", kind).filter("_a IS NOT NULL")
    name = F.when(F.col("_a") == "nx-json", "nx").when(F.col("_a") == "package-json", F.coalesce(F.get_json_object("content", "$.name"), F.lit("package.json"))).otherwise(F.col("path"))
    sort = F.when(F.col("_a") == "nx-json", "workspace").when(F.col("_a") == "package-json", "package").when(F.col("_a") == "github-workflow", "workflow").otherwise(F.col("artifact_kind"))
    what = F.when(F.col("_a") == "github-workflow", "workflow").otherwise("config_artifact")
    of = lambda df, kind, name, sort: _rows(df, kind, 0.9, name, sort, kind, name, sort)
    parts = [of(known, what, name, sort), of(scripts, F.lit("task"), F.col("name"), F.lit("package-script")), of(steps, F.lit("workflow_step"), F.col("name"), F.lit("workflow-step"))]
    if gates is not None:
        parts.append(of(gates.filter("tool = 'workflow-step'"), F.lit("quality_gate"), F.col("tool"), F.lit("quality-gate")))
    return reduce(DataFrame.unionByName, parts)


def settle(*tables: DataFrame) -> DataFrame:
    """One observation per id: that of the last table that has it, and of equal ones the last by confidence and name."""
    every = reduce(DataFrame.unionByName, [t.withColumn("_t", F.lit(k)) for k, t in enumerate(tables)])
    return last_wins(every, ["evidence_id"], "_t", "confidence", "name").drop("_t")
