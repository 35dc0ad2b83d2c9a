"""Symbols: kinds, names, identity, dedupe, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import last_wins
from ..functions.text import content_hash, found, sha_id, trimmed

#: Names in TypeScript and JavaScript blocks, in order of precedence.
SCRIPT_NAMES = (
    ("class", r"(?:export\s+default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("enum", r"(?:export\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("type", r"(?:export\s+)?type\s+([A-Za-z_$][\w$]*)"),
    ("function", r"(?:export\s+default\s+)?(?:async\s+)?function\*?\s+([A-Za-z_$][\w$]*)"),
    ("function", r"(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    ("function", r"(?:export\s+)?(?:let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    ("variable", r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
)
#: Names in blocks of any language, in order.
GENERIC_NAMES = (
    r"(?:class|interface|enum|type|trait|struct)\s+([A-Za-z_$][\w$]*)",
    r"(?:function|func|def)\s+([A-Za-z_$][\w$]*)",
    r"(?:const|let|var|val)\s+([A-Za-z_$][\w$]*)",
    r"(?m)^([A-Za-z_$][\w$]*)\s*[:=(<{]",
)


def normalized_kind(kind: Column) -> Column:
    has = lambda s: F.contains(kind, F.lit(s))
    return (
        F.when(has("class"), "class").when(has("interface"), "interface").when(has("enum"), "enum")
        .when(has("type_alias") | (kind == "type"), "type").when(has("function") | has("signature"), "function")
        .when(has("variable") | has("lexical"), "variable").when(has("import"), "import").when(has("export"), "export")
        .when(has("statement_block"), "block").otherwise(F.regexp_replace(kind, "_declaration$", ""))
    )


def generic_name(content: Column, kind: Column) -> Column:
    first = F.substring(trimmed(F.substring_index(content, "\n", 1)), 1, 120)
    return F.coalesce(*[found(content, p) for p in GENERIC_NAMES], F.when(kind != "block", first))


def identity(content: Column, kind: Column, language: Column) -> Column:
    """Struct of kind and name, null where a block has no name."""
    base = normalized_kind(kind)
    script = [F.when(content.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(content, p, 1).alias("name"))) for k, p in SCRIPT_NAMES]
    name = generic_name(content, base)
    generic = F.when(name.isNotNull(), F.struct(base.alias("kind"), name.alias("name")))
    return F.when(language.isin("ts", "js"), F.coalesce(*script, generic)).otherwise(generic)


def symbols_of(blocks: DataFrame, project: str) -> DataFrame:
    """Symbol rows of blocks (path, kind, content, start_line, end_line, language, seq); rows with one id: the last wins."""
    named = blocks.withColumn("_id", identity(F.col("content"), F.col("kind"), F.col("language"))).filter("_id IS NOT NULL")
    rows = named.select(
        sha_id(project, F.col("path"), F.col("_id.kind"), F.col("_id.name"), F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("evidence_id"),
        F.col("_id.name").alias("name"), F.col("_id.kind").alias("kind"), "language", "path", "start_line", "end_line", content_hash(F.col("content")).alias("content_hash"), "seq", F.lit("file").alias("scope"),
    )
    return last_wins(rows, ["evidence_id"], "seq").drop("seq")


def ranked(symbols: DataFrame, query: str | None = None, kind: str | None = None, path: str | None = None, source_type: str | None = None) -> DataFrame:
    """Symbols that match, with confidence and score, in order of rank."""
    out = symbols
    for column, value in (("kind", kind), ("path", path), ("source_type", source_type)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if query is not None:
        low = query.lower()
        out = out.filter(F.coalesce(sum((F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low)).cast("int") for c in ("name", "container_name", "signature", "kind")), F.lit(0)), F.lit(0)) > 0)
    sure = F.coalesce(F.col("confidence") if "confidence" in symbols.columns else F.lit(None).cast("double"), F.when(F.col("signature").isNotNull(), 0.95).otherwise(0.75))
    same = lambda column, value: F.lit(0) if value is None else F.when(F.lower(F.col(column)) == value.lower(), 1).otherwise(0)
    points = 1000 * same("name", query) + 100 * same("path", path) + 10 * same("kind", kind)
    out = out.withColumn("confidence", sure).withColumn("score", points + F.col("confidence"))
    return out.orderBy(F.desc("score"), F.desc("confidence"), "path", "start_line", "kind", "name")


def ambiguous(symbols: DataFrame) -> DataFrame:
    """path, name, n, ambiguous: how many symbols of a file share a name."""
    n = F.count(F.lit(1))
    return symbols.groupBy("path", "name").agg(n.alias("n"), (n > 1).alias("ambiguous"))
