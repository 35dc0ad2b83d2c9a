"""Scanning and classifying files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension

#: What is ignored in any project, and the extensions that are read.
INTERNAL_IGNORES = (".git/**", "node_modules/**", "dist/**", ".claude/**", "coverage/**", "*.log")
DOC_EXTENSIONS = (".md", ".txt")
CODE_EXTENSIONS = (".c", ".cpp", ".cs", ".go", ".java", ".js", ".json", ".kt", ".mjs", ".php", ".py", ".rb", ".rs", ".scala", ".sh", ".swift", ".ts", ".unknownlang")
EXTENDED_EXTENSIONS = (".yml", ".yaml", ".tsx", ".jsx", ".mts", ".cts", ".cjs", ".kts", ".h", ".hpp")


def ignore_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over whole relative paths."""
    body = pattern.strip().rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i:]:
            end = body.index("]", i)
            out, i = out + body[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + "(?:/.*)?"


def ignored(path: Column, patterns: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a path is ignored; a later negated pattern takes paths back."""
    out = F.lit(False)
    lines = [*INTERNAL_IGNORES, *(p for p in patterns if p.strip() and not p.startswith("#"))]
    for p in lines:
        hit = path.rlike(f"^(?:{ignore_regex(p.lstrip('!'))})$")
        out = F.when(hit, not p.startswith("!")).otherwise(out)
    return out


def source_type(path: Column, extended: bool = False) -> Column:
    """doc, code or null."""
    code = CODE_EXTENSIONS + (EXTENDED_EXTENSIONS if extended else ())
    return F.when(extension(path).isin(*DOC_EXTENSIONS), "doc").when(extension(path).isin(*code), "code")


def artifact_kind(path: Column, source: Column) -> Column:
    name = basename(path)
    return (
        F.when(source == "doc", "doc")
        .when(name == "package-lock.json", "lockfile")
        .when(path.startswith(".github/workflows/"), "workflow")
        .when(name == "tsconfig.json", "schema")
        .when(path.startswith(".devcontainer/") | (name == ".lintstagedrc.json"), "config")
        .when(name.isin("package.json", "nx.json"), "config")
        .when(name.endswith(".test.ts") | name.endswith(".spec.ts"), "test")
        .when(name.endswith(".sh") | (name == "bash"), "script")
        .otherwise("code")
    )


def classify(files: DataFrame, patterns: tuple[str, ...] = (), max_bytes: int | None = None, skip_oversize: bool = True, extended: bool = False) -> DataFrame:
    """files (path, size_bytes, ...) with source_type, artifact_kind and skip_reason (ignored, unsupported, too_large or null)."""
    path = F.col("path")
    typed = files.withColumn("source_type", source_type(path, extended))
    typed = typed.withColumn("artifact_kind", F.when(F.col("source_type").isNotNull(), artifact_kind(path, F.col("source_type"))))
    large = F.lit(False) if max_bytes is None or not skip_oversize else (F.col("artifact_kind") == "lockfile") & (F.col("size_bytes") > max_bytes)
    reason = F.when(ignored(path, patterns), "ignored").when(F.col("source_type").isNull(), "unsupported").when(large, "too_large")
    return typed.withColumn("skip_reason", reason)


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    """A small file on the driver; Spark's own sources leave out names that begin with a dot."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ignore_lines(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> tuple[str, ...]:
    """The patterns of the ignore files at the root, in order; a missing file has none."""
    texts = (_read_text(spark, f"{root.rstrip('/')}/{name}") or "" for name in names)
    return tuple(x.strip() for t in texts for x in t.splitlines() if x.strip())


def top_level(spark: SparkSession, root: str, patterns: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Children of the root to read, and names of the folders there that are ignored as a whole: these are neither listed nor read. With a pattern that takes paths back, only the folders ignored in any project are left out."""
    lines = [*INTERNAL_IGNORES, *(p for p in patterns if p.strip() and not p.startswith("#"))]
    if any(p.startswith("!") for p in lines):
        lines = list(INTERNAL_IGNORES)
    known = [re.compile(f"^(?:{ignore_regex(p)})$") for p in lines if not p.startswith("*.")]
    fs, base = _fs(spark, root)
    read, left = [], []
    for s in fs.listStatus(base) if fs.exists(base) else ():
        name = s.getPath().getName()
        gone = s.isDirectory() and any(k.match(f"{name}/x") and k.match(f"{name}/x/y") for k in known)
        (left if gone else read).append(name if gone else s.getPath().toString())
    return read, left


HIDDEN = re.compile(r"(?:^|/)[._]")


def _hidden(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    """Paths of the files that Spark's sources leave out because a name on the way begins with a dot or an underscore. Names alone are listed, on the driver, as Spark does for the others."""
    found = []
    for path in paths:
        fs, p = _fs(spark, path)
        listed = spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().listLeafStatuses(fs, p).mkString("\n")
        found += re.findall(r"path=([^;\n]+); isDirectory=false", listed)
    base = _plain(root)
    return [x for x in found if HIDDEN.search(_plain(x)[len(base) + 1 :])]


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path).rstrip("/")


def _read_files(batches):
    """Content of files by their paths, for names that Spark's sources don't read."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        contents = []
        for path in batch.column(0).to_pylist():
            store, at = (fs.LocalFileSystem(), _plain(path)) if "://" not in path or path.startswith("file:") else fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                contents.append(f.read())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], names=["path", "length", "content"])


def read_tree(spark: SparkSession, root: str, patterns: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), size_bytes, content of every file below a root, hidden ones too, but for folders at the root that are ignored as a whole. Bytes that are no UTF-8 read as the replacement character; ``binary`` tells. Without a selected content only names and sizes are read."""
    paths, _ = top_level(spark, root, patterns)
    if not paths:
        return spark.createDataFrame([], "path string, size_bytes long, content string, binary boolean")
    parts = []
    if shown := [p for p in paths if not HIDDEN.search(p.rsplit("/", 1)[1])]:
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(shown).select("path", "length", "content"))
    if hidden := _hidden(spark, root, paths):
        listed = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(max(1, min(200, len(hidden) // 100)))
        parts.append(listed.mapInArrow(_read_files, "path string, length long, content binary"))
    if not parts:
        return spark.createDataFrame([], "path string, size_bytes long, content string, binary boolean")
    files = reduce(DataFrame.unionByName, parts)
    whole, text = F.regexp_replace("path", "^file:/*", "/"), F.col("content").cast("string")
    return files.select(F.substring(whole, F.lit(len(_plain(root)) + 2), F.length("path")).alias("path"), F.col("length").alias("size_bytes"), F.make_valid_utf8(text).alias("content"), (~F.is_valid_utf8(text)).alias("binary")).filter("path <> ''")


def directories(files: DataFrame) -> DataFrame:
    """path of every folder that holds a file, at any depth."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).filter("path <> ''").distinct()


def scan(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = (".gitignore",), patterns: tuple[str, ...] = (), **options) -> tuple[DataFrame, DataFrame]:
    """Candidates and skipped paths of a tree. The ignore files of the tree come first, then the patterns given."""
    lines = (*ignore_lines(spark, root, ignore_files), *patterns)
    seen = classify(read_tree(spark, root, lines), patterns=lines, **options)
    folders = directories(seen.select("path")).withColumn("reason", F.when(ignored(F.col("path"), lines), "ignored").otherwise("directory"))
    whole = spark.createDataFrame([(x, "ignored") for x in top_level(spark, root, lines)[1]], "path string, reason string")
    skipped = seen.filter("skip_reason IS NOT NULL").select("path", F.col("skip_reason").alias("reason"))
    return seen.filter("skip_reason IS NULL").drop("skip_reason"), skipped.unionByName(folders).unionByName(whole)


def in_order(candidates: DataFrame) -> DataFrame:
    """Candidates by path, in binary order."""
    return candidates.orderBy("path")
