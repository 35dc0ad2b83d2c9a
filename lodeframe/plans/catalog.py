"""Every named query of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rows, text
from ..operators import analysis, chunk, embed, facts, graph, parse, partition, retrieve, symbols
from ..operators.analysis import Anchor
from ..sources import scan
from ..streaming import watch
from ..streaming.state import State
from .corpus import duck_with, view

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    def put(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = (duck_with(*views) + ("," if sql.lstrip().startswith("+") else "") + " " + sql.lstrip().lstrip("+")) if views else sql
        return f

    return put


def queries() -> dict:
    from . import inventory  # noqa: F401 - registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scan -----------------------------------------------------------------
EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
SRC = f"CASE WHEN {EXT} IN ('.md', '.txt') THEN 'doc' WHEN {EXT} IN ('.c', '.cpp', '.cs', '.go', '.java', '.js', '.json', '.kt', '.mjs', '.php', '.py', '.rb', '.rs', '.scala', '.sh', '.swift', '.ts', '.unknownlang') THEN 'code' END"
BASE = "string_split(path, '/')[-1]"
KIND = f"CASE WHEN source_type = 'doc' THEN 'doc' WHEN {BASE} = 'package-lock.json' THEN 'lockfile' WHEN starts_with(path, '.github/workflows/') THEN 'workflow' WHEN {BASE} = 'tsconfig.json' THEN 'schema' WHEN starts_with(path, '.devcontainer/') THEN 'config' WHEN {BASE} IN ('package.json', 'nx.json') THEN 'config' WHEN {BASE} LIKE '%.test.ts' OR {BASE} LIKE '%.spec.ts' THEN 'test' WHEN {BASE} LIKE '%.sh' THEN 'script' WHEN source_type IS NOT NULL THEN 'code' END"
IGN = r"regexp_matches(path, '^(\.git|node_modules|dist|\.claude|coverage)/') OR path LIKE '%.log'"
SEEN = f"+ s AS (SELECT *, {SRC} AS source_type FROM v_candidates), k AS (SELECT *, {KIND} AS artifact_kind FROM s), c AS (SELECT *, CASE WHEN {IGN} THEN 'ignored' WHEN source_type IS NULL THEN 'unsupported' WHEN artifact_kind = 'lockfile' AND size_bytes > 2000 THEN 'too_large' END AS skip_reason FROM k)"


def _classified(spark, d):
    return scan.classify(view(spark, d, "v_candidates"), max_bytes=2000)


@query(SEEN + " SELECT path, source_type FROM c", "v_candidates")
def scan_source_type(spark, d):
    return _classified(spark, d).select("path", "source_type")


@query(SEEN + " SELECT path, artifact_kind FROM c", "v_candidates")
def scan_artifact_kind(spark, d):
    return _classified(spark, d).select("path", "artifact_kind")


@query(SEEN + f" SELECT path, size_bytes FROM c WHERE NOT ({IGN})", "v_candidates")
def scan_ignore_filter(spark, d):
    return view(spark, d, "v_candidates").filter(~scan.ignored(F.col("path"))).select("path", F.col("size_bytes").cast("long").alias("size_bytes"))


@query(SEEN + " SELECT path, size_bytes FROM c WHERE skip_reason = 'too_large'", "v_candidates")
def scan_oversize_skip(spark, d):
    return _classified(spark, d).filter("skip_reason = 'too_large'").select("path", F.col("size_bytes").cast("long").alias("size_bytes"))


@query(SEEN + " SELECT coalesce(skip_reason, 'candidate') AS reason, count(*)::BIGINT AS n FROM c GROUP BY 1", "v_candidates")
def scan_skip_reason_counts(spark, d):
    return _classified(spark, d).groupBy(F.coalesce("skip_reason", F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# -- partitions, sections, parsing ------------------------------------------
LINES = """+ l AS (SELECT path, artifact_kind, CASE WHEN artifact_kind = 'lockfile' THEN 2000 ELSE 8000 END AS mx, string_split(content, chr(10)) AS ls, content FROM v_docs WHERE source_type = 'code'),
  r AS (WITH RECURSIVE w AS (SELECT path, mx, ls, 0 AS i, 0 AS win, 0 AS cur FROM l WHERE length(content) > mx
    UNION ALL SELECT path, mx, ls, i + 1, CASE WHEN cur > 0 AND cur + length(ls[i + 1]) + 1 > mx THEN win + 1 ELSE win END, CASE WHEN cur > 0 AND cur + length(ls[i + 1]) + 1 > mx THEN length(ls[i + 1]) + 1 ELSE cur + length(ls[i + 1]) + 1 END FROM w WHERE i < len(ls)) SELECT * FROM w WHERE i > 0),
  g AS (SELECT path, win, min(i) AS start_line, max(i) AS end_line, trim(string_agg(ls[i], chr(10) ORDER BY i), chr(10) || ' ') AS content FROM r GROUP BY path, win)"""


@query(LINES + " SELECT path, (row_number() OVER (PARTITION BY path ORDER BY start_line) - 1)::BIGINT AS idx, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, sha256(content) AS content_hash FROM g WHERE content <> ''", "v_docs")
def chunk_line_windows(spark, d):
    docs = view(spark, d, "v_docs").filter("source_type = 'code'")
    limit = F.when(F.col("artifact_kind") == "lockfile", 2000).otherwise(8000)
    out = partition.line_windows(docs.withColumn("mx", limit).filter(F.char_length("content") > F.col("mx")).withColumnRenamed("content", "body"), "body", F.col("mx"))
    return out.select("path", F.col("window_index").cast("long").alias("idx"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), text.content_hash(F.col("content")).alias("content_hash"))


@query(LINES + """, n AS (SELECT path, count(*)::BIGINT AS n FROM g WHERE content <> '' GROUP BY path),
  dd AS (SELECT path, content AS body FROM v_docs WHERE source_type = 'doc'), ds AS (SELECT path, ceil(length(trim(body, chr(10) || ' ')) / 8000.0)::BIGINT AS n, length(body) AS len FROM dd)
  SELECT v.path, CASE WHEN v.source_type = 'code' THEN coalesce(n.n, 1) WHEN ds.len <= 8000 THEN 1 ELSE ds.n END AS n FROM v_docs v LEFT JOIN n USING (path) LEFT JOIN ds ON v.path = ds.path""", "v_docs")
def doc_partition_count(spark, d):
    return partition.partition_documents(view(spark, d, "v_docs")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(LINES + """, n AS (SELECT DISTINCT path FROM g) SELECT v.path, CASE WHEN (v.source_type = 'code' AND n.path IS NOT NULL) OR (v.source_type = 'doc' AND length(content) > 8000) THEN 'partial' ELSE 'complete' END AS status FROM v_docs v LEFT JOIN n USING (path)""", "v_docs")
def partition_status_rollup(spark, d):
    return partition.status_rollup(partition.partition_documents(view(spark, d, "v_docs")))


SECTIONS = r"+ s AS (SELECT path, list_filter(list_transform(string_split(replace(content, chr(10) || '# ', chr(1) || '# '), chr(1)), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') AS parts FROM v_sections), e AS (SELECT path, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS idx FROM s)"


@query(SECTIONS + " SELECT path, idx::BIGINT AS idx, sha256(content) AS content_hash FROM e", "v_sections")
def doc_section_split(spark, d):
    return chunk.doc_sections(view(spark, d, "v_sections")).select("path", F.col("doc_offset").cast("long").alias("idx"), text.content_hash(F.col("content")).alias("content_hash"))


@query(SECTIONS + r" SELECT path, idx::BIGINT AS idx, nullif(trim(regexp_extract(content, '(?m)^#\s+(.+)$', 1)), '') AS section FROM e", "v_sections")
def section_titles(spark, d):
    return chunk.doc_sections(view(spark, d, "v_sections")).select("path", F.col("doc_offset").cast("long").alias("idx"), "section")


@query(r"""WITH p AS (SELECT 'w/' || page_id || '.ts' AS path, regexp_replace(regexp_replace(html, '<a[^>]*href=', 'import ', 'g'), '["'']([^"''>]*)["'']', '"\1"', 'g') AS content FROM pages)
  SELECT path, specifier, count(*)::BIGINT AS n, NOT starts_with(specifier, '.') AS is_package FROM (SELECT path, unnest(regexp_extract_all(content, '(?:import|export)\s+(?:[^"'']+?\s+from\s+)?["'']([^"'']+)["'']', 1)) AS specifier FROM p) GROUP BY ALL""")
def import_extract(spark, d):
    html = F.regexp_replace(F.regexp_replace("html", "<a[^>]*href=", "import "), "[\"']([^\"'>]*)[\"']", '"$1"')
    docs = table(spark, d, "pages").select(F.concat(F.lit("w/"), F.col("page_id"), F.lit(".ts")).alias("path"), html.alias("content"))
    return parse.imports(docs).groupBy("path", "specifier", "is_package").agg(F.count(F.lit(1)).alias("n"))


PKG = """WITH f AS (SELECT 'x/' || c_custkey || '/package.json' AS path, c_name AS package_name, 's' || (c_custkey % 7) AS a, 'lint:' || c_nationkey AS b, c_custkey FROM customer)"""


def _packages(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("x/"), F.col("c_custkey"), F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('", "scripts": {"s'), F.col("c_custkey") % 7, F.lit('": "npm run lint:'), F.col("c_nationkey"), F.lit('", "lint:'), F.col("c_nationkey"), F.lit('": "eslint"}, "dependencies": {"d'), F.col("c_nationkey"), F.lit('": "1"}, "devDependencies": {"e'), F.col("c_custkey") % 3, F.lit('": "2"}}')).alias("content"))


@query(PKG + " SELECT path, package_name, a AS name, 'npm run ' || b AS command FROM f UNION ALL SELECT path, package_name, b, 'eslint' FROM f")
def json_scripts(spark, d):
    return parse.package_scripts(_packages(spark, d)).drop("place")


@query(PKG + " SELECT path, package_name, 'd' || split_part(b, ':', 2) AS name, '1' AS version, 0::BIGINT AS place FROM f UNION ALL SELECT path, package_name, 'e' || (c_custkey % 3), '2', 1 FROM f")
def json_dependencies(spark, d):
    return parse.package_dependencies(_packages(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


FLOWS = """, fl AS (SELECT '.github/workflows/' || s_suppkey || '.yml' AS path, 'test ' || s_nationkey AS name, 'npm run test:' || s_suppkey AS command, 'test:' || s_suppkey AS script_name FROM supplier UNION ALL SELECT '.github/workflows/' || s_suppkey || '.yml', 'make all', 'make all', NULL FROM supplier)"""


def _flow_steps(spark, d):
    s = table(spark, d, "supplier")
    text_ = F.concat(F.lit("jobs:\n  - name: test "), F.col("s_nationkey"), F.lit("\n    run: npm run test:"), F.col("s_suppkey"), F.lit("\r\n    run: make all\n"))
    return parse.workflow_steps(parse.document_lines(s.select(F.concat(F.lit(".github/workflows/"), F.col("s_suppkey"), F.lit(".yml")).alias("path"), text_.alias("content"))))


@query(PKG + FLOWS + " SELECT path, 'package-script' AS tool, b AS name, 'eslint' AS command FROM f UNION ALL SELECT path, 'workflow-step', name, command FROM fl")
def quality_gate_filter(spark, d):
    return parse.quality_gates(parse.package_scripts(_packages(spark, d)), _flow_steps(spark, d)).select("path", "tool", "name", "command")


def _flow_lines(spark, d):
    li = table(spark, d, "lineitem")
    line = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("  - name: step "), F.col("l_shipdate").cast("date").cast("string"))).when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("    run: npm run t"), F.col("l_partkey"))).otherwise(F.lit("    run: make all"))
    return li.select(F.concat(F.lit("f/"), F.col("l_orderkey")).alias("path"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("place"), line.alias("line")).groupBy("path", "place").agg(F.min("line").alias("line"))


@query(r"""WITH l AS (SELECT 'f/' || l_orderkey AS path, l_linenumber * 100000 + l_suppkey AS place, min(CASE WHEN l_linenumber % 3 = 1 THEN 'step ' || l_shipdate::DATE END) AS nm, min(CASE WHEN l_linenumber % 3 = 2 THEN 'npm run t' || l_partkey WHEN l_linenumber % 3 = 0 THEN 'make all' END) AS run FROM lineitem GROUP BY 1, 2),
  g AS (SELECT *, count(run) OVER (PARTITION BY path ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM l),
  h AS (SELECT *, last_value(nm IGNORE NULLS) OVER (PARTITION BY path, grp ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lastn FROM g)
  SELECT path, place, run AS command, coalesce(lastn, run) AS name, nullif(regexp_extract(run, 'npm\s+run\s+([\w:-]+)', 1), '') AS script_name FROM h WHERE run IS NOT NULL""")
def workflow_step_fill(spark, d):
    return parse.workflow_steps(_flow_lines(spark, d))


# -- chunks and embeddings --------------------------------------------------
@query("+ c AS (SELECT path, content, unnest(range(0, greatest(0, ceil((length(content) - 1000) / 900.0))::BIGINT + 1)) AS i FROM v_docs WHERE length(content) > 0), w AS (SELECT path, i, trim(substr(content, i * 900 + 1, 1000), ' ') AS window FROM c) SELECT path, (row_number() OVER (PARTITION BY path ORDER BY i) - 1)::BIGINT AS idx, sha256(window) AS content_hash FROM w WHERE window <> ''".replace("window", "win"), "v_docs")
def chunk_char_windows(spark, d):
    return chunk.char_windows(view(spark, d, "v_docs"), "content", 1000, 100).select("path", F.col("window_index").cast("long").alias("idx"), text.content_hash(F.col("window")).alias("content_hash"))


IDENTITY = SECTIONS + r", t AS (SELECT *, nullif(trim(regexp_extract(content, '(?m)^#\s+(.+)$', 1)), '') AS section, sha256(content) AS content_hash FROM e), k AS (SELECT *, substr(sha256(path || ':' || coalesce(section, 'section') || ':' || idx || ':' || content_hash), 1, 24) AS evidence_id FROM t)"


def _identified(spark, d):
    rows_ = chunk.doc_sections(view(spark, d, "v_sections")).withColumns({"start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")})
    return chunk.identify(rows_, "project-a")


@query(IDENTITY + " SELECT path, content_hash, evidence_id FROM k", "v_sections")
def chunk_identity(spark, d):
    return _identified(spark, d).select("path", "content_hash", "evidence_id")


@query(IDENTITY + " SELECT path, sha256('project-a:' || path || ':' || evidence_id || ':' || content_hash) AS chunk_key FROM k", "v_sections")
def chunk_key(spark, d):
    return _identified(spark, d).select("path", "chunk_key")


@query(LINES + """, p AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY start_line) - 1) AS idx, start_line AS a, end_line AS b FROM g WHERE content <> ''), q AS (SELECT path, unnest(range(1, len(ls) + 1, 7)) AS start_line, ls FROM l WHERE length(content) > mx),
  c AS (SELECT path, start_line, least(start_line + 2, len(ls)) AS end_line FROM q)
  SELECT c.path, c.start_line::BIGINT AS start_line, c.end_line::BIGINT AS end_line, coalesce(min(p.idx), -1)::BIGINT AS partition_index FROM c LEFT JOIN p ON c.path = p.path AND c.start_line >= a AND c.end_line <= b GROUP BY ALL""", "v_docs")
def chunk_partition_range_join(spark, d):
    docs = view(spark, d, "v_docs").filter("source_type = 'code'")
    parts = partition.partition_documents(docs).filter("total > 1 OR status = 'partial'")
    many = docs.join(parts.select("path").distinct(), "path", "left_semi")
    n = F.size(F.split("content", "\n"))
    spans = many.select("path", n.alias("n"), F.explode(F.sequence(F.lit(1), n, F.lit(7))).alias("start_line")).select("path", "start_line", F.least(F.col("start_line") + 2, F.col("n")).alias("end_line"))
    none = F.lit(None)
    pieces = spans.withColumns({"chunk_key": F.concat_ws(":", "path", F.col("start_line").cast("string")), "doc_offset": none.cast("int"), "section": none.cast("string")})
    hit = chunk.attribute(pieces, partition.partition_documents(docs))
    return hit.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.coalesce("partition_index", F.lit(-1)).cast("long").alias("partition_index"))


@query("SELECT doc_id, i::BIGINT AS i, round(CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER) / 255.0, 6)::DOUBLE AS x FROM documents, range(16) r(i)")
def embed_deterministic(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(embed.deterministic(F.col("text"))).alias("i", "x"))
    return docs.select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT vec_id, i::BIGINT AS i, round(CASE WHEN i <= 64 THEN embedding[i] ELSE 0 END::DOUBLE, 5) + 0.0 AS x FROM embeddings, range(1, 81) r(i) WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, i, round(embedding[i]::DOUBLE, 5) + 0.0 FROM embeddings, range(1, 33) r(i) WHERE vec_id % 2 = 1")
def embed_dim_fit(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    fitted = F.when(F.col("vec_id") % 2 == 0, embed.fit(F.col("v"), 80)).otherwise(embed.fit(F.col("v"), 32))
    return e.select("vec_id", F.posexplode(fitted).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), (F.round("x", 5) + 0.0).alias("x"))  # no negative zero


@query("SELECT l.doc_id AS evidence_id, coalesce(len(e.embedding), 0)::BIGINT AS dims FROM labels l LEFT JOIN embeddings e ON l.doc_id = e.vec_id AND e.label < 5")
def embed_join_missing(spark, d):
    chunks = table(spark, d, "labels").select(F.col("doc_id").alias("evidence_id"))
    vectors = table(spark, d, "embeddings").filter("label < 5").select(F.col("vec_id").alias("evidence_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return embed.attach(chunks, vectors).select("evidence_id", F.size("embedding").cast("long").alias("dims"))


# -- retrieval --------------------------------------------------------------
DIST = "list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
CTX = "artifact_kind IN ('config', 'doc', 'lockfile', 'schema', 'script', 'workflow')"
KNN = f"+ q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT v.*, {DIST} AS distance FROM v_chunks v, q), t AS (SELECT *, 1 / (1 + distance) AS score, {CTX} AS ctx FROM s)"


def _vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query(KNN + " SELECT chunk_key, round(distance, 6) AS distance FROM t ORDER BY score DESC, chunk_key LIMIT 10", "v_chunks")
def knn_topk(spark, d):
    return retrieve.search(view(spark, d, "v_chunks"), _vector(spark, d), 10).select("chunk_key", F.round("distance", 6).alias("distance"))


@query(KNN + " SELECT chunk_key, path, artifact_kind, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, ctx DESC, chunk_key)::BIGINT AS place FROM (SELECT * FROM t ORDER BY score DESC, chunk_key LIMIT 50)", "v_chunks")
def knn_scored_reranked(spark, d):
    from pyspark.sql import Window

    top = retrieve.search(view(spark, d, "v_chunks"), _vector(spark, d), 50)
    place = F.row_number().over(Window.orderBy(*retrieve.ranking())).cast("long")  # over 50 rows
    return top.select("chunk_key", "path", "artifact_kind", F.round("score", 6).alias("score"), place.alias("place"))


@query(f"+ q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT v.*, query_id, {DIST} AS distance FROM v_chunks v, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + distance) DESC, chunk_key) AS near FROM s) SELECT query_id, chunk_key, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + distance) DESC, {CTX} DESC, chunk_key)::BIGINT AS rank FROM t WHERE near <= 10", "v_chunks")
def knn_batch_queries(spark, d):
    q = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.search_each(view(spark, d, "v_chunks"), q, 10).select("query_id", "chunk_key", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, substr(text, 1, 500) AS snippet FROM documents")
def search_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieve.snippet(F.col("text")).alias("snippet"))


# -- symbols ----------------------------------------------------------------
NK = "CASE WHEN contains(k, 'class') THEN 'class' WHEN contains(k, 'interface') THEN 'interface' WHEN contains(k, 'enum') THEN 'enum' WHEN contains(k, 'type_alias') OR k = 'type' THEN 'type' WHEN contains(k, 'function') OR contains(k, 'signature') THEN 'function' WHEN contains(k, 'variable') OR contains(k, 'lexical') THEN 'variable' WHEN contains(k, 'import') THEN 'import' WHEN contains(k, 'export') THEN 'export' WHEN contains(k, 'statement_block') THEN 'block' ELSE regexp_replace(k, '_declaration$', '') END"
NODE_KINDS = ["class_declaration", "abstract_class_declaration", "interface_declaration", "enum_declaration", "type_alias_declaration", "type", "function_declaration", "method_signature", "variable_declaration", "lexical_declaration", "import_statement", "export_statement", "statement_block", "module_declaration"]
KLIST = "[" + ", ".join(f"'{k}'" for k in NODE_KINDS) + "]"


def _kinded(spark, d):
    kinds = F.array(*map(F.lit, NODE_KINDS))
    return table(spark, d, "part").withColumn("k", F.element_at(kinds, (F.col("p_partkey") % len(NODE_KINDS) + 1).cast("int")))


@query(f"WITH p AS (SELECT p_partkey, {KLIST}[p_partkey % {len(NODE_KINDS)} + 1] AS k FROM part) SELECT p_partkey, {NK} AS kind FROM p")
def symbol_kind_normalize(spark, d):
    return _kinded(spark, d).select("p_partkey", symbols.normalized_kind(F.col("k")).alias("kind"))


BLOCK = "CASE p_size % 7 WHEN 0 THEN 'export class ' || nm || ' {}' WHEN 1 THEN 'export const ' || nm || ' = 1;' WHEN 2 THEN 'const ' || nm || ' = (a) => a;' WHEN 3 THEN 'export async function ' || nm || '() {}' WHEN 4 THEN 'interface ' || nm || ' {}' WHEN 5 THEN 'import { a } from \"b\"' ELSE 'type ' || nm || ' = string' END"
NAMED = "CASE p_size % 7 WHEN 5 THEN 'import' ELSE nm END"
NKIND = f"CASE p_size % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'variable' WHEN 2 THEN 'function' WHEN 3 THEN 'function' WHEN 4 THEN 'interface' WHEN 5 THEN {NK} ELSE 'type' END"
SYMS = f"WITH p AS (SELECT *, replace(p_name, ' ', '_') AS nm, {KLIST}[p_partkey % {len(NODE_KINDS)} + 1] AS k FROM part), b AS (SELECT *, {NAMED} AS name, {NKIND} AS kind, 'm/' || (p_partkey % 50) || '.ts' AS path FROM p), s AS (SELECT sha256('project-a:' || path || ':' || kind || ':' || name || ':' || p_size || ':' || (p_size + 2)) AS evidence_id, * FROM b WHERE NOT (p_size % 7 = 5 AND name IS NULL))"


def _blocks(spark, d):
    p = _kinded(spark, d).withColumn("nm", F.replace("p_name", F.lit(" "), F.lit("_")))
    n = F.col("p_size") % 7
    make = lambda a, b: F.concat(F.lit(a), F.col("nm"), F.lit(b))
    content = F.when(n == 0, make("export class ", " {}")).when(n == 1, make("export const ", " = 1;")).when(n == 2, make("const ", " = (a) => a;")).when(n == 3, make("export async function ", "() {}")).when(n == 4, make("interface ", " {}")).when(n == 5, F.lit('import { a } from "b"')).otherwise(make("type ", " = string"))
    return p.select(F.concat(F.lit("m/"), F.col("p_partkey") % 50, F.lit(".ts")).alias("path"), F.col("k").alias("kind"), content.alias("content"), F.col("p_size").alias("start_line"), (F.col("p_size") + 2).alias("end_line"), F.lit("ts").alias("language"), F.col("p_partkey").alias("seq"))


@query(SYMS + " SELECT p_partkey AS seq, name, kind FROM b")
def symbol_identity(spark, d):
    b = _blocks(spark, d).withColumn("i", symbols.identity(F.col("content"), F.col("kind"), F.col("language")))
    return b.select("seq", "i.name", "i.kind")


@query(SYMS + " SELECT evidence_id, name, kind, path, p_size::BIGINT AS start_line FROM s QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY p_partkey DESC) = 1")
def symbol_dedupe_last(spark, d):
    return symbols.symbols_of(_blocks(spark, d), "project-a").select("evidence_id", "name", "kind", "path", F.col("start_line").cast("long").alias("start_line"))


RANK = "SELECT evidence_id, path, name, kind, round({score} + CASE WHEN signature IS NOT NULL THEN 0.95 ELSE 0.75 END, 6)::DOUBLE AS score FROM v_symbols WHERE {where}"


@query(RANK.format(score="10 * (kind = 'function')::INT", where="kind = 'function'"), "v_symbols")
def symbols_ranked(spark, d):
    return symbols.ranked(view(spark, d, "v_symbols"), kind="function").select("evidence_id", "path", "name", "kind", F.round("score", 6).alias("score"))


@query(RANK.format(score="1000 * (lower(name) = 'ring')::INT + 100 * (path = 'src/m1.ts')::INT", where="path = 'src/m1.ts' AND (contains(lower(name), 'ring') OR contains(lower(coalesce(container_name, '')), 'ring') OR contains(lower(coalesce(signature, '')), 'ring') OR contains(kind, 'ring'))"), "v_symbols")
def symbols_filtered(spark, d):
    return symbols.ranked(view(spark, d, "v_symbols"), query="RING", path="src/m1.ts").select("evidence_id", "path", "name", "kind", F.round("score", 6).alias("score"))


@query(" SELECT path, name, count(*)::BIGINT AS n, (count(*) > 1)::BOOLEAN AS ambiguous FROM v_symbols GROUP BY path, name", "v_symbols")
def symbol_ambiguous(spark, d):
    return symbols.ambiguous(view(spark, d, "v_symbols"))


# -- facts ------------------------------------------------------------------
@query(" SELECT sha256(path || ':symbol_definition:' || kind || ':' || name) AS fact_id, path, kind AS symbol_kind, name, 1.0::DOUBLE AS confidence FROM v_symbols QUALIFY row_number() OVER (PARTITION BY path, kind, name ORDER BY seq DESC) = 1", "v_symbols")
def fact_symbol_definition(spark, d):
    f = facts.settle_facts(facts.symbol_definitions(view(spark, d, "v_symbols")))
    return f.select("fact_id", "path", facts.payload("symbolKind").alias("symbol_kind"), facts.payload("name").alias("name"), "confidence")


LINKS = r"WITH i AS (SELECT 'w/' || page_id AS path, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS specifier FROM pages), d AS (SELECT DISTINCT path, specifier, NOT starts_with(specifier, '/') AS is_package FROM i)"


def _links(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("w/"), F.col("page_id")).alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("specifier"))
    return p.withColumn("is_package", ~F.col("specifier").startswith("/"))


@query(LINKS + " SELECT sha256(path || ':file_import:' || specifier) AS fact_id, path, specifier, CASE WHEN is_package THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM d")
def fact_file_import(spark, d):
    return facts.settle_facts(facts.file_imports(_links(spark, d))).select("fact_id", "path", facts.payload("specifier").alias("specifier"), "confidence")


def _pkg_facts(spark, d):
    docs = _packages(spark, d)
    scripts = parse.package_scripts(docs)
    gates = parse.quality_gates(scripts, _flow_steps(spark, d))
    return facts.settle_facts(facts.package_dependencies(parse.package_dependencies(docs)), facts.package_scripts(scripts), facts.workspace_tasks(scripts), facts.quality_gates(gates))


@query(PKG + ", x AS (SELECT path, 'd' || split_part(b, ':', 2) AS name FROM f UNION ALL SELECT path, 'e' || (c_custkey % 3) FROM f) SELECT sha256(path || ':package_dependency:' || name) AS fact_id, path, name FROM x")
def fact_package_dependency(spark, d):
    return _pkg_facts(spark, d).filter("kind = 'package_dependency'").select("fact_id", "path", facts.payload("dependencyName").alias("name"))


@query(PKG + ", x AS (SELECT path, a AS name, 'npm run ' || b AS command FROM f UNION ALL SELECT path, b, 'eslint' FROM f) SELECT sha256(path || ':package_script:' || name) AS fact_id, path, name, command FROM x")
def fact_package_script(spark, d):
    return _pkg_facts(spark, d).filter("kind = 'package_script'").select("fact_id", "path", facts.payload("scriptName").alias("name"), facts.payload("command").alias("command"))


@query(PKG + FLOWS + " SELECT sha256(path || ':quality_gate:package-script:eslint') AS fact_id, path, 'eslint' AS command, b AS script FROM f UNION ALL SELECT sha256(path || ':quality_gate:workflow-step:' || command), path, command, script_name FROM fl")
def fact_quality_gate(spark, d):
    return _pkg_facts(spark, d).filter("kind = 'quality_gate'").select("fact_id", "path", facts.payload("command").alias("command"), facts.payload("scriptName").alias("script"))


@query(PKG + ", x AS (SELECT path, a AS name, 'npm run ' || b AS command FROM f UNION ALL SELECT path, b, 'eslint' FROM f) SELECT sha256(path || ':workspace_task:' || name) AS fact_id, path, command FROM x")
def fact_workspace_task(spark, d):
    return _pkg_facts(spark, d).filter("kind = 'workspace_task'").select("fact_id", "path", facts.payload("command").alias("command"))


PAIRS = "+ p AS (SELECT a.path, a.evidence_id AS x, b.evidence_id AS y, a.kind = 'function' AND b.kind = 'function' AS calls FROM v_symbols a JOIN v_symbols b ON a.path = b.path AND a.evidence_id <> b.evidence_id)"


@query(PAIRS + " SELECT path, 'symbol-references-symbol-candidate' AS kind, count(*)::BIGINT AS n, min(sha256(path || ':symbol-references-symbol-candidate:' || x || ':' || y)) AS least FROM p GROUP BY path UNION ALL SELECT path, 'caller-callee-candidate', count(*), min(sha256(path || ':caller-callee-candidate:' || x || ':' || y)) FROM p WHERE calls GROUP BY path", "v_symbols")
def derived_symbol_pairs(spark, d):
    return facts.symbol_pairs(view(spark, d, "v_symbols")).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("derived_fact_id").alias("least"))


JSON = """'{"fromId":"' || a || '","fromKind":"' || ak || '","fromLabel":"' || a || '","toId":"' || b || '","toKind":"' || bk || '","toLabel":"' || b || '"}'"""


@query(LINKS + f", e AS (SELECT path, CASE WHEN is_package THEN 'file-imports-package' ELSE 'file-imports-file' END AS kind, path AS a, 'File' AS ak, specifier AS b, CASE WHEN is_package THEN 'Package' ELSE 'File' END AS bk FROM d) SELECT sha256(path || ':' || kind || ':' || {JSON}) AS derived_fact_id, kind, a AS from_id, b AS to_id FROM e")
def derived_imports(spark, d):
    return facts.derive(facts.settle_facts(facts.file_imports(_links(spark, d)))).select("derived_fact_id", "kind", "from_id", "to_id")


DERIVED_PKG = PKG + FLOWS + f""", e AS (
  SELECT path, 'package-depends-on-package' AS kind, package_name AS a, 'Package' AS ak, 'd' || split_part(b, ':', 2) AS b, 'Package' AS bk FROM f UNION ALL SELECT path, 'package-depends-on-package', package_name, 'Package', 'e' || (c_custkey % 3), 'Package' FROM f
  UNION ALL SELECT path, 'task-runs-command', a, 'Task', 'npm run ' || b, 'Command' FROM f UNION ALL SELECT path, 'task-runs-command', b, 'Task', 'eslint', 'Command' FROM f
  UNION ALL SELECT path, 'quality-gate-runs-command', 'package-script', 'QualityGate', 'eslint', 'Command' FROM f UNION ALL SELECT path, 'quality-gate-runs-script-candidate', 'package-script', 'QualityGate', b, 'PackageScript' FROM f
  UNION ALL SELECT path, 'quality-gate-runs-script-candidate', a, 'PackageScript', b, 'PackageScript' FROM f
  UNION ALL SELECT path, 'quality-gate-runs-command', 'workflow-step', 'QualityGate', command, 'Command' FROM fl UNION ALL SELECT path, 'quality-gate-runs-script-candidate', 'workflow-step', 'QualityGate', script_name, 'PackageScript' FROM fl WHERE script_name IS NOT NULL)
  SELECT sha256(path || ':' || kind || ':' || {JSON}) AS derived_fact_id, kind, path, a AS from_id, b AS to_id FROM e"""


@query(DERIVED_PKG)
def derived_package_facts(spark, d):
    return facts.derive(_pkg_facts(spark, d)).select("derived_fact_id", "kind", "path", "from_id", "to_id")


@query(" SELECT kind, count(*)::BIGINT AS n, count(DISTINCT path)::BIGINT AS paths, round(sum(confidence), 3)::DOUBLE AS total FROM v_facts GROUP BY kind", "v_facts")
def derived_kind_counts(spark, d):
    return facts.kind_counts(view(spark, d, "v_facts"))


# -- sets -------------------------------------------------------------------
DIFF = "+ x AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'stale' WHEN n.fingerprint = o.fingerprint THEN 'unchanged' ELSE 'changed' END AS status FROM v_manifest_now n FULL JOIN v_manifest_old o ON n.path = o.path) SELECT path FROM x WHERE status = "


def _diff(status):
    def run(spark, d):
        return rows.diff(view(spark, d, "v_manifest_now"), view(spark, d, "v_manifest_old")).filter(F.col("status") == status).select("path")

    return run


for _s in ("unchanged", "changed", "new", "stale"):
    query(DIFF + f"'{_s}'", "v_manifest_now", "v_manifest_old", name=f"manifest_{_s}")(_diff(_s))


@query("+ n AS (SELECT path, fingerprint FROM v_manifest_now) SELECT path, fingerprint FROM v_manifest_old WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n", "v_manifest_now", "v_manifest_old")
def upsert_by_path(spark, d):
    new = view(spark, d, "v_manifest_now").select("path", "fingerprint")
    return rows.replace_by_path(view(spark, d, "v_manifest_old").select("path", "fingerprint"), new)


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders) o FULL JOIN (SELECT o_orderkey + 1000 AS k, 'M' AS v FROM orders) n ON o.k = n.k")
def merge_by_key(spark, d):
    o = table(spark, d, "orders")
    old, new = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), o.select((F.col("o_orderkey") + 1000).alias("k"), F.lit("M").alias("v"))
    return rows.merge_by_key(old, new, "k")


# -- graph ------------------------------------------------------------------
NODES = "+ n AS (SELECT sha256(from_kind || ':' || from_id) AS node_id, from_kind AS kind, from_label AS label, path, derived_fact_id AS k, 0 AS s FROM v_facts UNION ALL SELECT sha256(to_kind || ':' || to_id), to_kind, to_label, path, derived_fact_id, 1 FROM v_facts)"


@query(NODES + " SELECT node_id, kind, label, path FROM n QUALIFY row_number() OVER (PARTITION BY node_id, path ORDER BY s DESC, k DESC) = 1", "v_facts")
def graph_nodes_last_wins(spark, d):
    return graph.project(None, None, view(spark, d, "v_facts"))[0].select("node_id", "kind", "label", "path")


EDGE = "+ e AS (SELECT sha256(sha256(from_kind || ':' || from_id) || ':' || kind || ':' || sha256(to_kind || ':' || to_id)) AS edge_id, sha256(from_kind || ':' || from_id) AS from_node_id, kind, sha256(to_kind || ':' || to_id) AS to_node_id, path, confidence, derived_fact_id AS k FROM v_facts), g AS (SELECT edge_id, from_node_id, kind, to_node_id, path, confidence FROM e QUALIFY row_number() OVER (PARTITION BY edge_id, path ORDER BY k DESC) = 1)"


def _edges(spark, d):
    return graph.project(None, None, view(spark, d, "v_facts"))[1].select("edge_id", "from_node_id", "kind", "to_node_id", "path", "confidence")


@query(EDGE + " SELECT * FROM g", "v_facts")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(EDGE + " SELECT * FROM g WHERE from_node_id = sha256('Package:N3') OR to_node_id = sha256('Package:N3')", "v_facts")
def edges_by_node(spark, d):
    import hashlib

    return graph.edges_by_node(_edges(spark, d), hashlib.sha256(b"Package:N3").hexdigest())


@query(EDGE + " SELECT * FROM g WHERE path = 'src/s.ts'", "v_facts")
def graph_by_path(spark, d):
    return graph.by_path(_edges(spark, d), "src/s.ts")


OVER = "+ o AS (SELECT CASE kind WHEN 'caller-callee-candidate' THEN 'cfg' WHEN 'symbol-references-symbol-candidate' THEN 'data_flow' ELSE 'pdg_lite' END AS overlay, CASE kind WHEN 'caller-callee-candidate' THEN 'cfg-next' WHEN 'symbol-references-symbol-candidate' THEN 'data-flow' ELSE kind END AS k, * FROM v_facts WHERE kind IN ('caller-callee-candidate', 'symbol-references-symbol-candidate', 'file-imports-file', 'file-imports-package', 'workflow-runs-package-script-candidate', 'quality-gate-runs-script-candidate', 'config-selects-entrypoint-candidate'))"


@query(OVER + " SELECT overlay, k || ':' || derived_fact_id AS edge_id, k AS kind, from_id, to_id FROM o", "v_facts")
def overlay_edges(spark, d):
    return graph.overlay_edges(view(spark, d, "v_facts")).select("overlay", "edge_id", "kind", "from_id", "to_id")


@query(OVER + ", n AS (SELECT overlay, from_id AS id, from_kind AS kind, derived_fact_id AS f, 0 AS s FROM o UNION ALL SELECT overlay, to_id, to_kind, derived_fact_id, 1 FROM o) SELECT overlay, id, kind FROM n QUALIFY row_number() OVER (PARTITION BY overlay, id ORDER BY f DESC, s DESC) = 1", "v_facts")
def overlay_nodes(spark, d):
    return graph.overlay_nodes(graph.overlay_edges(view(spark, d, "v_facts"))).select("overlay", "id", "kind")


# -- analysis ---------------------------------------------------------------
@query(" SELECT evidence_id, path, round(1000 + CASE WHEN path = 'src/m2.ts' THEN 100 ELSE 0 END + CASE WHEN signature IS NOT NULL THEN 0.95 ELSE 0.75 END, 6)::DOUBLE AS score FROM v_symbols WHERE path = 'src/m2.ts' AND name = 'small ring'", "v_symbols")
def anchor_resolve(spark, d):
    return analysis.candidates(view(spark, d, "v_symbols"), Anchor("symbol", "small ring", path="src/m2.ts")).select("evidence_id", "path", F.round("score", 6).alias("score"))


@query(" SELECT derived_fact_id, CASE WHEN from_id = 'N3' THEN 'from' WHEN to_id = 'N3' THEN 'to' END AS side FROM v_facts WHERE from_id = 'N3' OR to_id = 'N3'", "v_facts")
def endpoint_match(spark, d):
    side = analysis.matched_side(Anchor("package", "?", id="N3"))
    return view(spark, d, "v_facts").withColumn("side", side).filter("side IS NOT NULL").select("derived_fact_id", "side")


IMPACT = "+ m AS (SELECT *, CASE WHEN from_id = '{a}' THEN 'from' ELSE 'to' END AS side FROM v_facts WHERE (from_id = '{a}' OR to_id = '{a}')), f AS (SELECT * FROM m WHERE {where} ORDER BY derived_fact_id LIMIT 25) SELECT derived_fact_id, kind, path, confidence, side, CASE WHEN side = 'from' THEN to_id ELSE from_id END AS other_id, CASE WHEN kind = 'caller-callee-candidate' THEN 'direct' ELSE 'possible' END AS classification, sha256(evidence_id || ':{a}') AS impact_id FROM f"
MODES = {
    "all": ("N3", "true"), "callers": ("O5", "kind = 'caller-callee-candidate' AND side = 'to'"), "callees": (None, "kind = 'caller-callee-candidate' AND side = 'from'"), "dependents": ("C5", "kind IN ('symbol-references-symbol-candidate', 'file-imports-file', 'file-imports-package', 'package-depends-on-package') AND side = 'from'"),
    "tests": ("S1", "kind IN ('quality-gate-runs-command', 'quality-gate-runs-script-candidate') AND side = 'from'"), "runtime": ("P7", "kind IN ('task-runs-command', 'file-declares-entrypoint-candidate') AND side = 'from'"),
}


def _line_of_order(spark, d):
    return view(spark, d, "v_facts").filter("to_id = 'O5' AND kind = 'caller-callee-candidate'").agg(F.min("from_id")).first()[0]


def _impact(mode, anchor):
    def run(spark, d):
        return analysis.impact(view(spark, d, "v_facts"), Anchor("symbol", "?", id=anchor or _line_of_order(spark, d)), mode).select("derived_fact_id", "kind", "path", "confidence", "side", "other_id", "classification", "impact_id")

    return run


for _m, (_a, _w) in MODES.items():
    _sql = IMPACT.format(a=_a, where=_w) if _a else IMPACT.replace("'{a}'", "(SELECT a FROM x)").replace("':{a}'", "':' || (SELECT a FROM x)").replace("+ m AS", "+ x AS (SELECT min(from_id) AS a FROM v_facts WHERE to_id = 'O5' AND kind = 'caller-callee-candidate'), m AS").format(where=_w)
    query(_sql, "v_facts", name=f"impact_{_m}")(_impact(_m, _a))


@query("+ f AS (SELECT kind FROM v_facts WHERE from_id = 'N3' OR to_id = 'N3' ORDER BY derived_fact_id LIMIT 200) SELECT count(*) FILTER (kind = 'caller-callee-candidate')::BIGINT AS direct, count(*) FILTER (kind <> 'caller-callee-candidate')::BIGINT AS possible, count(*)::BIGINT AS total, count(*) >= 200 AS truncated FROM f", "v_facts")
def impact_summary(spark, d):
    return analysis.impact_summary(analysis.impact(view(spark, d, "v_facts"), Anchor("package", "?", id="N3"), "all", most=200), 200)


SLICE = "+ m AS (SELECT *, CASE WHEN from_id = '{a}' THEN 'from' ELSE 'to' END AS side FROM v_facts WHERE (from_id = '{a}' OR to_id = '{a}') AND kind IN ('caller-callee-candidate', 'symbol-references-symbol-candidate', 'file-imports-file', 'file-imports-package', 'package-depends-on-package', 'config-selects-entrypoint-candidate', 'task-runs-command', 'quality-gate-runs-command', 'quality-gate-runs-script-candidate'))"
SLICED = " SELECT derived_fact_id, kind, path, side, CASE WHEN side = 'from' THEN to_id ELSE from_id END AS other_id, sha256(evidence_id || ':{a}') AS slice_id FROM "


def _slice(anchor, **options):
    def run(spark, d):
        return analysis.evidence_slice(view(spark, d, "v_facts"), Anchor("symbol", "?", id=anchor), **options).select("derived_fact_id", "kind", "path", "side", "other_id", "slice_id")

    return run


query((SLICE + SLICED + "m WHERE side = 'from' ORDER BY derived_fact_id LIMIT 40").format(a="O5"), "v_facts", name="slice_forward")(_slice("O5", direction="forward"))
query((SLICE + SLICED + "m WHERE side = 'to' ORDER BY derived_fact_id LIMIT 40").format(a="N3"), "v_facts", name="slice_backward")(_slice("N3", direction="backward"))
query((SLICE + ", t AS (SELECT path FROM m GROUP BY path ORDER BY min(derived_fact_id), path LIMIT 5), s AS (SELECT * FROM m WHERE path IN (SELECT path FROM t) ORDER BY derived_fact_id LIMIT 40)" + SLICED + "s").format(a="N3"), "v_facts", name="slice_max_files")(_slice("N3", max_files=5))


ENTRY = PKG + FLOWS + """, s AS (SELECT path, a AS name FROM f UNION ALL SELECT path, b FROM f), e AS (SELECT path, name, 'script' AS kind, 1.0 AS c, sha256(path || ':package_script:' || name) AS o FROM s UNION ALL SELECT path, name, 'worker', 0.9, sha256(path || ':workspace_task:' || name) FROM s UNION ALL SELECT path, b, 'test', 0.95, sha256(path || ':quality_gate:package-script:eslint') FROM f UNION ALL SELECT path, coalesce(script_name, 'workflow-step'), 'test', 0.95, sha256(path || ':quality_gate:workflow-step:' || command) FROM fl),
  k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY kind, path, name ORDER BY o) = 1)"""


@query(ENTRY + " SELECT name, kind, path, c::DOUBLE AS confidence FROM k ORDER BY c DESC, path, name, kind LIMIT 100")
def entrypoints_ranked(spark, d):
    return analysis.entrypoints(_pkg_facts(spark, d), most=100).select("name", "kind", "path", "confidence")


@query(ENTRY + " SELECT name, kind, path, c::DOUBLE AS confidence FROM k WHERE kind = 'worker' AND contains(lower(name), 'lint') AND contains(path, 'x/1') AND c >= 0.5 ORDER BY c DESC, path, name, kind LIMIT 20")
def entrypoints_filtered(spark, d):
    return analysis.entrypoints(_pkg_facts(spark, d), kind="worker", query="LINT", package="x/1", confidence_min=0.5).select("name", "kind", "path", "confidence")


def _flow(spark, d, *args, **options):
    segments, summary = analysis.flow(view(spark, d, "v_facts"), *args, **options)
    rows_ = [(int(s["seq"]), s["from_id"], s["to_id"], s["kind"], float(s["confidence"])) for s in segments]
    return spark.createDataFrame(rows_, "seq long, from_id string, to_id string, kind string, confidence double"), summary




@query("+ u AS (SELECT DISTINCT * FROM v_facts), f AS (SELECT *, row_number() OVER (ORDER BY to_kind, to_label, path, to_id, derived_fact_id) - 1 AS seq FROM u WHERE from_id = (SELECT min(from_id) FROM v_facts WHERE to_id = 'O5' AND kind = 'caller-callee-candidate') AND kind = 'caller-callee-candidate') SELECT seq::BIGINT AS seq, from_id, to_id, kind, confidence FROM f WHERE seq < 4", "v_facts")
def flow_forward(spark, d):
    return _flow(spark, d, Anchor("symbol", "?", id=_line_of_order(spark, d)), include=("calls",))[0]


@query("+ f AS (SELECT *, row_number() OVER (ORDER BY from_kind, from_label, path, from_id, derived_fact_id) - 1 AS seq FROM v_facts WHERE to_id = 'R1' AND kind = 'package-depends-on-package') SELECT seq::BIGINT AS seq, to_id AS from_id, from_id AS to_id, kind, confidence FROM f WHERE seq < 4", "v_facts")
def flow_backward(spark, d):
    return _flow(spark, d, Anchor("package", "?", id="R1"), direction="backward", include=("config",))[0]


@query("SELECT 0::BIGINT AS seq, 'N3' AS from_id, 'R' || n_regionkey AS to_id, 'package-depends-on-package' AS kind, 1.0::DOUBLE AS confidence FROM nation WHERE n_nationkey = 3")
def flow_target(spark, d):
    region = table(spark, d, "nation").filter("n_nationkey = 3").first()["n_regionkey"]
    return _flow(spark, d, Anchor("package", "?", id="N3"), Anchor("package", "?", id=f"R{region}"), include=("config", "imports"))[0]


@query("+ f AS (SELECT * FROM v_facts WHERE from_id = 'O5' AND kind IN ('caller-callee-candidate', 'symbol-exported-from-file')) SELECT CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'partial' ELSE 'truncated' END AS completeness, coalesce((SELECT round(min(confidence), 6) FROM (SELECT confidence FROM f LIMIT 4)), 0)::DOUBLE AS confidence UNION ALL SELECT 'complete', round(min(confidence), 6)::DOUBLE FROM v_facts WHERE from_id = 'N3' AND kind = 'package-depends-on-package'", "v_facts")
def flow_confidence(spark, d):
    region = table(spark, d, "nation").filter("n_nationkey = 3").first()["n_regionkey"]
    summary = _flow(spark, d, Anchor("package", "?", id="N3"), Anchor("package", "?", id=f"R{region}"), include=("config",))[1]
    other = _flow(spark, d, Anchor("symbol", "?", id="O5"), include=("calls", "exports"))[1]
    return spark.createDataFrame([(x["completeness"], float(x["confidence"])) for x in (summary, other)], "completeness string, confidence double")


@query("+ e AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM v_facts), r AS (WITH RECURSIVE w AS (SELECT 'O5' AS node, 0 AS depth UNION SELECT f.to_id, depth + 1 FROM w JOIN e f ON f.from_id = w.node WHERE depth < 4) SELECT node, min(depth)::BIGINT AS depth FROM w GROUP BY node) SELECT * FROM r", "v_facts")
def flow_reachability_recursive(spark, d):
    return analysis.reachable(view(spark, d, "v_facts"), "O5", 4).select("node", F.col("depth").cast("long").alias("depth"))


# -- status and stream --------------------------------------------------------
LAST = "SELECT user_id, max_by(event_type, (ts, event_id)) AS state, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id"


@query(f"WITH l AS ({LAST}) SELECT user_id, state, state IN ('error', 'purchase') AS needs_reindex FROM l")
def status_needs_reindex(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    none = F.lit(False)
    return last.select("user_id", "state", State.needs_reindex(F.col("state") == "purchase", none, F.col("state"), none).alias("needs_reindex"))


@query("+ x AS (SELECT n.path AS a, o.path AS b, n.fingerprint = o.fingerprint AS same FROM v_manifest_now n FULL JOIN v_manifest_old o ON n.path = o.path) SELECT count(a)::BIGINT AS files_total, count(*) FILTER (a IS NOT NULL AND NOT coalesce(same, false))::BIGINT AS files_indexed, count(*) FILTER (a IS NULL)::BIGINT AS purged FROM x", "v_manifest_now", "v_manifest_old")
def index_counters(spark, d):
    s = rows.diff(view(spark, d, "v_manifest_now"), view(spark, d, "v_manifest_old"))
    return s.agg(F.count_if(F.col("status") != "stale").alias("files_total"), F.count_if(F.col("status").isin("new", "changed")).alias("files_indexed"), F.count_if(F.col("status") == "stale").alias("purged"))


GAPS = "WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM o), b AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS due, count(*)::BIGINT AS changes FROM s GROUP BY user_id, burst)"


def _bursts(spark, d):
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return watch.bursts(events, "1 hour", None, "user_id")


@query(GAPS + " SELECT user_id, epoch_us(started)::BIGINT AS started, epoch_us(due)::BIGINT AS due, changes FROM b")
def debounce_sessions(spark, d):
    return _bursts(spark, d).select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("due").alias("due"), "changes")


@query(GAPS + ", f AS (SELECT user_id, epoch_us(due)::BIGINT AS due, changes, epoch_us(due) < lag(epoch_us(due) + changes * 40000 * 1000000) OVER (PARTITION BY user_id ORDER BY due) AS followup FROM b) SELECT user_id, due, coalesce(followup, false) AS followup FROM f")
def debounce_followups(spark, d):
    runs = _bursts(spark, d).withColumn("took", F.col("changes") * 40000)
    return watch.followups(runs, "user_id").select("user_id", F.unix_micros("due").alias("due"), "followup")


@query("SELECT user_id, count(*)::BIGINT AS changes, count(*) > 0 AS pending_changes FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id")
def change_pending_flags(spark, d):
    return watch.pending_flags(table(spark, d, "events").filter(F.col("event_type").isin("view", "error")), "user_id")
