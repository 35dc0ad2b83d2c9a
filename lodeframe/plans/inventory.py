"""Queries over the operators of an index run: languages, artifacts, analyzers, observations, facts, graph projections and the questions about one symbol."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rows, text
from ..operators import analysis, chunk, embed, facts, graph, observe, parse, partition
from ..sources import scan, store
from ..streaming import watch
from ..streaming.state import State
from .catalog import _packages, query, table
from .corpus import view

EXT = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"
LANG = "CASE " + " ".join(f"WHEN {EXT} IN ({', '.join(repr(e) for e in some)}) THEN '{name}'" for name, some in observe.LANGUAGES.items()) + " END"
LISTED = ", ".join(repr(p) for p, k in observe.ARTIFACTS.items() if k == "repo-config")
ARTIFACT = rf"CASE WHEN path = 'package.json' THEN 'package-json' WHEN path = 'nx.json' THEN 'nx-json' WHEN path IN ({LISTED}) THEN 'repo-config' WHEN regexp_matches(path, '^\.github/workflows/.*\.ya?ml$') THEN 'github-workflow' WHEN starts_with(path, '.husky/') THEN 'repo-config' END"


# -- scan and languages -------------------------------------------------------
@query("+ s AS (SELECT path FROM v_candidates) SELECT path, row_number() OVER (ORDER BY path)::BIGINT AS place FROM s ORDER BY path LIMIT 100", "v_candidates")
def scan_order(spark, d):
    """The first hundred candidates by path."""
    from pyspark.sql import Window

    first = scan.in_order(view(spark, d, "v_candidates").select("path")).limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy("path")).cast("long"))


@query("+ p AS (SELECT DISTINCT string_split(path, '/') AS ps FROM v_candidates), n AS (SELECT ps, unnest(range(1, len(ps))) AS k FROM p) SELECT DISTINCT array_to_string(ps[:k], '/') AS path FROM n", "v_candidates")
def scan_directories(spark, d):
    return scan.directories(view(spark, d, "v_candidates"))


@query(f"+ x AS (SELECT path, nullif({EXT}, '') AS language, {LANG} AS registered FROM v_candidates) SELECT * FROM x", "v_candidates")
def language_detect(spark, d):
    return view(spark, d, "v_candidates").select("path", parse.language(F.col("path")).alias("language"), observe.registered_language(F.col("path")).alias("registered"))


ART_PATHS = ["package.json", "nx.json", ".github/workflows/{}.yml", ".github/workflows/{}.ts", ".husky/{}", "eslint.config.mjs", "a/{}/package.json", "src/{}.ts", "src/{}.md", ".devcontainer/devcontainer.json", "src/{}.txt", "lib/{}.py"]
ART = "WITH a AS (SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '" + p.replace("{}", "' || p_partkey || '") + "'" for i, p in enumerate(ART_PATHS)) + " END AS path, CASE WHEN p_partkey % 12 IN (8, 10) THEN 'doc' ELSE 'code' END AS source_type FROM part)"


def _artifacts(spark, d) -> DataFrame:
    made = F.element_at(F.array(*[F.lit(p) for p in ART_PATHS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.replace(made, F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"), F.when((F.col("p_partkey") % 12).isin(8, 10), "doc").otherwise("code").alias("source_type"))


@query(ART + f" SELECT p_partkey, {ARTIFACT} AS artifact FROM a")
def artifact_detect(spark, d):
    return _artifacts(spark, d).select("p_partkey", observe.artifact(F.col("path")).alias("artifact"))


@query(ART + f""", b AS (SELECT *, source_type = 'code' AND {EXT} <> '' AS code, {LANG} IS NOT NULL AS known, {ARTIFACT} IS NOT NULL AS own FROM a)
  SELECT p_partkey, code AND known AND NOT own AS by_rules, code AND {EXT} IN ('ts', 'js') AS deep, code AS generic, (path IN ('package.json', 'nx.json', {LISTED}) OR starts_with(path, '.github/workflows/') OR starts_with(path, '.husky/')) AND (own OR NOT known) AS by_artifact FROM b""")
def analyzer_select(spark, d):
    return observe.analyzers(_artifacts(spark, d)).select("p_partkey", "by_rules", "deep", "generic", "by_artifact")


# -- observations ---------------------------------------------------------------
@query(f"+ x AS (SELECT path, content, coalesce(nullif({EXT}, ''), 'unknown') AS language FROM v_candidates) SELECT path, sha256(path || ':run-1:file:' || language) AS evidence_id, language, strlen(content)::BIGINT AS bytes, len(string_split(content, chr(10)))::BIGINT AS line_count FROM x", "v_candidates")
def observe_files(spark, d):
    return observe.files(view(spark, d, "v_candidates"), "run-1").select("path", "evidence_id", "language", "bytes", "line_count")


LINE = "CASE p_size % 9 WHEN 0 THEN 'export async function ' || nm || '(a) {' WHEN 1 THEN '  private ' || nm || ' (x) {' WHEN 2 THEN 'class ' || nm || ' {' WHEN 3 THEN 'import { a } from \"' || nm || '\";' WHEN 4 THEN 'export default class ' || nm || ' {}' WHEN 5 THEN 'const b = ' || nm || '(1);' WHEN 6 THEN 'export type ' || nm || ' = string;' WHEN 7 THEN 'def ' || nm || '(self):' ELSE '  x = ' || nm || ';' END"
LINED = f"WITH p AS (SELECT *, replace(p_name, ' ', '_') AS nm FROM part), l AS (SELECT 'm/' || (p_partkey % 40) || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.rb' END AS path, p_partkey AS place, {LINE} AS line FROM p)"


def _lines(spark, d) -> DataFrame:
    p = table(spark, d, "part").withColumn("nm", F.replace("p_name", F.lit(" "), F.lit("_")))
    n, nm = F.col("p_size") % 9, F.col("nm")
    make = lambda a, b: F.concat(F.lit(a), nm, F.lit(b))
    line = F.when(n == 0, make("export async function ", "(a) {")).when(n == 1, make("  private ", " (x) {")).when(n == 2, make("class ", " {")).when(n == 3, make('import { a } from "', '";')).when(n == 4, make("export default class ", " {}")).when(n == 5, make("const b = ", "(1);")).when(n == 6, make("export type ", " = string;")).when(n == 7, make("def ", "(self):")).otherwise(make("  x = ", ";"))
    end = F.element_at(F.array(*map(F.lit, (".ts", ".js", ".py", ".rb"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(F.concat(F.lit("m/"), F.col("p_partkey") % 40, end).alias("path"), F.col("p_partkey").alias("place"), line.alias("line"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


EXPORT_KIND = "CASE " + " ".join(f"WHEN contains(line, '{k}') THEN '{k}'" for k in observe.EXPORT_KINDS) + " ELSE 'variable' END"


@query(LINED + f""", s AS (SELECT *, place + 1 AS n FROM l WHERE regexp_matches(path, '\\.[tj]s$')),
  e AS (SELECT path, n, 'symbol_export' AS kind, regexp_extract(line, {_quoted(observe.EXPORT)}, 1) AS name, {EXPORT_KIND} AS symbol_kind FROM s
    UNION ALL SELECT path, n, 'symbol_definition', regexp_extract(line, {_quoted(observe.METHOD)}, 1), 'method' FROM s WHERE NOT contains(line, 'function '))
  SELECT sha256(path || ':' || kind || ':' || name || ':' || n || ':' || symbol_kind || ':ts-js-deep') AS evidence_id, path, kind, name, symbol_kind FROM e WHERE name <> ''""")
def observe_script_lines(spark, d):
    return observe.script_lines(_lines(spark, d)).select("evidence_id", "path", "kind", "name", "symbol_kind")


RULED = " UNION ALL ".join(f"SELECT path, place + 1 AS n, '{r.id}' AS rule, {r.confidence}::DOUBLE AS confidence, '{r.kind}' AS kind, unnest(list_distinct(regexp_extract_all(line, {_quoted(r.pattern)}, 1))) AS name FROM l WHERE path LIKE '%.{lang}'" for lang, some in observe.RULES.items() for r in some)


@query(LINED + f", r AS ({RULED}) SELECT sha256(path || ':' || kind || ':' || trim(name) || ':' || n || ':' || n || ':' || rule) AS evidence_id, path, kind, trim(name) AS name, confidence FROM r WHERE trim(name) <> ''")
def observe_by_rules(spark, d):
    return observe.by_rules(_lines(spark, d)).select("evidence_id", "path", "kind", "name", "confidence")


BK = "CASE WHEN contains(k, 'class') THEN 'class' WHEN contains(k, 'interface') THEN 'interface' WHEN contains(k, 'enum') THEN 'enum' WHEN contains(k, 'type_alias') OR k = 'type' THEN 'type' WHEN contains(k, 'function') OR contains(k, 'signature') THEN 'function' WHEN contains(k, 'method') THEN 'method' WHEN contains(k, 'variable') OR contains(k, 'lexical') THEN 'variable' END"
BLOCK_KINDS = ("class_declaration", "method_definition", "lexical_declaration", "import_statement", "function_declaration")
NAMED = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {_quoted(p)}, 1), '')" for p in observe.BLOCK_NAMES) + ", CASE WHEN sk = 'variable' THEN substr(trim(line), 1, 120) END)"


@query(LINED + f""", b AS (SELECT path, place, line, ['{"', '".join(BLOCK_KINDS)}'][place % 5 + 1] AS k FROM l), x AS (SELECT *, {BK} AS sk FROM b), y AS (SELECT *, {NAMED} AS name FROM x WHERE sk IS NOT NULL)
  SELECT sha256(path || ':generic:' || sk || ':' || name || ':' || place || ':' || (place + 2)) AS evidence_id, path, sk AS symbol_kind, name FROM y WHERE name IS NOT NULL""")
def observe_blocks(spark, d):
    kinds = F.array(*map(F.lit, BLOCK_KINDS))
    blocks = _lines(spark, d).select("path", F.element_at(kinds, (F.col("place") % 5 + 1).cast("int")).alias("kind"), F.col("line").alias("content"), F.col("place").alias("start_line"), (F.col("place") + 2).alias("end_line"))
    return observe.blocks(blocks).select("evidence_id", "path", "symbol_kind", "name")


def _repository(spark, d) -> DataFrame:
    docs = _artifacts(spark, d).withColumns({"content": F.concat(F.lit('{"name": "n'), F.col("p_partkey"), F.lit('"}')), "artifact_kind": F.lit("config")})
    steps = docs.filter("p_partkey % 12 = 2").select("path", F.lit("build").alias("name"), F.lit("npm run build").alias("command"), F.lit("build").alias("script_name"))
    scripts = docs.filter("p_partkey % 12 = 0").select("path", F.concat(F.lit("s"), F.col("p_partkey")).alias("name"), F.lit("make").alias("command"))
    return observe.repository(docs, scripts, steps, steps.withColumn("tool", F.lit("workflow-step")))


@query(ART + """, o AS (SELECT path, CASE WHEN p_partkey % 12 = 2 THEN 'workflow' ELSE 'config_artifact' END AS kind, CASE p_partkey % 12 WHEN 0 THEN 'n' || p_partkey WHEN 1 THEN 'nx' ELSE path END AS name, CASE p_partkey % 12 WHEN 0 THEN 'package' WHEN 1 THEN 'workspace' WHEN 2 THEN 'workflow' ELSE 'config' END AS sk FROM a WHERE p_partkey % 12 IN (0, 1, 2, 4, 5, 9)
    UNION ALL SELECT path, 'task', 's' || p_partkey, 'package-script' FROM a WHERE p_partkey % 12 = 0
    UNION ALL SELECT path, 'workflow_step', 'build', 'workflow-step' FROM a WHERE p_partkey % 12 = 2 UNION ALL SELECT path, 'quality_gate', 'workflow-step', 'quality-gate' FROM a WHERE p_partkey % 12 = 2)
  SELECT DISTINCT sha256(path || ':' || kind || ':' || name || ':' || sk) AS evidence_id, path, kind, name FROM o""")
def observe_repository(spark, d):
    return observe.settle(_repository(spark, d)).select("evidence_id", "path", "kind", "name")


@query("SELECT 'e' || (p_size % 20) AS evidence_id, max_by(p_name, ((p_partkey % 2), p_retailprice, p_name)) AS name FROM part GROUP BY 1")
def observations_last_wins(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("e"), F.col("p_size") % 20).alias("evidence_id"), F.col("p_retailprice").alias("confidence"), F.col("p_name").alias("name"), "p_partkey")
    return observe.settle(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1")).select("evidence_id", "name")


# -- facts ------------------------------------------------------------------------
def _canonical(spark, d) -> DataFrame:
    seen = observe.settle(observe.script_lines(_lines(spark, d)))
    base = _repository(spark, d)
    of = lambda kind: base.filter(F.col("kind") == kind)
    steps = _artifacts(spark, d).filter("p_partkey % 12 = 2").select("path", F.lit("build").alias("name"), F.lit("npm run build").alias("command"), F.lit("build").alias("script_name"))
    return facts.settle_facts(facts.symbol_exports(seen.filter("kind = 'symbol_export'")), facts.workflows(of("workflow")), facts.config_artifacts(of("config_artifact").withColumn("artifact_kind", F.col("symbol_kind"))), facts.workflow_steps(steps))


FACTS = LINED + ART.replace("WITH a AS", ", a AS") + f""", x AS (SELECT DISTINCT path, regexp_extract(line, {_quoted(observe.EXPORT)}, 1) AS name, {EXPORT_KIND} AS sk FROM l WHERE regexp_matches(path, '\\.[tj]s$')),
  c AS (SELECT sha256(path || ':symbol_export:' || name || ':' || sk) AS fact_id, 'symbol_export' AS kind, path, name FROM x WHERE name <> ''
    UNION ALL SELECT sha256(path || ':workflow:' || path), 'workflow', path, path FROM a WHERE p_partkey % 12 = 2
    UNION ALL SELECT sha256(path || ':workflow_step:build:npm run build'), 'workflow_step', path, 'build' FROM a WHERE p_partkey % 12 = 2
    UNION ALL SELECT DISTINCT sha256(path || ':config_artifact:' || nm), 'config_artifact', path, nm FROM (SELECT path, CASE p_partkey % 12 WHEN 0 THEN 'n' || p_partkey WHEN 1 THEN 'nx' ELSE path END AS nm FROM a WHERE p_partkey % 12 IN (0, 1, 4, 5, 9)))"""


def _fact_query(kind: str, key: str):
    def run(spark, d):
        return _canonical(spark, d).filter(F.col("kind") == kind).select("fact_id", "path", facts.payload(key).alias("name"))

    query(FACTS + f" SELECT fact_id, path, name FROM c WHERE kind = '{kind}'", name=f"fact_{kind}")(run)


for _kind, _key in (("symbol_export", "exportedName"), ("workflow", "workflowName"), ("workflow_step", "stepName"), ("config_artifact", "artifactName")):
    _fact_query(_kind, _key)

JSON = """'{"fromId":"' || a || '","fromKind":"' || ak || '","fromLabel":"' || a || '","toId":"' || b || '","toKind":"' || bk || '","toLabel":"' || b || '"}'"""
DERIVED = f" SELECT sha256(path || ':' || kind || ':' || {JSON}) AS derived_fact_id, kind, a AS from_id, b AS to_id FROM e"


def _derived(*kinds: str):
    def run(spark, d):
        return facts.derive(_canonical(spark, d)).filter(F.col("kind").isin(*kinds)).select("derived_fact_id", "kind", "from_id", "to_id")

    return run


query(FACTS + ", e AS (SELECT path, 'symbol-exported-from-file' AS kind, name AS a, 'Symbol' AS ak, path AS b, 'File' AS bk FROM (SELECT DISTINCT path, name FROM c WHERE kind = 'symbol_export'))" + DERIVED, name="derived_symbol_exported")(_derived("symbol-exported-from-file"))
query(FACTS + ", e AS (SELECT path, 'workflow-contains-job' AS kind, path AS a, 'Workflow' AS ak, name AS b, 'WorkflowJob' AS bk FROM c WHERE kind = 'workflow_step' UNION ALL SELECT path, 'job-runs-step', name, 'WorkflowJob', name, 'WorkflowStep' FROM c WHERE kind = 'workflow_step')" + DERIVED, name="derived_workflow_jobs")(_derived("workflow-contains-job", "job-runs-step"))
query(FACTS + ", e AS (SELECT path, 'workflow-runs-package-script-candidate' AS kind, name AS a, 'WorkflowStep' AS ak, 'build' AS b, 'PackageScript' AS bk FROM c WHERE kind = 'workflow_step')" + DERIVED, name="derived_workflow_scripts")(_derived("workflow-runs-package-script-candidate"))


@query("+ s AS (SELECT DISTINCT path, name FROM v_symbols), e AS (SELECT path, 'symbol-defined-in-file' AS kind, name AS a, 'Symbol' AS ak, path AS b, 'File' AS bk FROM s)" + DERIVED, "v_symbols")
def derived_symbol_defined(spark, d):
    return facts.derive(facts.settle_facts(facts.symbol_definitions(view(spark, d, "v_symbols")))).select("derived_fact_id", "kind", "from_id", "to_id")


@query("WITH w AS (SELECT 'w' || c_custkey || '.yml' AS path, CASE WHEN c_custkey % 3 = 0 THEN 'w' || c_custkey || '.yml' ELSE 'CI' || c_custkey END AS name, c_custkey % 2 = 0 AS stepped FROM customer), e AS (SELECT path, 'workflow-contains-job' AS kind, name AS a, 'Workflow' AS ak, name AS b, 'WorkflowJob' AS bk FROM w WHERE NOT (stepped AND name = path))" + DERIVED)
def derived_lone_workflow(spark, d):
    """Workflows of which no step names a job: a self job each."""
    c = table(spark, d, "customer")
    path = F.concat(F.lit("w"), F.col("c_custkey"), F.lit(".yml"))
    flows = c.select(path.alias("path"), F.when(F.col("c_custkey") % 3 == 0, path).otherwise(F.concat(F.lit("CI"), F.col("c_custkey"))).alias("name"))
    steps = c.filter("c_custkey % 2 = 0").select(path.alias("path"), F.lit("go").alias("name"), F.lit("make").alias("command"), F.lit(None).cast("string").alias("script_name"))
    made = facts.derive(facts.settle_facts(facts.workflows(flows), facts.workflow_steps(steps)))
    return made.filter("kind = 'workflow-contains-job' AND from_id = to_id").select("derived_fact_id", "kind", "from_id", "to_id")


@query("SELECT path, count(*)::BIGINT AS n FROM (SELECT 'src/m' || CAST(floor(p_partkey / 20) AS BIGINT) || '.ts' AS path FROM part) GROUP BY path HAVING count(*) > 19")
def crowded_files(spark, d):
    return facts.crowded(view(spark, d, "v_symbols"), 19)


# -- graph ------------------------------------------------------------------------
SYM = "+ n AS (SELECT DISTINCT sha256('File:' || path) AS node_id, 'File' AS kind, path AS label, path FROM v_symbols UNION SELECT sha256('SymbolCandidate:' || evidence_id), 'SymbolCandidate', name, path FROM v_symbols)"


@query(SYM + " SELECT * FROM n", "v_symbols")
def graph_symbol_nodes(spark, d):
    return graph.project(view(spark, d, "v_symbols"), None, None)[0]


@query("+ e AS (SELECT sha256('File:' || path) AS from_node_id, sha256('SymbolCandidate:' || evidence_id) AS to_node_id, path FROM v_symbols) SELECT sha256(from_node_id || ':DEFINES_CANDIDATE:' || to_node_id) AS edge_id, from_node_id, to_node_id, path FROM e", "v_symbols")
def graph_symbol_edges(spark, d):
    return graph.project(view(spark, d, "v_symbols"), None, None)[1].select("edge_id", "from_node_id", "to_node_id", "path")


OWN = "CASE kind WHEN 'symbol_export' THEN 'Symbol' WHEN 'workflow' THEN 'Workflow' WHEN 'workflow_step' THEN 'WorkflowStep' ELSE 'ConfigArtifact' END"


@query(FACTS + f" SELECT DISTINCT sha256('CanonicalFact:' || kind || ':' || fact_id) AS node_id, 'CanonicalFact:' || kind AS kind, kind AS label, path FROM c UNION SELECT sha256({OWN} || ':' || name), {OWN}, name, path FROM c")
def graph_canonical_nodes(spark, d):
    return graph.project(None, _canonical(spark, d), None)[0]


@query(FACTS + f", e AS (SELECT sha256('CanonicalFact:' || kind || ':' || fact_id) AS f, sha256({OWN} || ':' || name) AS t, path FROM c) SELECT sha256(f || ':REPRESENTS:' || t) AS edge_id, f AS from_node_id, t AS to_node_id, path FROM e")
def graph_canonical_edges(spark, d):
    return graph.project(None, _canonical(spark, d), None)[1].select("edge_id", "from_node_id", "to_node_id", "path")


@query("+ e AS (SELECT sha256(sha256(from_kind || ':' || from_id) || ':' || kind || ':' || sha256(to_kind || ':' || to_id)) AS edge_id, sha256(from_kind || ':' || from_id) AS a, sha256(to_kind || ':' || to_id) AS b, path FROM v_facts), w AS (SELECT sha256('Package:N' || n_nationkey) AS x FROM nation WHERE n_nationkey < 5) SELECT DISTINCT edge_id, path FROM e WHERE a IN (SELECT x FROM w) OR b IN (SELECT x FROM w)", "v_facts")
def edges_by_nodes(spark, d):
    edges = graph.project(None, None, view(spark, d, "v_facts"))[1]
    nodes = spark.createDataFrame([(hashlib.sha256(f"Package:N{i}".encode()).hexdigest(),) for i in range(5)], "node_id string")
    return graph.edges_by_nodes(edges, nodes).select("edge_id", "path")


# -- one symbol -------------------------------------------------------------------
ONE = "w AS (SELECT path, name, evidence_id FROM v_symbols WHERE path = 'src/m2.ts' QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN signature IS NOT NULL THEN 0 ELSE 1 END, start_line, evidence_id) = 1), q AS (SELECT name FROM v_symbols WHERE path = 'src/m2.ts' GROUP BY name HAVING count(*) = 1 ORDER BY name LIMIT 1)"


def _asked(spark, d):
    s = view(spark, d, "v_symbols")
    name = s.filter("path = 'src/m2.ts'").groupBy("name").count().filter("count = 1").agg(F.min("name")).first()[0]
    return s, name


@query("+ " + ONE + " SELECT v.evidence_id, v.path, v.name, greatest(CASE WHEN v.signature IS NOT NULL THEN 0.95 ELSE 0.75 END, 1.0)::DOUBLE AS confidence FROM v_symbols v, q WHERE v.path = 'src/m2.ts' AND v.name = q.name", "v_symbols")
def symbol_detail(spark, d):
    s, name = _asked(spark, d)
    canonical = facts.settle_facts(facts.symbol_definitions(s))
    found = analysis.symbol_detail(s, canonical, view(spark, d, "v_facts"), "src/m2.ts", name)["symbol"]
    return found.select("evidence_id", "path", "name", "confidence")


@query("+ f AS (SELECT DISTINCT derived_fact_id, kind, to_id FROM v_facts WHERE from_id = 'O5' AND kind = 'caller-callee-candidate' UNION SELECT DISTINCT derived_fact_id, kind, from_id FROM v_facts WHERE to_id = 'O5' AND kind = 'caller-callee-candidate') SELECT derived_fact_id, kind, to_id AS other_id FROM f", "v_facts")
def symbol_relations(spark, d):
    f = view(spark, d, "v_facts")
    out, into = analysis.relations(f, "O5", "from"), analysis.relations(f, "O5", "to")
    return out.select("derived_fact_id", "kind", F.col("to_id").alias("other_id")).unionByName(into.select("derived_fact_id", "kind", F.col("from_id").alias("other_id"))).distinct()


@query(FACTS + ", t AS (SELECT min(name) AS name FROM c WHERE kind = 'symbol_export') SELECT fact_id, c.name AS label FROM c, t WHERE kind = 'symbol_export' AND c.name = t.name")
def symbol_contexts(spark, d):
    f = _canonical(spark, d)
    name = f.filter("kind = 'symbol_export'").agg(F.min(facts.payload("exportedName"))).first()[0]
    return analysis.contexts(f, ("symbol_export", "workflow"), name).select("fact_id", "label")


@query(FACTS + ", t AS (SELECT min(name) AS name FROM c WHERE kind = 'symbol_export') SELECT DISTINCT sha256('Symbol:' || c.name) AS node_id, path, c.name AS label FROM c, t WHERE kind = 'symbol_export' AND c.name = t.name")
def graph_contexts(spark, d):
    f = _canonical(spark, d)
    name = f.filter("kind = 'symbol_export'").agg(F.min(facts.payload("exportedName"))).first()[0]
    return analysis.graph_contexts(graph.project(None, f, None)[0], name).select("node_id", "path", "label")


# -- packages, partitions, chunks ---------------------------------------------------
@query("SELECT 'x/' || c_custkey || '/package.json' AS path, c_name AS package_name FROM customer")
def package_name(spark, d):
    return _packages(spark, d).select("path", parse.package_name(F.col("path"), F.col("content")).alias("package_name"))


@query("""WITH p AS (SELECT 'f' || l_orderkey AS path, l_linenumber * 100000 + l_suppkey AS idx, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS language, l_partkey FROM lineitem),
  g AS (SELECT path, idx, min(language) AS language, list_sort(list(DISTINCT l_partkey)) AS items FROM p GROUP BY path, idx)
  SELECT path, array_to_string(flatten(list(items ORDER BY idx)), ',') AS items, first(language ORDER BY idx) FILTER (language IS NOT NULL) AS language FROM g GROUP BY path""")
def merged_partitions(spark, d):
    parts = table(spark, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey")).alias("path"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("index"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("language"), "l_partkey")
    one = parts.groupBy("path", "index").agg(F.min("language").alias("language"), F.sort_array(F.collect_set("l_partkey")).alias("items"))
    return partition.merge_parsed(one, ("items",), ("language",)).select("path", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "language")


PLACED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::INT END AS start_line, CASE WHEN doc_id % 3 = 0 THEN doc_id::INT + 2 END AS end_line, CASE WHEN doc_id % 3 = 1 THEN (doc_id % 7)::INT END AS doc_offset, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 5 = 0 THEN '' END AS section FROM documents"


def _placed(spark, d) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, n.cast("int")).alias("start_line"), F.when(n % 3 == 0, n.cast("int") + 2).alias("end_line"), F.when(n % 3 == 1, (n % 7).cast("int")).alias("doc_offset"), F.when(n % 2 == 0, F.col("source")).when(n % 5 == 0, "").alias("section"))


@query(f"WITH p AS ({PLACED}) SELECT doc_id, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, coalesce(doc_offset, 0) AS doc_offset, coalesce(section, '') AS section, start_line IS NOT NULL AS has_code_location FROM p")
def location_flatten(spark, d):
    return store.flatten_locations(_placed(spark, d))


@query(f"WITH p AS ({PLACED}) SELECT doc_id, start_line::VARCHAR AS start_line, end_line::VARCHAR AS end_line, nullif(doc_offset, 0)::VARCHAR AS doc_offset, nullif(section, '') AS section FROM p")
def location_restore(spark, d):
    back = store.restore_locations(store.flatten_locations(_placed(spark, d)))
    return back.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("start_line", "end_line", "doc_offset")), "section")


@query("SELECT sha256(text) AS content_hash, array_to_string(list_transform(range(16), lambda i: round(CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER) / 255.0, 4)::DOUBLE::VARCHAR), ',') AS vector FROM documents")
def embed_batches(spark, d):
    """The embedder interface with a model of its own in each task, asked for 16 texts at a time."""

    def model():
        def encode(texts: list[str]) -> list[list[float]]:
            return [[b / 255 for b in hashlib.sha256(t.encode()).digest()] for t in texts]

        return encode

    made = embed.embed_with(table(spark, d, "documents").select(F.col("text").alias("content")), model, 16, 16)
    return made.select(text.content_hash(F.col("content")).alias("content_hash"), F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("string")), ",").alias("vector"))


@query("SELECT 'section' AS section, (c_custkey % 5 + c_custkey % 3)::BIGINT AS doc_offset, c_custkey FROM customer WHERE c_custkey % 5 + c_custkey % 3 > 0 UNION ALL SELECT 'section', 0, c_custkey FROM customer WHERE c_custkey % 5 + c_custkey % 3 = 0")
def location_augment(spark, d):
    """Offsets add up, sections are handed down."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("doc_offset"), F.lit("section").alias("section"), (F.col("c_custkey") % 3).alias("by"))
    place = chunk.shifted(F.col("doc_offset"), F.col("section"), F.col("by"), F.lit(None).cast("string"))
    return c.withColumn("p", place).select("p.section", F.col("p.doc_offset").cast("long").alias("doc_offset"), "c_custkey")


# -- sets and batches ---------------------------------------------------------------
@query("SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100)::BIGINT AS batch FROM orders")
def batched_rows(spark, d):
    return rows.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


# -- watch and state ------------------------------------------------------------------
@query(r"WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'src/' || user_id || '.ts' WHEN 1 THEN 'node_modules/' || user_id WHEN 2 THEN '' WHEN 3 THEN 'x/' || user_id || '.log' ELSE 'docs/' || user_id || '.md' END AS path FROM events) SELECT event_id, path FROM e WHERE path <> '' AND NOT regexp_matches(path, '^node_modules/') AND path NOT LIKE '%.log' AND path NOT LIKE 'docs/%'")
def watch_relevant(spark, d):
    n, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    path = F.when(n == 0, F.concat(F.lit("src/"), user, F.lit(".ts"))).when(n == 1, F.concat(F.lit("node_modules/"), user)).when(n == 2, "").when(n == 3, F.concat(F.lit("x/"), user, F.lit(".log"))).otherwise(F.concat(F.lit("docs/"), user, F.lit(".md")))
    return watch.relevant(table(spark, d, "events").select("event_id", path.alias("path")), ("docs/",)).select("event_id", "path")


@query("SELECT user_id, bool_or(event_type = 'signup') OR bool_or(event_type = 'view') OR max_by(event_type, (ts, event_id)) = 'error' AS needs_reindex FROM events GROUP BY user_id")
def status_of_many(spark, d):
    """The rule of the status over a table of index states, one for each user."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("stored"), F.bool_or(F.col("event_type") == "view").alias("pending"), F.max_by("event_type", F.struct("ts", "event_id")).alias("watcher"))
    return e.select("user_id", State.needs_reindex(F.col("stored"), F.col("pending"), F.col("watcher"), F.lit(False)).alias("needs_reindex"))


# -- symbols ---------------------------------------------------------------------------
@query(" SELECT evidence_id, name, row_number() OVER (PARTITION BY path, name ORDER BY CASE WHEN signature IS NOT NULL THEN 0 ELSE 1 END, start_line, evidence_id)::BIGINT AS place FROM v_symbols WHERE path = 'src/m1.ts' AND name = 'ring'", "v_symbols")
def symbol_candidates(spark, d):
    from pyspark.sql import Window

    found = analysis.matching_symbols(view(spark, d, "v_symbols"), "src/m1.ts", "ring")
    order = Window.orderBy(F.desc("confidence"), "start_line", "evidence_id")
    return found.select("evidence_id", "name", F.row_number().over(order).cast("long").alias("place"))

