"""The test tables as records of the engine.

Each view is one SELECT in a dialect that Spark and DuckDB share, but for BYTES(x) and SHA(x), which each side spells its own way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_candidates": """
        SELECT doc_id, BYTES(text) AS size_bytes, text AS content, CASE doc_id % 25
          WHEN 0 THEN source || '/' || doc_id || '/package-lock.json' WHEN 1 THEN '.github/workflows/' || doc_id || '.ts' WHEN 2 THEN source || '/' || doc_id || '/package.json' WHEN 3 THEN 'node_modules/' || doc_id || '/a.ts'
          WHEN 4 THEN source || '/' || doc_id || '/tsconfig.json' WHEN 5 THEN '.devcontainer/' || doc_id || '.json' WHEN 6 THEN 'lib/node_modules/' || doc_id || '.ts' WHEN 7 THEN 'coverage/' || doc_id || '.md'
          ELSE source || '/' || lang || '/' || doc_id || CASE doc_id % 12 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.ts' WHEN 3 THEN '.json' WHEN 4 THEN '.sh' WHEN 5 THEN '.test.ts' WHEN 6 THEN '.yml' WHEN 7 THEN '.py' WHEN 8 THEN '.log' WHEN 9 THEN '.rs' WHEN 10 THEN '.spec.ts' ELSE '.TS' END END AS path
        FROM documents""",
    "v_docs": "SELECT source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.ts' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'doc' ELSE 'code' END AS source_type, CASE WHEN doc_id % 2 = 0 THEN 'doc' WHEN doc_id % 5 = 0 THEN 'lockfile' ELSE 'code' END AS artifact_kind, doc_id, text AS content FROM documents",
    "v_sections": "SELECT 'd/' || doc_id || '.md' AS path, doc_id, '# ' || replace(text, '. ', '\n# ') AS content FROM documents",
    "v_manifest_now": "SELECT source || '/' || doc_id AS path, SHA(text) AS fingerprint, doc_id FROM documents",
    "v_manifest_old": "SELECT CASE WHEN doc_id % 11 = 0 THEN 'gone/' || doc_id ELSE source || '/' || doc_id END AS path, CASE WHEN doc_id % 7 = 0 THEN SHA(text || '!') ELSE SHA(text) END AS fingerprint, doc_id FROM documents WHERE doc_id % 10 <> 0",
    "v_symbols": "SELECT SHA('p:' || p_partkey) AS evidence_id, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'variable' ELSE 'type' END AS kind, 'src/m' || CAST(floor(p_partkey / 20) AS BIGINT) || '.ts' AS path, p_size AS start_line, p_size + 3 AS end_line, CASE WHEN p_size % 3 <> 0 THEN p_type END AS signature, p_brand AS container_name, 'ts' AS language, 'code' AS source_type, p_partkey AS seq FROM part",
    "v_chunks": "SELECT SHA('v:' || vec_id) AS chunk_key, vec_id, 'c/' || label || '/' || vec_id AS path, embedding, CASE label % 9 WHEN 0 THEN 'code' WHEN 1 THEN 'config' WHEN 2 THEN 'doc' WHEN 3 THEN 'lockfile' WHEN 4 THEN 'schema' WHEN 5 THEN 'script' WHEN 6 THEN 'test' WHEN 7 THEN 'workflow' ELSE 'code' END AS artifact_kind FROM embeddings",
    "v_facts": """
        SELECT SHA(kind || ':' || from_id || ':' || to_id) AS derived_fact_id, kind, confidence, SHA('e:' || from_id) AS evidence_id, path, from_id, from_kind, from_id AS from_label, to_id, to_kind, to_id AS to_label FROM (
          SELECT 'caller-callee-candidate' AS kind, 0.55 AS confidence, 'src/o' || CAST(floor(l_orderkey / 50) AS BIGINT) || '.ts' AS path, 'L' || l_orderkey || '-' || l_linenumber AS from_id, 'SymbolCandidate' AS from_kind, 'O' || l_orderkey AS to_id, 'SymbolCandidate' AS to_kind FROM lineitem
          UNION ALL SELECT 'symbol-references-symbol-candidate', 0.6, 'src/o' || CAST(floor(o_orderkey / 50) AS BIGINT) || '.ts', 'O' || o_orderkey, 'SymbolCandidate', 'C' || o_custkey, 'SymbolCandidate' FROM orders
          UNION ALL SELECT 'file-imports-package', 0.95, 'src/c' || CAST(floor(c_custkey / 10) AS BIGINT) || '.ts', 'C' || c_custkey, 'File', 'N' || c_nationkey, 'Package' FROM customer
          UNION ALL SELECT 'file-imports-file', 0.9, 'src/s.ts', 'S' || s_suppkey, 'File', 'N' || s_nationkey, 'File' FROM supplier
          UNION ALL SELECT 'package-depends-on-package', 1.0, 'package.json', 'N' || n_nationkey, 'Package', 'R' || n_regionkey, 'Package' FROM nation
          UNION ALL SELECT 'task-runs-command', 0.9, 'tasks.json', 'P' || p_partkey, 'Task', p_brand, 'Command' FROM part
          UNION ALL SELECT 'quality-gate-runs-script-candidate', 0.8, 'gates.json', 'S' || s_suppkey, 'QualityGate', 'B' || (s_suppkey % 10), 'PackageScript' FROM supplier
          UNION ALL SELECT 'file-declares-entrypoint-candidate', 0.7, 'src/n.ts', 'N' || n_nationkey, 'File', n_name, 'Entrypoint' FROM nation
        ) AS f""",
    "v_scripts": "SELECT 'p/' || p_partkey || '/package.json' AS path, p_brand AS package_name, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'npm run ' || replace(p_name, ' ', '-') ELSE p_type END AS command, p_partkey AS seq FROM part",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = re.sub(r"\bSHA\(", "sha2x(", VIEWS[name]).replace("BYTES(", "octet_length(")
    text = _calls(text, "sha2x(", lambda x: f"sha2(encode({x}, 'utf-8'), 256)").replace("\n# ", "\\n# ")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"FROM (\w+)", text))}
    text = re.sub(r"FROM (\w+)", r"FROM {\1}", text)
    df = spark.sql(text, **tables)
    return df.withColumn("confidence", df["confidence"].cast("double")) if "confidence" in df.columns else df


def duck(name: str) -> str:
    text = VIEWS[name].replace("BYTES(", "strlen(").replace("SHA(", "sha256(").replace("'\n# '", "chr(10) || '# '").replace("AS confidence,", "::DOUBLE AS confidence,")
    return text


def duck_with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({duck(n)})" for n in names)


def _calls(text: str, head: str, wrap) -> str:
    """Rewrite calls with balanced brackets."""
    while (at := text.find(head)) >= 0:
        depth, i = 1, at + len(head)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:at] + wrap(text[at + len(head) : i - 1]) + text[i:]
    return text
