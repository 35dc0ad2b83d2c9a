"""Queries against their SQL on the smallest tables, and small cases of the operators."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodeframe.errors import EngineError
from lodeframe.functions import rows
from lodeframe.operators import analysis, chunk, facts, observe, parse, partition, retrieve, symbols
from lodeframe.operators.analysis import Anchor
from lodeframe.operators.observe import Rule
from lodeframe.operators.blocks import blocks_of
from lodeframe.plans import catalog
from lodeframe.sources.scan import classify, ignored
from lodeframe.streaming.state import State
from tests.run_query import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, name):
    got, odd = compare(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])
    assert odd is None


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_ignore_patterns(spark):
    paths = spark.createDataFrame([("node_modules/a.ts",), ("lib/x.log",), ("build/out/a.ts",), ("build/keep.ts",), ("src/a.ts",)], "path string")
    got = {r[0]: r[1] for r in paths.select("path", ignored(F.col("path"), ("build/", "!build/keep.ts"))).collect()}
    assert got == {"node_modules/a.ts": True, "lib/x.log": True, "build/out/a.ts": True, "build/keep.ts": False, "src/a.ts": False}


def test_classify(spark):
    files = spark.createDataFrame([("a.md", 1), ("package-lock.json", 9000), ("x.yml", 1), (".github/workflows/b.ts", 1)], "path string, size_bytes long")
    got = {r["path"]: (r["artifact_kind"], r["skip_reason"]) for r in classify(files, max_bytes=100).collect()}
    assert got == {"a.md": ("doc", None), "package-lock.json": ("lockfile", "too_large"), "x.yml": (None, "unsupported"), ".github/workflows/b.ts": ("workflow", None)}


def test_workflow_steps(spark):
    lines = spark.createDataFrame([("w", i, s) for i, s in enumerate(["- name: Lint", "  run: npm run lint", "  run: make", "- name: A", "- name: B", "  run: b"])], "path string, place int, line string")
    got = [(r["command"], r["name"], r["script_name"]) for r in parse.workflow_steps(lines).orderBy("place").collect()]
    assert got == [("npm run lint", "Lint", "lint"), ("make", "make", None), ("b", "B", None)]


def test_partitions(spark):
    docs = spark.createDataFrame([("a.md", "doc", "doc", "# A\n" + "x" * 9000 + "\n# B\ny"), ("b.ts", "code", "code", "l\n" * 3)], "path string, source_type string, artifact_kind string, content string")
    got = [(r["path"], r["index"], r["status"], r["doc_offset"], r["section"]) for r in partition.partition_documents(docs).orderBy("path", "index").collect()]
    assert got == [("a.md", 0, "partial", 0, "A"), ("a.md", 1, "complete", 1, "A"), ("a.md", 2, "complete", 1, "B"), ("b.ts", 0, "complete", None, None)]


def _windows_by_rule(lines, most, overlap):
    """Line windows taken one line at a time."""
    out, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= most):
            size, end = size + len(lines[end]) + 1, end + 1
        out.append((at + 1, end))
        if end >= len(lines):
            break
        back, kept = end, 0
        while overlap > 0 and back > 0 and (not kept or kept + len(lines[back - 1]) <= overlap):
            back, kept = back - 1, kept + len(lines[back - 1])
        at = max(at + 1, back)
    return [(a, z) for a, z in out if "\n".join(lines[a - 1 : z]).strip()]


def test_overlapped_windows():
    r = random.Random(1)
    for _ in range(500):
        lines = ["x" * r.choice([0, 0, 1, 3, 9, 20]) for _ in range(r.randint(1, 12))]
        b = chunk.Budget(r.choice([5, 10.5, 30]), r.choice([0, 2.5, 8]))
        assert [(a, z) for _, a, z in chunk._by_lines(lines, b)] == _windows_by_rule(lines, b.max_chars, b.overlap_chars)


def test_blocks_with_regex_and_templates():
    text = 'const r = /["{]/;\nfunction f() { return `a ${ `b { ${1}` } }`; }\nclass A { m() { return a / b / c; } }\nexport const x = 1\ntype T = {\n  a: string;\n} | null;\n'
    got = [(b["kind"], b["start_line"], b["end_line"]) for b in blocks_of(text)]
    assert got == [("lexical_declaration", 1, 1), ("function_declaration", 2, 2), ("class_declaration", 3, 3), ("export_statement", 4, 4), ("type_alias_declaration", 5, 7)]
    began = time.time()
    assert len(blocks_of("function f() { return 1; }\n" * 20_000)) == 20_000 and time.time() - began < 10


def _edges(spark, rows_):
    return spark.createDataFrame([(f"f{i}", "caller-callee-candidate", c, "p.ts", a, "SymbolCandidate", a, b, "SymbolCandidate", b) for i, (a, b, c) in enumerate(rows_)], "derived_fact_id string, kind string, confidence double, path string, from_id string, from_kind string, from_label string, to_id string, to_kind string, to_label string")


def _flow_by_rule(rows_, start, target, back, depth, nodes):
    """A queue of nodes, each asked once, whose edges are taken one by one."""
    queue, asked, out = [start], [], []
    while queue:
        at = queue.pop(0)
        if at in asked:
            continue
        if len(asked) >= nodes:
            return out, "truncated"
        asked.append(at)
        for i, (a, b, c) in sorted(enumerate(rows_), key=lambda e: (e[1][0 if back else 1], f"f{e[0]}")):
            here, there = (b, a) if back else (a, b)
            if here != at or f"f{i}" in [o[0] for o in out]:
                continue
            out.append((f"f{i}", here, there))
            if there == target:
                return out, "complete"
            if len(out) >= depth or len(asked) >= nodes:
                return out, "truncated"
            queue.append(there)
    return out, "ambiguous" if target and out else "partial"


def test_flow_against_a_queue(spark):
    r = random.Random(5)
    for _ in range(12):
        rows_ = [(r.choice("abcdefg"), r.choice("abcdefg"), r.choice([0.5, 0.7])) for _ in range(r.randint(0, 14))]
        edges = _edges(spark, rows_)
        depth, nodes, back, target = r.randint(1, 8), r.choice([1, 2, 3, 200]), r.random() < 0.3, r.choice([None, "g"])
        segments, summary = analysis.flow(edges, Anchor("symbol", "?", id="a"), Anchor("symbol", "?", id=target) if target else None, "backward" if back else "forward", ("calls",), depth, nodes)
        want, status = _flow_by_rule(rows_, "a", target, back, depth, nodes)
        assert [(s["edge_id"], s["from_id"], s["to_id"]) for s in segments] == want and summary["completeness"] == status, (rows_, depth, nodes, back, target)


def test_symbol_errors(spark):
    s = spark.createDataFrame([("i1", "f", "p.ts", None, 1), ("i2", "f", "p.ts", None, 2), ("i3", "g", "p.ts", "sig", 3)], "evidence_id string, name string, path string, signature string, start_line int")
    f = facts.settle_facts(facts.workflows(spark.createDataFrame([("w.yml", "g")], "path string, name string")))
    d = _edges(spark, [("i3", "i1", 0.5)])
    with pytest.raises(EngineError, match="SYMBOL_NOT_FOUND"):
        analysis.symbol_detail(s, f, d, "p.ts", "h")
    with pytest.raises(EngineError, match="AMBIGUOUS_SYMBOL"):
        analysis.symbol_detail(s, f, d, "p.ts", "f")
    found = analysis.symbol_detail(s, f, d, "p.ts", "g")
    assert found["callers"].count() == 1 and found["callees"].count() == 0 and [r["label"] for r in found["contexts"].collect()] == ["g"]
    s = s.withColumn("source_type", F.lit("code"))
    with pytest.raises(EngineError, match="ANCHOR_NOT_FOUND"):
        analysis.resolve(s, Anchor("symbol", "h"))
    with pytest.raises(EngineError, match="AMBIGUOUS_ANCHOR"):
        analysis.resolve(s, Anchor("symbol", "f"))
    assert analysis.resolve(s, Anchor("symbol", "g")).key == "i3" and analysis.resolve(s, Anchor("file", "x")).key == "file:x"


def test_rule_overrides(spark):
    lines = spark.createDataFrame([("a.ts", 0, "export function f(x) { g(x); }"), ("b.rb", 0, "f(x)")], "path string, place int, line string")
    own = {"rb": (Rule("rb.call", 0.5, "call", r"(\w+)\("),), "ts": ()}
    assert {(r["path"], r["name"]) for r in observe.by_rules(lines, own).collect()} == {("b.rb", "f")}
    assert {(r["kind"], r["name"]) for r in observe.by_rules(lines).collect() if r["kind"] != "reference"} == {("symbol_definition", "f"), ("call", "f"), ("call", "g")}


def test_search_of_blocks(spark):
    """Queries in blocks of bytes give what one block gives."""
    chunks = spark.createDataFrame([(f"c{i}", [float(i), 1.0], "code") for i in range(20)], "chunk_key string, embedding array<double>, artifact_kind string")
    queries = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(7)], "query_id long, vector array<double>")
    want = {tuple(r) for r in retrieve.search_each(chunks, queries, 3).select("query_id", "chunk_key", "rank").collect()}
    assert len(want) == 21 and want == {tuple(r) for r in retrieve.search_each(chunks, queries, 3, block_bytes=100).select("query_id", "chunk_key", "rank").collect()}
    assert retrieve.search(chunks, None, 0).count() == 0


def test_status_precedence(spark):
    states = spark.createDataFrame([("a", "complete"), ("a", "skipped"), ("b", "degraded"), ("b", "partial"), ("b", "failed"), ("c", "skipped"), ("c", "degraded")], "path string, status string")
    assert {tuple(r) for r in partition.status_rollup(states).collect()} == {("a", "skipped"), ("b", "failed"), ("c", "degraded")}


def test_chunk_split():
    b = chunk.budget(context=64, margin=16, max_tokens=16, overlap_tokens=8, depth=3)
    assert (b.max_chars, b.overlap_chars) == (40, 20)
    parts = list(chunk.split("one two three four five six seven\n\n" + "a" * 60, False, None, "x", b))
    assert parts[0] == ("one two three four five six seven", None, "x:paragraph") and all(len(p[0]) <= 40 for p in parts)
    assert list(chunk.split("a" * 60, False, None, "x", chunk.budget(max_tokens=16, policy="skip"))) == []


def test_blocks():
    got = blocks_of('import a from "a";\n\nexport class B {\n  m() { return "}"; }\n}\nconst f = (x) => {\n  return x;\n};\nfoo();\n')
    assert [(b["kind"], b["start_line"], b["end_line"]) for b in got] == [("import_statement", 1, 1), ("export_statement", 3, 5), ("lexical_declaration", 6, 8)]


def test_wins_and_sets(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in rows.last_wins(df, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.v) for r in rows.first_wins(df, ["k"], "seq").collect()} == {("a", "x"), ("b", "z")}
    assert {r.k for r in rows.first_groups(df, "k", "seq", 1).collect()} == {"a"}


def test_search_rules(spark):
    with pytest.raises(EngineError, match="INVALID_INPUT"):
        retrieve.validate("  ", None)
    assert retrieve.validate(" q ", 99) == ("q", 50)
    df = spark.createDataFrame([("b", [0.0], "code"), ("a", [0.0], "code"), ("c", [0.0], "doc")], "chunk_key string, embedding array<double>, artifact_kind string")
    assert [r.chunk_key for r in retrieve.search(df, [0.0], 3).collect()] == ["c", "a", "b"]


def test_state(tmp_path):
    clock = [0.0]
    s = State(str(tmp_path / "s"), lambda: clock[0])
    s.acquire("one")
    with pytest.raises(EngineError, match="ALREADY_RUNNING"):
        s.acquire("two")
    clock[0] += 3600
    s.acquire("two")
    s.release("one")
    s.assert_owned("two")
    s.release("two")
    s.running("two")
    assert s.recover() and s.read()["state"] == "error"
    s.completed("two", {"errors": 0}, "cfg")
    assert not s.status("cfg")["needs_reindex"] and s.status("other")["needs_reindex"]
    s.pending()
    assert s.status()["needs_reindex"]


def test_lone_workflow(spark):
    f = facts.workflows(spark.createDataFrame([("w.yml", "CI")], "path string, name string"))
    got = facts.derive(facts.settle_facts(f)).collect()
    assert [(r["kind"], r["from_id"], r["to_id"]) for r in got] == [("workflow-contains-job", "CI", "CI")]


def test_symbol_kinds(spark):
    df = spark.createDataFrame([("abstract_class_declaration",), ("foo_declaration",), ("statement_block",)], "k string")
    assert [r[0] for r in df.select(symbols.normalized_kind(F.col("k"))).collect()] == ["class", "foo", "block"]
