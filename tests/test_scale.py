"""Steps that once grew faster than their input: what is sorted, joined and shuffled, and that the results are those of the plain rule."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodeframe.functions.rows import last_wins
from lodeframe.functions.text import packed, unpacked
from lodeframe.operators import facts, graph, retrieve


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_queries_against_a_plain_rule(spark):
    """Ties, vectors of other lengths, nulls and NaN rank as by the columns of the single search; no pairs are made for a sort."""
    r = random.Random(3)
    vector = lambda: r.choice([None, [], [1.0], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], *[[float(r.randint(0, 2)) for _ in range(3)] for _ in range(9)]])
    chunks = spark.createDataFrame([(f"c{i}", vector(), r.choice(["code", "doc"])) for i in r.sample(range(300), 300)], "chunk_key string, embedding array<double>, artifact_kind string").repartition(3)
    queries = spark.createDataFrame([(i, vector()) for i in range(30)], "query_id long, vector array<double>")
    pairs = [(q, [p for p in rows]) for q, rows in _by_query(chunks, queries).items()]
    want = set()
    for q, rows in pairs:
        near = sorted(rows, key=lambda p: (-p["score"], p["chunk_key"]))[:7]
        for rank, p in enumerate(sorted(near, key=lambda p: (-p["score"], p["artifact_kind"] != "doc", p["chunk_key"])), 1):
            want.add((q, p["chunk_key"], p["artifact_kind"], str(p["distance"]), p["score"], rank))
    got = retrieve.search_each(chunks, queries, 7)
    assert {(x["query_id"], x["chunk_key"], x["artifact_kind"], str(x["distance"]), x["score"], x["rank"]) for x in got.collect()} == want and len(want) == 210
    assert "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)
    assert retrieve.search_each(chunks, queries, 0).count() == 0 and retrieve.search_each(chunks, queries.limit(0), 7).count() == 0


def _by_query(chunks, queries) -> dict:
    far = retrieve.squared_distance(F.col("embedding"), F.col("vector"))
    out: dict = {}
    for p in chunks.crossJoin(queries).withColumn("distance", far).withColumn("score", retrieve.score(F.col("distance"))).collect():
        out.setdefault(p["query_id"], []).append(p)
    return out


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """More files make more tasks, not larger ones, and a file's pairs stay in one of them."""
    monkeypatch.setattr(facts, "PAIRS", 500, raising=False)
    symbols = spark.createDataFrame([(f"f{i}", f"i{i}-{j}", f"n{j}", "function" if j < 2 else "class") for i in range(200) for j in range(5)], "path string, evidence_id string, name string, kind string").coalesce(1)
    pairs = facts.symbol_pairs(symbols).select("path", "kind", "from_id", "to_id", F.spark_partition_id().alias("task")).collect()
    assert {p[:4] for p in map(tuple, pairs)} == {(f"f{i}", k, f"i{i}-{a}", f"i{i}-{b}") for i in range(200) for a in range(5) for b in range(5) if a != b for k in ("symbol-references-symbol-candidate", "caller-callee-candidate") if a < 2 and b < 2 or k[0] == "s"}
    tasks = Counter(p["task"] for p in pairs)
    assert len(pairs) == 200 * 22 and max(tasks.values()) < 1500 and len({(p["path"], p["task"]) for p in pairs}) == 200
    assert facts.symbol_pairs(symbols.limit(0)).count() == 0


HEX = hashlib.sha256(b"x").hexdigest()
ODD = ["a", "", "b:c", HEX, HEX.upper(), HEX + "\n", HEX[:63], "é" * 31, "x" * 32, "x" * 33, "\x01" + HEX]


def _sha(*parts):
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


def _derived(spark):
    """Facts with odd names, several of one edge or node, whose ids sort otherwise as text than packed."""
    r, ties = random.Random(7), [f"{i}" for i in range(200)] + [_sha(str(i)) for i in range(200)]
    rows = [(t, r.choice("kl"), r.random(), r.choice("pq"), *(x for _ in "ab" for x in (r.choice(ODD), r.choice(["A", "A:b", "S"]), r.choice(ODD))), r.choice(ODD)) for t in r.sample(ties, 400)]
    rows += [(f"t{i}", *rows[i][1:]) for i in range(50)]
    return rows, spark.createDataFrame(rows, "derived_fact_id string, kind string, confidence double, path string, from_id string, from_kind string, from_label string, to_id string, to_kind string, to_label string, evidence_id string")


def test_packed_texts(spark):
    df = spark.createDataFrame([(x,) for x in [None, *ODD]], "x string").select("x", packed(F.col("x")).alias("p"))
    rows = df.select("x", "p", unpacked(F.col("p")).alias("y")).collect()
    assert all(x["x"] == x["y"] for x in rows) and len({x["p"] for x in rows}) == len(rows)
    assert {len(x["p"]) for x in rows if x["x"] == HEX} == {33}


def test_graph_against_a_plain_rule(spark):
    rows, df = _derived(spark)
    nodes, edges = {}, {}
    for t, kind, sure, path, a, ak, al, b, bk, bl, e in sorted(rows, key=lambda x: x[0].encode()):
        edges[_sha(_sha(ak, a), kind, _sha(bk, b)), path] = (_sha(ak, a), kind, _sha(bk, b), e, sure)
    for seq in (0, 1):
        for t, _, _, path, *ends, _ in sorted(rows, key=lambda x: x[0].encode()):
            name, kind, label = ends[3 * seq : 3 * seq + 3]
            nodes[_sha(kind, name), path] = (kind, label)
    n, e = graph.project(None, None, df)
    assert {(x["node_id"], x["path"]): (x["kind"], x["label"]) for x in n.collect()} == nodes and n.count() == len(nodes)
    assert {(x["edge_id"], x["path"]): (x["from_node_id"], x["kind"], x["to_node_id"], x["evidence_id"], x["confidence"]) for x in e.collect()} == edges and e.count() == len(edges)


def test_rows_are_ranked_after_the_shuffle(spark):
    """What a task reads is not sorted: it is larger than a task's memory, and most keys stand once."""
    _, df = _derived(spark)
    kinds = spark.createDataFrame([("p", str(i), "c") for i in range(9)], "path string, name string, command string")
    for ranked in (*graph.project(None, None, df), facts.settle_facts(facts.workspace_tasks(kinds)), last_wins(df, ["path"], "kind")):
        assert "Exchange" in plan(ranked) and not re.search("Sort|WindowGroupLimit", plan(ranked).split("Exchange")[-1])


def test_nodes_reach_the_scan(spark, monkeypatch):
    """Edges of one node or a few are sought before edges are shuffled, and many nodes give the same by joins."""
    rows, df = _derived(spark)
    edges = graph.project(None, None, df)[1]
    some = [_sha(rows[i][5], rows[i][4]) for i in range(3)] + ["none"]
    nodes = spark.createDataFrame([(x,) for x in some], "node_id string")
    want = {(x["edge_id"], x["path"]) for x in edges.collect() if x["from_node_id"] in some or x["to_node_id"] in some}
    few = graph.edges_by_nodes(edges, nodes)
    assert some[0] in plan(graph.edges_by_node(edges, some[0])).split("Exchange")[-1] and "Join" not in plan(few)
    monkeypatch.setattr(graph, "FEW", 3, raising=False)
    for hits in (few, graph.edges_by_nodes(edges, nodes)):
        assert {tuple(x) for x in hits.select("edge_id", "path").collect()} == want and hits.count() == len(want) > 0
