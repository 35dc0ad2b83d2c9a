"""End to end on small trees."""

import json
import threading
import time

import pytest

from lodeframe.config import git_branch
from lodeframe.engine import Config, Engine
from lodeframe.errors import EngineError
from lodeframe.log import logger
from lodeframe.operators.analysis import Anchor
from lodeframe.operators.blocks import blocks_of
from lodeframe.sources.store import Store
from lodeframe.streaming.state import HadoopFiles, LocalFiles, State
from lodeframe.streaming.watch import Watcher


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "README.md").write_text("# Intro\nHello there.\n# Next\nMore text.\n")
    (root / "main.ts").write_text('import { x } from "./x";\nexport const answer = 42;\n\nexport function greet(name: string) {\n  return `hi ${name}`;\n}\n')
    (root / "package.json").write_text('{"name": "demo", "scripts": {"lint": "eslint .", "check": "npm run lint"}, "dependencies": {"left": "1.0"}}')
    (root / "node_modules").mkdir()
    (root / "node_modules" / "a.ts").write_text("export const no = 1;")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, Config(root=str(tree), home=str(tmp_path_factory.mktemp("home")), project="project-a"))
    with pytest.raises(EngineError, match="INDEX_NOT_READY"):
        e.search("x")
    assert e.index("full")["files_indexed"] == 3
    return e


def test_questions(engine):
    names = {(r["name"], r["kind"]) for r in engine.symbols().collect()}
    assert {("answer", "variable"), ("greet", "function")} <= names
    hits = engine.search("hello", 2).collect()
    assert len(hits) == 2 and hits[0]["score"] >= hits[1]["score"]
    points = {(r["name"], r["kind"]) for r in engine.entrypoints().collect()}
    assert {("lint", "script"), ("check", "script")} <= points
    assert engine.symbol("main.ts", "greet")["symbol"].count() == 1
    found = engine.impact(Anchor("file", "main.ts", id="main.ts")).collect()
    assert found and all(r["side"] in ("from", "to") for r in found)
    segments, summary = engine.flow(Anchor("file", "main.ts", id="main.ts"), include=("imports",))
    assert [s["to_id"] for s in segments] == ["./x"] and summary["completeness"] == "partial"
    assert engine.slice(Anchor("file", "main.ts", id="main.ts"), max_files=1).count() >= 1
    with pytest.raises(EngineError, match="INVALID_INPUT"):
        engine.search("  ")


def test_store_filters(engine):
    rows = engine.store.read("symbols", path="main.ts", kind="function", source_type=None).collect()
    assert [r["name"] for r in rows] == ["greet"] and engine.store.read("symbols", path="none.ts").count() == 0 and engine.store.read("nothing") is None


def test_incremental(engine, tree):
    again = engine.index()
    assert (again["files_total"], again["files_indexed"]) == (3, 0)
    (tree / "README.md").unlink()
    (tree / "main.ts").write_text("export function other() {\n  return 1;\n}\n")
    third = engine.index()
    assert (third["files_total"], third["files_indexed"]) == (2, 1)
    assert {r["name"] for r in engine.symbols().collect()} == {"other"}
    assert engine.store.read("chunks").filter("path = 'README.md'").count() == 0


def test_ignored_folders_binary_files_and_order(spark, tmp_path):
    root = tmp_path / "t"
    for folder in ("dist/deep", "build", "src/inner", "src/.hidden", "node_modules"):
        (root / folder).mkdir(parents=True)
    (root / ".gitignore").write_text("build/\n# note\n*.tmp.ts\n")
    for name in ("dist/deep/a.ts", "build/b.ts", "src/c.ts", "src/inner/d.tmp.ts", "node_modules/e.ts", "z.md", "a.py", "pic.png", "src/__init__.py", "src/.hidden/f.md"):
        (root / name).write_text("export const a = 1;\n")
    (root / "bytes.txt").write_bytes(b"ok \xff\xfe end")
    e = Engine(spark, Config(root=str(root), home=str(tmp_path / "h"), project="p"))
    files, skipped = e.scan()
    rows = files.collect()
    assert [r["path"] for r in rows] == ["a.py", "bytes.txt", "src/.hidden/f.md", "src/__init__.py", "src/c.ts", "z.md"]
    assert [r["binary"] for r in rows] == [False, True, False, False, False, False] and "\ufffd" in rows[1]["content"]
    reasons = {r["path"]: r["reason"] for r in skipped.collect()}
    assert reasons["build"] == reasons["dist"] == reasons["node_modules"] == reasons["src/inner/d.tmp.ts"] == "ignored"
    assert reasons["src"] == "directory" and reasons["pic.png"] == reasons[".gitignore"] == "unsupported"


def test_failing_files(spark, tmp_path):
    """A file that can't be parsed is degraded, a lockfile that can't be is an error and keeps its old rows, and so does a file with too many symbols; the counts say so."""
    root = tmp_path / "t"
    root.mkdir()
    (root / "good.ts").write_text("export function good() {}\n")
    (root / "bad.ts").write_text("export function BROKEN() {}\n")
    (root / "many.ts").write_text("".join(f"const a{i} = {i};\n" for i in range(8)))

    def parser(text):
        if "BROKEN" in text:
            raise ValueError("no parse")
        return blocks_of(text)

    seen = []
    e = Engine(spark, Config(root=str(root), home=str(tmp_path / "h"), project="p", pair_symbols=5), parser=parser, on_progress=seen.append)
    out = e.index()
    assert (out["files_total"], out["files_indexed"], out["errors"]) == (3, 2, 1)
    status = {r["path"]: r["partition_status"] for r in e.store.read("manifest").collect()}
    assert status == {"good.ts": "complete", "bad.ts": "degraded"}
    assert [p["stage"] for p in seen][-1] == "manifest" and seen[-1]["done"] == seen[-1]["total"]
    assert e.status()["errors"] == 1 and e.status()["progress"] is None
    assert e.store.read("chunks").filter("path = 'bad.ts'").count() == 1
    again = e.index()
    assert (again["files_indexed"], again["errors"]) == (0, 1)
    e.delete("good.ts")
    assert e.store.read("symbols").filter("path = 'good.ts'").count() == 0 and e.index()["files_indexed"] == 1
    node = e.store.read("graph_edges").select("from_node_id").first()[0]
    assert e.edges_of(spark.createDataFrame([(node,)], "node_id string")).count() >= 1
    keys = [r["chunk_key"] for r in e.records().collect()]
    assert keys == sorted(keys)


def test_models_and_vectors(spark, tree, tmp_path):
    calls = []

    def model():
        return lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts]

    e = Engine(spark, Config(root=str(tree), home=str(tmp_path / "h"), project="p", dims=4), model=model)
    e.index()
    assert [len(r[0]) for r in e.store.read("chunks").select("embedding").collect()].count(4) == e.store.read("chunks").count()
    e.embedder = lambda c: calls.append(1)
    assert e.search("x", 1, vector=[1.0, 1.0, 2.0, 0.0]).count() == 1 and not calls


def test_merge_by_key_and_drift(spark, tmp_path):
    s = Store(spark, str(tmp_path), "P q", "Shared")
    assert s.base.endswith("/p_q_shared")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    s.merge("chunks", a, "k")
    s.merge("chunks", spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k")
    assert [tuple(r) for r in s.records("chunks", "k").collect()] == [("a", 1), ("b", 3), ("c", 4)]
    s.merge("chunks", spark.createDataFrame([("z", "x")], "k string, w string"), "k")
    assert [tuple(r) for r in s.read("chunks").collect()] == [("z", "x")]
    s.clear("chunks")
    assert s.read("chunks") is None


def test_config(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/Feature/One_a!\n")
    env = {"LODEFRAME_BRANCH_AWARE": "true", "LODEFRAME_CONTEXT": "512", "LODEFRAME_MARGIN": "32", "LODEFRAME_IGNORE": "a/, *.b", "LODEFRAME_PROJECT": " "}
    c = Config.from_env(str(tmp_path), "/h", env)
    assert (c.context, c.margin, c.ignore, c.scope) == (512, 32, ("a/", "*.b"), "branch") and c.identity.endswith("__feature-one_a")
    (tmp_path / ".git" / "HEAD").write_text("0123abc\n")
    assert git_branch(str(tmp_path)) is None and "__" not in Config.from_env(str(tmp_path), "/h", env).identity
    assert Config(str(tmp_path), "/h", project="x", branch_aware=True).scope == "shared" and Config("/r", "/h").fingerprint != Config("/r", "/h", dims=8).fingerprint
    for wrong in ({"margin": 3000}, {"max_tokens": 0}, {"context": -1}, {"split_policy": "x"}, {"max_tokens": 2000}, {"log_level": "loud"}):
        with pytest.raises(EngineError, match="INVALID_CONFIG"):
            Config("/r", "/h", **wrong)
    with pytest.raises(EngineError, match="INVALID_CONFIG"):
        Config.from_env("/r", "/h", {"LODEFRAME_DIMS": "many"})


def test_log_lines(tmp_path):
    out = logger("lodeframe.test", "info", str(tmp_path / "log.txt"), max_bytes=300, files=2)
    out.debug("not this")
    for i in range(6):
        out.info("something %d", i, extra={"metadata": {"event": "some.event", "n": i}})
    lines = [json.loads(x) for x in (tmp_path / "log.txt").read_text().splitlines()]
    assert lines[-1]["event"] == "some.event" and lines[-1]["metadata"]["n"] == 5 and lines[-1]["level"] == "info"
    assert (tmp_path / "log.txt.1").exists() and not (tmp_path / "log.txt.3").exists()
    logger("lodeframe.test", "error")


@pytest.fixture(params=["local", "hadoop"])
def state_files(request, spark):
    return LocalFiles() if request.param == "local" else HadoopFiles(spark)


def test_lock_takeover_and_renewal(tmp_path, state_files):
    clock = [0.0]
    a, b = (State(f"{tmp_path}/s", lambda: clock[0], state_files) for _ in range(2))
    a.acquire("one")
    with pytest.raises(EngineError, match="ALREADY_RUNNING"):
        b.acquire("two")
    clock[0] += 1700
    a.renew("one")
    clock[0] += 1700
    a.assert_owned("one")
    clock[0] += 200
    b.acquire("two")
    with pytest.raises(EngineError, match="LOCK_LOST"):
        a.renew("one")
    a.release("one")
    b.assert_owned("two")
    b.files.write(b.lock, "not a lock")
    a.acquire("three")
    a.release("three")
    assert a.files.read(a.lock) is None
    with a.held("four", every=0.01):
        time.sleep(0.1)
        a.assert_owned("four")
    assert a.files.read(a.lock) is None
    a.progress("four", "chunks", 1, 3, errors=2)
    assert a.read()["progress"]["done"] == 1 and a.read()["errors"] == 2


def test_watcher_bursts_and_followups(tmp_path):
    state, runs, gate = State(str(tmp_path / "s")), [], threading.Event()

    def run():
        runs.append(len(runs))
        if len(runs) == 2:
            gate.wait(5)
        if len(runs) == 4:
            raise EngineError("ALREADY_RUNNING", "busy")
        if len(runs) == 6:
            raise ValueError("broken")

    w = Watcher(state, run, gap=0.1, retry=0.1)
    for _ in range(4):
        w.notify()
        time.sleep(0.02)
    assert w.idle() and len(runs) == 1 and state.read()["pending_changes"]
    w.notify()
    while len(runs) < 2:
        time.sleep(0.01)
    for _ in range(3):
        w.notify()
    gate.set()
    assert w.idle() and len(runs) == 3  # one run after the busy one
    w.notify()
    assert w.idle() and len(runs) == 5 and state.read()["watcher_state"] == "watching"  # refused, then tried again
    w.notify()
    assert w.idle() and state.read()["watcher_state"] == "error" and state.status()["needs_reindex"]


def test_watch_stream(spark, tmp_path):
    state, runs = State(str(tmp_path / "s")), []
    source = tmp_path / "events"
    spark.createDataFrame([("2024-01-01 00:00:00", "src/a.ts"), ("2024-01-01 00:00:01", "node_modules/b.ts")], "ts string, path string").write.json(str(source))
    w = Watcher(state, lambda: runs.append(1), gap=0.05)
    q = w.start(spark.readStream.schema("ts timestamp, path string").json(str(source)), str(tmp_path / "c"), {"availableNow": True})
    q.awaitTermination(60)
    assert w.idle() and len(runs) == 1
