"""The engine: index a tree, then ask."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import EngineError
from .functions.rows import diff
from .functions.text import content_hash
from .log import logger
from .operators import analysis, blocks, chunk, embed, facts, graph, observe, parse, partition, retrieve, symbols
from .operators.analysis import Anchor
from .sources.scan import in_order, scan
from .sources.store import TABLES, Store, flatten_locations, restore_locations
from .streaming.state import State, files_for, now
from .streaming.watch import Watcher

__all__ = ["Config", "Engine"]


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder: Callable[[DataFrame], DataFrame] | None = None, model: Callable | None = None, parser: Callable = blocks.blocks_of, on_progress: Callable[[dict], None] | None = None):
        """``embedder`` adds the column embedding to rows with content; or ``model`` makes, once in each task, a function from a batch of texts to vectors."""
        self.spark, self.config, self.parser, self.on_progress = spark, config, parser, on_progress
        self.store = Store(spark, config.home, config.identity, config.scope)
        self.state = State(f"{self.store.base}/state", files=files_for(self.store.base, spark))
        self.log = logger(level=config.log_level)
        if model is not None:
            embedder = lambda c: embed.embed_with(c, model, config.embed_batch, config.dims)
        self.embedder = embedder or (lambda c: c.withColumn("embedding", embed.deterministic(F.col("content"), config.dims)))

    # -- indexing ---------------------------------------------------------
    def scan(self) -> tuple[DataFrame, DataFrame]:
        """Candidates by path, and skipped paths with their reasons."""
        c = self.config
        files, skipped = scan(self.spark, c.root, c.ignore_files, c.ignore, max_bytes=c.max_bytes, skip_oversize=c.skip_oversize, extended=c.extended_extensions)
        return in_order(files), skipped

    def index(self, mode: str = "incremental") -> dict:
        if mode not in ("full", "incremental", "rebuild"):
            raise EngineError("INVALID_INPUT", f"mode {mode}")
        accepted, run = now(), str(uuid.uuid4())
        self.state.recover()
        with self.state.held(run):
            try:
                self.state.running(run)
                counters = self._run(run, mode)
                self.state.assert_owned(run)
                self.state.completed(run, counters, self.config.fingerprint)
            except Exception as e:
                self.state.failed(str(e)[:500])
                self.log.error("index failed", extra={"metadata": {"event": "index.failed", "run": run, "error": str(e)[:500]}})
                raise
        self.log.info("index completed", extra={"metadata": {"event": "index.completed", "run": run, **counters}})
        return {"accepted_at": accepted, "index_run_id": run, "mode": mode, "state": "idle", **counters}

    def watch(self, events: DataFrame, checkpoint: str, **options):
        """Index incrementally after each burst of a stream of (ts, path)."""
        watcher = Watcher(self.state, self.index, self.config.ignore, **options)
        return watcher, watcher.start(events, checkpoint)

    def _run(self, run: str, mode: str) -> dict:
        c, store = self.config, self.store
        if mode == "rebuild":
            store.clear()
        staging = f"{store.base}/staging-{run}"

        def stage(df: DataFrame, name: str) -> DataFrame:
            """Written once and read again: what follows starts from a scan and not from the whole plan before it."""
            df.write.parquet(f"{staging}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{staging}/{name}")

        files, _ = scan(self.spark, c.root, c.ignore_files, c.ignore, max_bytes=c.max_bytes, skip_oversize=c.skip_oversize, extended=c.extended_extensions)
        try:
            files = stage(files.withColumn("fingerprint", content_hash(F.col("content"))), "files")
            old = store.read("manifest")
            old = old.select("path", "fingerprint") if old is not None else files.select("path", "fingerprint").limit(0)
            status = stage(diff(files.select("path", "fingerprint"), old), "status")
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # four rows at most
            found, failed = counts.get("new", 0) + counts.get("changed", 0), 0
            if counts.keys() - {"unchanged"}:
                touched = status.filter("status IN ('changed', 'new', 'stale')").select("path")
                todo = files.join(status.filter("status IN ('changed', 'new')"), "path", "left_semi")
                failed = self._write(todo, touched, run, stage)
            return {"files_total": sum(n for k, n in counts.items() if k != "stale"), "files_indexed": found - failed, "errors": failed}
        finally:
            store.drop(staging)

    def _write(self, files: DataFrame, touched: DataFrame, run: str, stage: Callable) -> int:
        """Write the rows of new and changed files, drop those of stale ones, and return how many files failed. A failed file keeps its old rows and is tried again by the next run, for its manifest row stays as it was."""
        c, store = self.config, self.store
        read = stage(blocks.with_blocks(files.select("path", "source_type", "artifact_kind", "content", "binary"), self.parser), "read")
        crowd = facts.crowded(read.filter("blocks IS NOT NULL").select("path", F.explode("blocks")), c.pair_symbols)
        whole = F.col("parse_error").isNotNull() & (F.col("artifact_kind") == "lockfile")
        bad = stage(read.filter(whole).select("path", F.col("parse_error").alias("error")).unionByName(crowd.select("path", F.concat(F.lit("more than "), F.lit(c.pair_symbols), F.lit(" symbols")).alias("error"))), "failed")
        failed = bad.count()
        for r in bad.limit(20).collect():
            self.log.warning("file failed", extra={"metadata": {"event": "file.failed", "path": r["path"], "error": r["error"]}})
        if failed:
            touched, files, read = (x.join(bad.select("path"), "path", "left_anti") for x in (touched, files, read))
        docs = read
        parts = stage(partition.partition_documents(docs), "parts")
        budget = chunk.budget(c.context, c.margin, c.max_tokens, c.overlap_tokens, c.split_depth, c.split_policy)
        chunks = self.embedder(chunk.attribute(chunk.identify(chunk.chunk(docs, budget), c.identity), parts))
        found = docs.filter("blocks IS NOT NULL").select("path", "source_type", F.posexplode("blocks").alias("seq", "b")).select("path", "source_type", "seq", "b.*").withColumn("language", parse.language(F.col("path")))
        syms = stage(symbols.symbols_of(found, c.identity).withColumns({"signature": F.lit(None).cast("string"), "container_name": F.lit(None).cast("string"), "source_type": F.lit("code")}), "symbols")
        scripts, flows = parse.package_scripts(docs), docs.filter("artifact_kind = 'workflow'")
        steps = stage(parse.workflow_steps(parse.document_lines(flows)), "steps")
        gates = parse.quality_gates(scripts, steps)
        chosen = observe.analyzers(docs.select("path", "source_type", "artifact_kind", "content"))
        script_lines = parse.document_lines(chosen.filter("deep"))
        rule_lines = parse.document_lines(chosen.filter("by_rules"))
        names = chosen.filter("by_artifact")
        base = stage(observe.repository(names, scripts.join(names.select("path"), "path", "left_semi"), steps, gates), "repository")
        generic = found.join(chosen.filter("generic").select("path"), "path", "left_semi")
        seen = stage(observe.settle(observe.blocks(generic), observe.modules(chosen.filter("by_rules")), observe.by_rules(rule_lines), observe.script_lines(script_lines), base), "observations")
        of = lambda kind: base.filter(F.col("kind") == kind)
        canonical = facts.settle_facts(
            facts.symbol_definitions(syms), facts.symbol_exports(seen.filter("kind = 'symbol_export'")), facts.workflows(of("workflow")), facts.config_artifacts(of("config_artifact").withColumn("artifact_kind", F.col("symbol_kind"))), facts.workspace_tasks(scripts),
            facts.file_imports(parse.imports(docs)), facts.package_dependencies(parse.package_dependencies(docs)), facts.package_scripts(scripts), facts.workflow_steps(steps), facts.quality_gates(gates),
        )
        canonical = stage(canonical, "canonical")
        derived = stage(facts.derive(canonical, syms), "derived")
        nodes, edges = graph.project(syms, canonical, derived)
        about = observe.files(docs, run).select("evidence_id", "kind", "confidence", F.col("language").alias("name"), F.lit(None).cast("string").alias("symbol_kind"), "path")
        rows = {
            "chunks": flatten_locations(chunks), "symbols": syms, "observations": seen.unionByName(about), "canonical_facts": canonical, "derived_facts": derived, "graph_nodes": nodes, "graph_edges": edges, "overlay_edges": graph.overlay_edges(derived), "overlay_nodes": None,
            "manifest": files.select("path", "fingerprint", "size_bytes", F.lit(run).alias("index_run_id"), F.current_timestamp().alias("last_indexed_at")).join(partition.status_rollup(parts).withColumnRenamed("status", "partition_status"), "path", "left"),
        }
        for k, table in enumerate(TABLES):  # the manifest comes last: a run that breaks off is done again
            if table == "overlay_nodes":
                store.replace(table, graph.overlay_nodes(store.read("overlay_edges")))
            else:
                store.upsert_by_path(table, rows[table], touched)
            self.state.progress(run, table, k + 1, len(TABLES), errors=failed)
            if self.on_progress:
                self.on_progress({"run": run, "stage": table, "done": k + 1, "total": len(TABLES), "errors": failed})
        return failed

    # -- questions --------------------------------------------------------
    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise EngineError("INDEX_NOT_READY", f"no table {name}")
        return df

    def status(self) -> dict:
        return self.state.status(self.config.fingerprint)

    def search(self, query: str, top_k: int | None = None, vector: list[float] | None = None) -> DataFrame:
        """The nearest chunks. The query is embedded only if no vector is given."""
        text, k = retrieve.validate(query, top_k)
        self.state.require_ready()
        ask = lambda: list(self.embedder(self.spark.range(1).select(F.lit(text).alias("content"))).select("embedding").first()[0])
        rows = retrieve.checked_locations(restore_locations(retrieve.search(self._table("chunks"), vector, k, ask)))
        return rows.select("chunk_key", "path", "artifact_kind", "source_type", "score", "start_line", "end_line", "doc_offset", "section", retrieve.snippet(F.col("content")).alias("snippet"))

    def records(self) -> DataFrame:
        """All chunks by their key."""
        return restore_locations(self.store.records("chunks", "chunk_key"))

    def edges_of(self, nodes: DataFrame) -> DataFrame:
        """Graph edges that touch any of a table of node ids."""
        return graph.edges_by_nodes(self._table("graph_edges"), nodes)

    def delete(self, path: str) -> None:
        """Forget a path in every table; the next run finds it as new."""
        for table in reversed(TABLES):  # the manifest first
            if table != "overlay_nodes":
                self.store.delete_by_path(table, path)
        if (edges := self.store.read("overlay_edges")) is not None:
            self.store.replace("overlay_nodes", graph.overlay_nodes(edges))

    def symbols(self, kind=None, path=None, query=None, source_type=None) -> DataFrame:
        self.state.require_ready()
        return symbols.ranked(self._table("symbols"), query, kind, path, source_type)

    def symbol(self, path: str, symbol: str) -> dict[str, DataFrame]:
        self.state.require_ready()
        return analysis.symbol_detail(self._table("symbols"), self._table("canonical_facts"), self._table("derived_facts"), path, symbol, self._table("graph_nodes"))

    def entrypoints(self, confidence_min=0.0, kind=None, limit=None, package=None, path=None, query=None) -> DataFrame:
        self.state.require_ready()
        return analysis.entrypoints(self._table("canonical_facts"), self._table("symbols"), self._table("derived_facts"), query, kind, path, package, confidence_min, limit)

    def _anchor(self, anchor: Anchor) -> Anchor:
        return analysis.resolve(self._table("symbols"), anchor)

    def flow(self, start: Anchor | None = None, to: Anchor | None = None, direction="forward", include=(), max_depth=None, max_nodes=None, time_budget_ms=None, confidence_min=None) -> tuple[list[dict], dict]:
        self.state.require_ready("ANALYSIS_NOT_READY")
        if start is None:
            raise EngineError("INVALID_INPUT", "flow needs a start")
        return analysis.flow(self._table("derived_facts"), self._anchor(start), self._anchor(to) if to else None, direction, tuple(include), max_depth, max_nodes, time_budget_ms)

    def impact(self, target: Anchor, mode="all", confidence_min=0.0, max_depth=None, max_results=None) -> DataFrame:
        self.state.require_ready("ANALYSIS_NOT_READY")
        return analysis.impact(self._table("derived_facts"), self._anchor(target), mode, confidence_min or 0.0, max_results)

    def slice(self, criterion: Anchor, direction="both", include=(), max_evidence=None, max_files=None, max_nodes=None) -> DataFrame:
        self.state.require_ready("ANALYSIS_NOT_READY")
        return analysis.evidence_slice(self._table("derived_facts"), self._anchor(criterion), direction, tuple(include), max_files, max_nodes or max_evidence)
