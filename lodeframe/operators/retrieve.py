"""Exact vector search with deterministic ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..errors import EngineError

#: Fixed value: artifact kinds that win ties.
CONTEXT_KINDS = ("config", "doc", "lockfile", "schema", "script", "workflow")
DEFAULT_K, MOST_K, SNIPPET = 10, 50, 500
#: Fixed values of a search for many queries: pieces of the chunks at most, pairs from which there is one more, pairs measured at once, queries in a batch of output.
PIECES, PAIRS, TILE, OUT = 64, 4_000_000, 1 << 15, 1000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def score(distance: Column) -> Column:
    return F.when(distance.isNull() | F.isnan(distance) | (distance < 0), 0.0).otherwise(1.0 / (1.0 + distance))


def search(chunks: DataFrame, query: list[float] | None, k: int = DEFAULT_K, embed: Callable[[], list[float]] | None = None) -> DataFrame:
    """The k nearest chunks with distance and score, ties to the lesser chunk_key, then in order of rank: score, context artifacts first, chunk_key. Only k rows of a partition are shuffled. Without a vector ``embed`` is asked for one, unless k lets nothing through."""
    if k <= 0:
        return chunks.limit(0).withColumns({"distance": F.lit(0.0), "score": F.lit(0.0)})
    vector = F.array(*[F.lit(float(x)) for x in (embed() if query is None else query)])
    near = chunks.withColumn("distance", squared_distance(F.col("embedding"), vector)).withColumn("score", score(F.col("distance")))
    return near.orderBy(*nearest()).limit(k).orderBy(*ranking())


def nearest() -> list[Column]:
    return [F.desc("score"), F.asc("chunk_key")]


def ranking() -> list[Column]:
    return [F.desc("score"), F.desc(F.col("artifact_kind").isin(*CONTEXT_KINDS)), F.asc("chunk_key")]


def search_each(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank and the k nearest chunks for a stated set of queries (query_id, vector). Chunks are dealt over at most ``PIECES`` tasks, which hold a block of queries of so many bytes and k rows for each of them, and pass over their chunks once. So all pairs are measured, but none is sorted, and k rows of a piece and query are shuffled."""
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-(n * (8 * max(dims or 0, 0) + 256 * max(k, 0) + 64)) // block_bytes))
    pieces = min(PIECES, max(1, chunks.count() * n // PAIRS))
    dealt = chunks.repartition(pieces, "chunk_key")
    kept = [f for f in chunks.schema if f.name != "embedding"]
    shape = StructType([StructField("query_id", queries.schema["query_id"].dataType), *kept, StructField("distance", DoubleType()), StructField("score", DoubleType())])
    found = []
    for i in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        asked = some.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow()
        held = chunks.sparkSession.sparkContext.broadcast(asked)
        found.append(dealt.mapInArrow(_nearest_of(held, k, [f.name for f in kept]), shape))
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest()))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", near).filter(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking())))


def _nearest_of(held, k: int, kept: list[str]) -> Callable:
    """A function of a task's chunks that gives the k nearest of them for each held query. Squares are added in the order of the dimensions, as :func:`squared_distance` does, so that both give the same bits; rows are taken in the order of their keys, so that the first of equal scores stay."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        vectors = held.value.column("vector").to_pylist()
        turns: dict = {}  # queries by their number of dimensions; -1: no vector, or one with a null
        for q, v in enumerate(vectors):
            turns.setdefault(-1 if v is None or None in v else len(v), []).append(q)
        asked = {d: (np.array(qs), np.array([vectors[q] for q in qs], dtype=float).reshape(len(qs), d) if d >= 0 else None) for d, qs in turns.items()}
        best, least, types = [[] for _ in vectors], np.full(len(vectors), -1.0), {}
        for batch in batches if k > 0 else ():
            if not batch.num_rows:
                continue
            keys = [(x is not None, x) for x in batch.column("chunk_key").to_pylist()]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            keys, batch = [keys[i] for i in order], batch.take(pa.array(order, pa.int64()))
            types = {x: batch.schema.field(x).type for x in kept}
            lists = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).copy()
            flat = pc.list_flatten(lists)
            if flat.null_count:
                sizes[pc.list_parent_indices(lists).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
            rows: dict = {}
            for d, (qs, matrix) in asked.items():
                known = sizes == d if d >= 0 else np.zeros(len(keys), bool)
                at = np.flatnonzero(known)
                columns = np.ascontiguousarray(pc.list_flatten(lists.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d).T) if len(at) else None
                step = max(1, TILE // max(1, len(keys)))
                for a in range(0, len(qs), step):
                    some = qs[a : a + step]
                    distance = np.full((len(some), len(keys)), np.nan)
                    if len(at):
                        total, part = np.zeros((len(some), len(at))), np.empty((len(some), len(at)))
                        for j in range(d):
                            np.subtract(columns[j], matrix[a : a + step, j, None], out=part)
                            part *= part
                            total += part
                        distance[:, at] = total
                    scores = np.nan_to_num(1.0 / (1.0 + distance), nan=0.0)
                    for i in np.flatnonzero(scores.max(axis=1) >= least[some]):
                        q, s = some[i], scores[i]
                        bar = max(least[q], np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -1.0)
                        above = np.flatnonzero(s > bar)
                        level = np.flatnonzero(s == bar)[: max(0, k - len(above))]
                        new = [(-s[x], keys[x], distance[i, x] if known[x] else None, rows.setdefault(x, {})) for x in (*above.tolist(), *level.tolist())]
                        best[q] = sorted(best[q] + new, key=lambda e: e[:2])[:k]
                        if len(best[q]) == k:
                            least[q] = -best[q][-1][0]
            for x, row in zip(rows, batch.select(kept).take(pa.array(list(rows), pa.int64())).to_pylist()):
                rows[x].update(row)
        ids = held.value.column("query_id").combine_chunks()
        for a in range(0, len(best), OUT):
            found = [(q, e) for q in range(a, min(a + OUT, len(best))) for e in best[q]]
            if found:
                columns = {"query_id": ids.take(pa.array([q for q, _ in found], pa.int64()))} | {x: pa.array([e[3][x] for _, e in found], t) for x, t in types.items()}
                yield pa.RecordBatch.from_pydict(columns | {"distance": pa.array([e[2] for _, e in found], pa.float64(), from_pandas=False), "score": pa.array([-e[0] for _, e in found], pa.float64())})

    return run


def validate(query: str, k: int | None) -> tuple[str, int]:
    text = (query or "").strip()
    if not text:
        raise EngineError("INVALID_INPUT", "query must not be blank")
    if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k <= 0):
        raise EngineError("INVALID_INPUT", "top_k must be a positive integer")
    return text, min(k or DEFAULT_K, MOST_K)


def snippet(content: Column) -> Column:
    return F.substring(content, 1, SNIPPET)


def checked_locations(rows: DataFrame) -> DataFrame:
    """Fail if a code row lacks its lines or has a document place, or the other way round."""
    code, doc = F.col("start_line").isNotNull(), F.col("doc_offset").isNotNull() | F.col("section").isNotNull()
    ok = ((F.col("source_type") == "code") & code & ~doc) | ((F.col("source_type") == "doc") & ~code)
    return rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("INTERNAL_ERROR: evidence location"))))
