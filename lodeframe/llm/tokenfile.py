"""Token ids as flat unsigned integer files with 64-bit document offsets.

A token table is a folder. Part k has ``part-k.bin`` (ids, little endian, 16 bits where the vocabulary allows, else 32), ``part-k.off`` (int64 offsets into the part: one per document and the end) and ``part-k.doc`` (int64 document ids, the least value for null). Parts hold ascending ranges of document ids, so the place of a document in the whole table is its part's base, a prefix sum over the parts' sizes, plus its own offset. Every file can be memory-mapped.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, file_tokenizer
from .common import docs_of, pieces, scratch, text_volume, tidied

NULL_ID = np.iinfo(np.int64).min
#: Beyond so many parts they grow and not their number, which the driver reads.
MOST_PARTS = 20_000


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a token table and return part, documents, tokens for each part.

    Ids ascend over the whole table; rows with the same id stand in the order of their texts, null ids first. A null or empty text has only the end id. A part is written under a name of its own attempt and then moved, so repeated attempts leave the same files. An empty table gives no parts.
    """
    volume = text_volume(docs, text_col)[1]
    n = max(1, -(-volume // max(part_bytes, volume // MOST_PARTS)))
    wide = max(file_tokenizer(tokenizer_path).get_vocab_size(), end_id or 0) > 1 << 16
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterable[pa.RecordBatch]):
        context = TaskContext.get()
        part = context.partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        names = {x: f"{base}/part-{part:06d}.{x}" for x in ("bin", "off", "doc")}
        trial = {x: f"{base}/_try-{context.taskAttemptId()}.{x}" for x in names}
        encoder, n_docs, n_tokens = codec(tokenizer_path)[0], 0, 0
        out = {x: store.open_output_stream(p) for x, p in trial.items()}
        for piece in pieces(batches, 4_000_000):
            ids, counts = encoder.encode(piece.column(1))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            out["off"].write((n_tokens + np.cumsum(counts) - counts).astype("<i8").tobytes())
            out["doc"].write(np.asarray(piece.column(0).fill_null(int(NULL_ID))).astype("<i8").tobytes())
            out["bin"].write(ids.astype(kind).tobytes())
            n_docs += len(counts)
            n_tokens += int(counts.sum())
        out["off"].write(np.array([n_tokens], "<i8").tobytes())
        for x in out.values():
            x.close()
        for x, p in trial.items():
            if n_docs:
                store.move(p, names[x])
            else:
                store.delete_file(p)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": [n_docs], "tokens": [n_tokens], "kind": [kind]})

    rows = docs_of(docs, id_col, text_col)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidied(run, codecs=True), "part int, documents long, tokens long, kind string")


def _mapped(store: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, folder: str, parts: list[tuple[int, int, str]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) of a token table. parts: number, tokens, kind of each part in order; their prefix sums are the bases. Documents without a token of text have their end alone; null ids read as null; no parts give no rows."""
    bases = accumulate((t for _, t, _ in parts), initial=0)
    todo = [(int(p), int(b), k) for (p, _, k), b in zip(parts, bases)]

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/part-{row['part']:06d}"
                ids, offsets, docs = (_mapped(store, f"{name}.{x}", k) for x, k in (("bin", row["kind"]), ("off", "<i8"), ("doc", "<i8")))
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64(), mask=docs == NULL_ID), "start": row["base"] + np.asarray(offsets[:-1]), "n_tokens": np.diff(offsets), "ids_crc32": pa.array(crcs, pa.int64())})

    schema = "part int, base long, kind string"
    if not todo:
        return spark.range(0).selectExpr("id AS doc_id", "id AS start", "id AS n_tokens", "id AS ids_crc32")
    return spark.createDataFrame(todo, schema).repartition(len(todo), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_tokens(spark, sf_dir):
    folder = scratch(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    parts = sorted(tuple(r) for r in manifest.select("part", "tokens", "kind").collect())
    return read_tokens(spark, folder, parts)
