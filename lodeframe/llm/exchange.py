"""Corpus-wide counts of hashed items, brought back to where they are needed.

Texts are read and cut into words once: a block row holds some documents as numbers into the list of its distinct words' hashes, and the table of blocks is written, so that both passes over it see the same rows whatever executors are lost. A block sends the sorted distinct hashes of its items, packed and cut by hash range, one row for each range; the task of a range adds up what all blocks sent and answers each with the totals of just its items, in the order it sent them. So no task holds the whole table, a very common item costs one entry per block, and nothing is broadcast. Totals cover every document.

A block is cut into ``FAN`` ranges at most, so the rows grow with the corpus and not with its square. Where ranges of ``RANGE_BYTES`` of text would be more than that, the exchange takes two levels: the packets of a range are gathered into chunks that are cut again, counted by the finer range, and dealt back the same way.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidied, tidied_groups

#: Constants of the splitmix64 finaliser.
M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text in a block and (about) in a range, most ranges of one level and bytes of a chunk between the levels.
BLOCK_BYTES, RANGE_BYTES, FAN, CHUNK_BYTES = 6 << 20, 16 << 20, 4096, 32 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str] | list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


# -- blocks ---------------------------------------------------------------
BLOCK = "block long, doc_id array<long>, chosen array<boolean>, sizes array<int>, words binary, ids binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("chosen", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("ids", pa.binary())])


class Words:
    """Some documents' words: ``hashes`` of the distinct ones, ``ids`` of all in order and ``sizes`` of the documents."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.hashes, self.ids, self.sizes = hashes, ids, sizes

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        """Bytes have white space and capital letters of ASCII alone, which is what words are defined by."""
        words = [t.lower().split() for t in texts]
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        often = np.argsort(-np.bincount(ids, minlength=len(numbers)), kind="stable")  # small numbers for frequent words
        place = np.empty_like(often)
        place[often] = np.arange(len(often))
        return cls(mix(word_hashes(list(numbers)))[often], place[ids], sizes)


def word_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Block rows of docs (doc_id, text without nulls, chosen): texts of about ``block_bytes`` each, one document at least. A block's name is drawn at random, so the table must be written before it is read twice; a task may run this over several partitions, so their numbers would not tell blocks apart."""

    def run(batches):
        for piece in pieces(batches, block_bytes):
            words = Words.of(piece.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((int.from_bytes(os.urandom(8)) >> 1, piece.column(0).to_pylist(), piece.column(2).to_pylist(), words.sizes.astype(np.int32), words.hashes.astype("<u8").tobytes(), _planes(words.ids)), BLOCK_ARROW.types)],
                schema=BLOCK_ARROW,
            )

    return docs.select("doc_id", "text", "chosen").mapInArrow(tidied(run), BLOCK)


def read_block(table: pa.Table) -> tuple[Words, list, list]:
    """Words, ids and flags of the one block row of a table."""
    row = table.select(BLOCK_ARROW.names).slice(0, 1).to_pylist()[0]
    sizes = np.array(row["sizes"], np.int64)
    return Words(np.frombuffer(row["words"], "<u8"), _unplaned(row["ids"], int(sizes.sum())).astype(np.int64), sizes), row["doc_id"], row["chosen"]


# -- packets --------------------------------------------------------------
def ranges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ends of the n hash ranges within sorted hashes."""
    first = [-(-(i << 64) // n) for i in range(1, n)]
    return np.append(np.searchsorted(hashes, np.array(first, np.uint64), "left"), len(hashes)) if n > 1 else np.array([len(hashes)])


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold them all, byte by byte (all lowest ones first) and compressed, behind a byte that tells how many."""
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()
    return bytes([size]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unplaned(data: bytes, n: int) -> np.ndarray:
    size, out = data[0], np.zeros((n, 8), np.uint8)
    if n:
        out[:, :size] = np.frombuffer(pa.decompress(data[1:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T
    return out.view("<u8").ravel()


def pack(hashes: np.ndarray, width: int) -> bytes:
    """Sorted hashes, cut to their first ``width`` bytes: how many, the first, and the gaps."""
    top = hashes >> np.uint64(64 - 8 * width)
    return len(top).to_bytes(4, "little") + top[:1].astype("<u8").tobytes() + _planes(np.diff(top)) if len(top) else b""


def unpack(data: bytes, width: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    gaps = _unplaned(data[12:], int.from_bytes(data[:4], "little") - 1)
    return np.cumsum(np.concatenate([np.frombuffer(data[4:12], "<u8"), gaps]), dtype=np.uint64) << np.uint64(64 - 8 * width)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts; ones alone are left out."""
    if not len(counts) or counts.min() == counts.max() == 1:
        return b""
    return _planes(counts)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    return _unplaned(data, n).astype(np.int64) if data else np.ones(n, np.int64)


SENT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("totals", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])
CHUNK = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("sub", pa.int32()), ("chunk", pa.int64()), ("blocks", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
COUNTED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("sub", pa.int32()), ("chunk", pa.int64()), ("blocks", pa.binary()), ("sizes", pa.binary()), ("totals", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])
DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def sum_up(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """For each list of hashes the totals over all lists, the sum of all counts and the number of hashes with a count."""
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    return np.split(totals[place], np.cumsum([len(x) for x in hashes])[:-1]), int(totals.sum()), int((totals > 0).sum())


def n_ranges(volume: int, range_bytes: int = RANGE_BYTES) -> int:
    return max(16, -(-volume // range_bytes))


class Found(NamedTuple):
    """Of one kind: the corpus-wide counts in the order of a block's hashes, and the corpus-wide sum of counts and number of hashes with a count."""

    totals: np.ndarray
    total: int
    distinct: int

    def row(self, block: int, kind: int) -> tuple:
        """As a row of ``ANSWERED``, for an exchange that goes on from here."""
        return block, 0, kind, len(self.totals), pack_counts(self.totals), self.total, self.distinct


def with_totals(blocks: DataFrame, ranges: int, items: Callable, finish: Callable, schema: str, widths: dict[int, int], known: DataFrame | None = None, fan: int = FAN, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``finish(block, found)`` for each block row of a written table.

    ``items(block: pa.Table)`` gives for each kind, a number, a pair of arrays: sorted distinct hashes and how often to count each. ``found`` has for each kind what :class:`Found` says, and that of the rows of ``known``, a table like ``ANSWERED`` from an exchange before. ``widths`` has for each kind the bytes of a hash that count: hashes that agree in these are counted as one.
    """
    parts = min(ranges, fan)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                rows: dict[str, list] = {"kind": [], "part": [], "hashes": [], "counts": []}
                for kind, (hashes, counts) in items(one).items():
                    start = 0
                    for part, end in enumerate(ranges_of(hashes, parts).tolist()):
                        rows["kind"].append(kind)
                        rows["part"].append(part)
                        rows["hashes"].append(pack(hashes[start:end], widths[kind]))
                        rows["counts"].append(pack_counts(counts[start:end]))
                        start = end
                rows["block"] = [one.column("block")[0].as_py()] * len(rows["kind"])
                yield pa.RecordBatch.from_pydict(rows, schema=SENT)

    def opened(table):
        """Hashes and counts of packets of one kind."""
        width = widths[table.column("kind")[0].as_py()]
        hashes = [unpack(x.as_py(), width) for x in table.column("hashes")]
        return hashes, [unpack_counts(x.as_py(), len(h)) for x, h in zip(table.column("counts"), hashes)]

    def answer(table: pa.Table) -> pa.Table:
        hashes, counts = opened(table)
        answers, total, distinct = sum_up(hashes, counts)
        n = table.num_rows
        return pa.Table.from_arrays([table.column("block"), table.column("part"), table.column("kind"), pa.array([len(x) for x in answers], pa.int32()), pa.array([pack_counts(x) for x in answers], pa.binary()), pa.array([total] * n, pa.int64()), pa.array([distinct] * n, pa.int64())], schema=ANSWERED)

    def end(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return finish(block, {})
        if block.num_rows > 1:
            raise RuntimeError("two blocks have one name")
        by_kind: dict[int, list] = defaultdict(list)
        for row in sorted(answers.drop(["block"]).to_pylist(), key=lambda r: (r["kind"], r["part"])):
            by_kind[row["kind"]].append(row)
        return finish(block, {kind: Found(np.concatenate([unpack_counts(r["totals"], r["n"]) for r in rows]), sum(r["total"] for r in rows), sum(r["distinct"] for r in rows)) for kind, rows in by_kind.items()})

    sent = blocks.mapInArrow(tidied(send), ddl(SENT))
    if ranges <= fan:
        answered = sent.groupBy("part", "kind").applyInArrow(tidied_groups(answer), ddl(ANSWERED))
    else:
        answered = _two_levels(sent, -(-ranges // fan), parts, opened, chunk_bytes)
    if known is not None:
        answered = answered.unionByName(known)
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(tidied_groups(end), schema)


def _two_levels(sent: DataFrame, inner: int, parts: int, opened: Callable, chunk_bytes: int) -> DataFrame:
    """The answers to packets, by way of ranges that are ``inner`` times finer. The packets of a range are dealt over as many tasks as there are finer ranges, so a task sees a small part of each."""

    def deal(batches):
        held: list = []
        size, key = 0, None

        def flush():
            hashes, counts = opened(pa.Table.from_batches(held))
            kind, part = key
            lo, hi = -(-(part << 64) // parts), -(-((part + 1) << 64) // parts)
            bounds = np.array([lo + (hi - lo) * i // inner for i in range(1, inner)], np.uint64)
            ends = [np.concatenate([[0], np.searchsorted(h, bounds, "left"), [len(h)]]) for h in hashes]
            blocks = np.concatenate([np.asarray(b.column(2)) for b in held])
            for sub in range(inner):
                cut = [slice(e[sub], e[sub + 1]) for e in ends]
                some, often = (np.concatenate([x[c] for x, c in zip(xs, cut)]) for xs in (hashes, counts))
                row = (kind, part, sub, int(blocks[0]), blocks.astype("<i8").tobytes() if not sub else b"", np.array([c.stop - c.start for c in cut], "<u4").tobytes(), some.astype("<u8").tobytes(), pack_counts(often))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, CHUNK.types)], schema=CHUNK)

        for batch in batches:
            kinds, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bounds = [0, *(i for i in range(1, batch.num_rows) if (kinds[i], places[i]) != (kinds[i - 1], places[i - 1])), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                if held and ((kinds[a], places[a]) != key or size >= chunk_bytes):
                    yield from flush()
                    held, size = [], 0
                key = (kinds[a], places[a])
                held.append(batch.slice(a, b - a))
                size += held[-1].nbytes
        if held:
            yield from flush()

    def tally(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes")]
        answers, total, distinct = sum_up(hashes, [unpack_counts(x.as_py(), len(h)) for x, h in zip(table.column("counts"), hashes)])
        n = table.num_rows
        return pa.Table.from_arrays([*(table.column(c) for c in ("kind", "part", "sub", "chunk", "blocks", "sizes")), pa.array([pack_counts(x) for x in answers], pa.binary()), pa.array([total] * n, pa.int64()), pa.array([distinct] * n, pa.int64())], schema=COUNTED)

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["sub"])
        blocks = np.frombuffer(rows[0]["blocks"], "<i8")
        sizes = [np.frombuffer(r["sizes"], "<u4").astype(np.int64) for r in rows]
        split = [np.split(unpack_counts(r["totals"], int(s.sum())), np.cumsum(s)[:-1]) for r, s in zip(rows, sizes)]
        whole = [np.concatenate([s[i] for s in split]) for i in range(len(blocks))]
        n = len(blocks)
        return pa.Table.from_pydict({"block": blocks, "part": [rows[0]["part"]] * n, "kind": [rows[0]["kind"]] * n, "n": [len(x) for x in whole], "totals": [pack_counts(x) for x in whole], "total": [sum(r["total"] for r in rows)] * n, "distinct": [sum(r["distinct"] for r in rows)] * n}, schema=ANSWERED)

    dealt = sent.repartition(F.col("kind"), F.col("part"), F.pmod(F.xxhash64("block"), F.lit(inner))).sortWithinPartitions("kind", "part", "block")
    counted = dealt.mapInArrow(tidied(deal), ddl(CHUNK)).groupBy("kind", "part", "sub").applyInArrow(tidied_groups(tally), ddl(COUNTED))
    return counted.groupBy("kind", "part", "chunk").applyInArrow(tidied_groups(gather), ddl(ANSWERED))
