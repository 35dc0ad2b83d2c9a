"""Minimax contiguous partition of atomic groups into shards, with DataFrame operations only.

Documents of equal text form one atomic group. Groups stand in the order of a digest of their text, which spreads any corpus evenly over key prefixes, so bounded summaries by prefix are enough for the driver: a binary search looks for the smallest capacity with which a greedy left-to-right packing fills no more than the wanted number of shards. Where a decision depends on the inside of a summarised prefix, only that prefix is summarised again, more finely. The cuts are then digest literals, so rows find their shard by comparison and without a join, however large a group is.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of, settle

#: Hex digits of the first summary (at most 65,536 rows) and of each finer one.
FIRST, STEP = 4, 3


class _Sums:
    """Prefix sums over ordered key prefixes; an entry with more than one group is opaque until it is refined."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.items = self._summary(FIRST, None)
        self.largest = max((m for *_, m in self.items), default=0)
        self._index()

    def _summary(self, digits: int, within: list[str] | None) -> list[tuple[str, int, int, int]]:
        rows = self.groups
        if within is not None:
            rows = rows.filter(F.substring("key", 1, len(within[0])).isin(within))
        rows = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes"))
        return sorted(map(tuple, rows.collect()))

    def _index(self) -> None:
        self.starts = [0, *accumulate(b for _, b, _, _ in self.items)]
        self.total = self.starts[-1]

    def refine(self, at: set[int]) -> None:
        by_length: dict[int, list[str]] = {}
        for i in at:
            by_length.setdefault(len(self.items[i][0]), []).append(self.items[i][0])
        self.items = [x for i, x in enumerate(self.items) if i not in at]
        for length, prefixes in by_length.items():
            self.items += self._summary(min(64, length + STEP), prefixes)
        self.items.sort()
        self._index()

    def before(self, x: int) -> tuple[int, int, int | None]:
        """Lowest and highest place that the last boundary at or before x can have, and the opaque entry in doubt."""
        if x >= self.total:
            return self.total, self.total, None
        i = bisect_right(self.starts, x) - 1
        if self.starts[i] == x or self.items[i][2] == 1:
            return self.starts[i], self.starts[i], None
        return self.starts[i], x, i

    def fits(self, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
        """Whether greedy packing ends within the shards; None while opaque entries decide it."""
        low = high = 0
        doubt: set[int] = set()
        for _ in range(shards):
            low, _, a = self.before(low + capacity)
            _, high, b = self.before(high + capacity)
            doubt |= {x for x in (a, b) if x is not None}
        return (True if low == self.total else False if high < self.total else None), doubt


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """First keys of the shards 2, 3, ... and the smallest feasible capacity. groups: key (64 hex digits), bytes."""
    sums = _Sums(groups)
    if not sums.items:
        return [], 0
    least, most = max(sums.largest, -(-sums.total // shards)), sums.total
    while least < most:
        mid = (least + most) // 2
        ok, doubt = sums.fits(mid, shards)
        if ok is None:
            sums.refine(doubt | sums.fits(least, shards)[1])
        elif ok:
            most = mid
        else:
            least = mid + 1
    return _cut(sums, shards, least), least


def _cut(sums: _Sums, shards: int, capacity: int) -> list[str]:
    """Cuts as near to equal shares as the capacity lets them be: each between the last start that still fits behind it and the greedy one."""
    while True:
        doubt: set[int] = set()

        def at(x: int, up: bool) -> int:
            low, _, i = sums.before(max(0, x))
            if i is not None:
                doubt.add(i)
            elif up and low < x:
                return sums.starts[bisect_right(sums.starts, low)]
            return low

        earliest, x = [], sums.total
        for _ in range(shards - 1):
            x = at(x - capacity, True)
            earliest.append(x)
        earliest.reverse()
        cuts, last = [], 0
        for s in range(1, shards):
            goal = s * sums.total // shards
            latest = at(last + capacity, False)
            below, above = at(goal, False), at(goal, True)
            near = below if goal - below <= above - goal else above
            last = max(last, min(latest, max(earliest[s - 1], near)))
            cuts.append(last)
        if not doubt:
            break
        sums.refine(doubt)
    where = {x: i for i, x in reversed(list(enumerate(sums.starts)))}
    return [sums.items[where[x]][0] if x < sums.total else "g" for x in cuts]


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_cell: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text counts as an empty one. Equal texts share a shard. Repeated rows keep one slot each. An empty table gives no rows. Slots are numbered from cells of bounded size, so that a shard with any share of the rows is spread over many tasks.
    """
    text = F.col("text")
    rows = settle(docs_of(docs, id_col, text_col).select("doc_id", F.sha2(text.cast("binary"), 256).alias("key"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts, _ = minimax_cuts(groups, shards)
    number = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    cells = max(1, -(-rows.count() // rows_per_cell))
    placed = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells)).cast("int"))
    sizes = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("base"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key")) - 1
    return (
        placed.withColumn("within", slot)
        .join(bases, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_sharding(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
