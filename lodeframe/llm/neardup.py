"""Exact near-duplicate join on word shingles by a grouped prefix join.

A document's shingles stand in one order for the whole corpus: rare ones first, by their document frequency. Documents that reach the threshold share a shingle within the first n - ceil(t n) + 1 of both. Shingles that occur in one document alone can't be shared and are left out of these prefixes, so most documents have none left and drop out. Sets with the same prefix and size form one group; group pairs that share a prefix shingle are filtered by size and by how much overlap their places leave; what remains is expanded and verified on the sets themselves.

Only components are asked for, so pairs within a component need no check. Star rounds come first: each group is checked against one pivot for a bucket, which joins the bulk of a large family of copies at linear cost. The final round then takes all remaining group pairs with members in different components, so no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, docs_of, files_for, text_volume, tidied
from .exchange import BLOCK_BYTES, GOLDEN, Words, mix, n_ranges, read_block, with_totals, word_blocks
from .graph import components

SCHEMA = "doc_id long, n_shingles long, gid binary, tokens array<long>, ranks array<int>, clean double, shared binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("gid", pa.binary()), ("tokens", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("clean", pa.float64()), ("shared", pa.binary())])


class Shingles:
    """Distinct shingles of some texts: pairs (hash, text) in ascending order; a text with fewer words than a shingle is one shingle."""

    def __init__(self, words: Words, width: int):
        sizes = words.sizes
        flat = words.hashes[words.ids]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        n = max(0, len(flat) - width + 1)
        rolled, whole = np.zeros(n, np.uint64), doc[:n] == doc[width - 1 :][:n]
        for j in range(width):
            rolled = rolled * GOLDEN + flat[j : j + n]
        hashes, owners = [mix(rolled[whole] + np.uint64(width))], [doc[:n][whole]]
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        if len(short):
            ends = np.cumsum(sizes)
            one = []
            for k in short:
                h = np.zeros(1, np.uint64)
                for x in flat[ends[k] - sizes[k] : ends[k]]:
                    h = h * GOLDEN + x
                one.append(mix(h + np.uint64(sizes[k]))[0])
            hashes.append(np.array(one, np.uint64))
            owners.append(short.astype(np.int32))
        h, d = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((d, h)) if len(short) else np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.hash, self.doc, self.n = h[new], d[new], len(sizes)
        self.sizes = np.bincount(self.doc, minlength=self.n)

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hash, return_counts=True)


def prefixes(docs: DataFrame, tables: Tables, percent: int = 75, width: int = 5, block_bytes: int = BLOCK_BYTES, **exchange) -> DataFrame:
    """For every row doc_id, n_shingles and gid, a digest of its set (null for an empty one). One row for each set and block that has shared shingles in its prefix also has tokens (those shingles), ranks (their places in the order), clean (share of shingles that other documents have) and shared (all shared shingles, packed and sorted)."""
    rows = docs_of(docs.select("doc_id", "text", F.lit(None).cast("boolean").alias("chosen")), "doc_id", "text", "chosen")
    volume = text_volume(rows)[1]
    blocks = tables.write(word_blocks(rows, block_bytes), "blocks", files_for(volume=volume))

    def items(table: pa.Table):
        return {0: Shingles(read_block(table)[0], width).frequencies()}

    def finish(table: pa.Table, found: dict):
        if not table.num_rows:
            return OUT.empty_table()
        words, ids, _ = read_block(table)
        s = Shingles(words, width)
        df = np.minimum(found[0].totals, (1 << 32) - 1)[np.unique(s.hash, return_inverse=True)[1]]
        by_doc = np.argsort(s.doc, kind="stable")  # ascending hashes for each document
        rare = np.argsort(df, kind="stable")
        rare = rare[np.argsort(s.doc[rare], kind="stable")]
        ends = np.cumsum(s.sizes)
        n = s.sizes[s.doc[rare]]
        rank = np.arange(len(rare)) - np.repeat(ends - s.sizes, s.sizes)
        live = (df[rare] > 1) & (rank <= n - -(-n * percent // 100))
        signed = s.hash.view(np.int64)
        rows: dict[str, list] = {x: [] for x in OUT.names[2:]}
        seen: set[bytes] = set()
        for k in range(s.n):
            at = slice(ends[k] - s.sizes[k], ends[k])
            mine = by_doc[at]
            gid = hashlib.blake2b(s.hash[mine].astype("<u8").tobytes(), digest_size=16).digest() if s.sizes[k] else None
            on = np.flatnonzero(live[at]) if gid and gid not in seen else ()
            rows["gid"].append(gid)
            if len(on):
                seen.add(gid)
                some = mine[df[mine] > 1]
                rows["tokens"].append(signed[rare[at][on]])
                rows["ranks"].append(on.astype(np.int32))
                rows["clean"].append(len(some) / s.sizes[k])
                rows["shared"].append(s.hash[some].astype("<u8").tobytes())
            else:
                for x in OUT.names[3:]:
                    rows[x].append(None)
        return pa.Table.from_pydict({"doc_id": ids, "n_shingles": s.sizes, **rows}, schema=OUT)

    return with_totals(blocks, n_ranges(volume), items, finish, SCHEMA, {0: 6}, **exchange).coalesce(files_for(volume=volume))


#: About so many partners of one set are verified in one task.
PARTNERS = 10_000


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, n_sets: int) -> DataFrame:
    """u, v of the pairs that reach the threshold. A set that very many others are compared with is dealt over salts of its partners, for u and for v alike, so that no task has all its pairs."""
    salts = max(1, min(4096, -(-n_sets // PARTNERS)))

    def with_set(rows: DataFrame, x: str, partner: str) -> DataFrame:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(partner), F.lit(salts)))
        own = sets.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"))
        return rows.join(rows.select(x, "salt").distinct().join(own, x), [x, "salt"]).drop("salt")

    def run(batches):
        for batch in batches:
            u, v, nu, nv, su, sv = (batch.column(batch.schema.get_field_index(x)) for x in ("u", "v", "nu", "nv", "su", "sv"))
            same = np.fromiter((len(np.intersect1d(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), assume_unique=True)) for a, b in zip(su, sv)), np.int64, len(u))
            ok = 100 * same >= percent * (nu.to_numpy() + nv.to_numpy() - same)
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok)), v.filter(pa.array(ok))], names=["u", "v"])

    return with_set(with_set(pairs, "u", "v"), "v", "u").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(tidied(run), "u binary, v binary")


def _possible(a: str, b: str, percent: int):
    """Size filter and place filter for entries that share a shingle."""
    n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.rank", f"{b}.rank"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def _node() -> Column:
    """A name of a set that sorts by its least document id: eight bytes of that (a null one last), then the digest."""
    place = F.coalesce("least", F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.unhex(F.lpad(F.hex(place), 16, "0")), F.col("gid"))


def _least(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, rounds: int = 2, **exchange) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included) for every row.

    Texts are compared by their sets of distinct shingles of ``width`` words, A-Z lower-cased; two link when 100 * intersection >= percent * union. A null or empty text has an empty set and links with nothing. Repeated rows stay and are copies of each other. Null ids take part but name no component unless alone. Other columns are left out. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "near")
    base = tables.write(prefixes(docs, tables, percent, width, **exchange), "base")
    tables.drop("blocks")
    parts = files_for(base.count())
    ids = tables.write(base.filter(F.col("gid").isNotNull()).groupBy("gid").agg(F.min("doc_id").alias("least")), "ids", parts)
    one = base.filter(F.col("tokens").isNotNull()).dropDuplicates(["gid"])  # rows of one set differ in their document alone
    named = one.join(ids, "gid").withColumn("node", _node())
    sets = tables.write(named.select(F.col("node").alias("gid"), F.col("n_shingles").alias("n"), "clean", F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>"), F.col("n_shingles")).cast("binary")).alias("pg"), "tokens", "ranks", "shared"), "sets", parts)
    n_sets = sets.count()
    few = files_for(n_sets)
    links = None
    comp = sets.select("gid", F.col("gid").alias("comp"))
    for turn in range(rounds + 1):
        member = sets.select("gid", "n", "clean", "pg").join(comp, "gid")
        best = F.max(F.struct(F.col("clean") if not turn else F.xxhash64("gid", F.lit(turn)).cast("double"), "gid"))["gid"].alias("lead")
        if turn < rounds:  # units: what a group has of one component
            units = member.groupBy("pg", "n", "comp").agg(best, F.max("clean").alias("clean"))
            entry = _entries(sets).join(units.drop("n"), "pg")
            weight = F.struct(F.col("clean") if not turn else F.xxhash64("lead", F.lit(turn)).cast("double"), F.col("lead"))
            pivots = entry.groupBy("token").agg(F.max(F.struct(weight.alias("w"), "lead", "comp", "n", "rank")).alias("p"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("token", "size", "p.lead", "p.comp", "p.n", "p.rank")
            near = entry.alias("a").join(pivots.alias("b"), "token").filter((F.col("a.comp") != F.col("b.comp")) & _possible("a", "b", percent))
            chosen = near.groupBy(F.col("a.lead").alias("u")).agg(F.max(F.struct("b.size", F.col("b.lead").alias("v")))["v"].alias("v"))
            pairs = chosen.filter("u <> v")
        else:
            span = member.groupBy("pg").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
            entry = _entries(sets).join(span, "pg")
            mixed = entry.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).filter("x <> y").select("token")
            entry = entry.join(mixed, "token", "left_semi")
            apart = (F.col("a.low") != F.col("b.low")) | (F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high"))
            # the smaller of two sets must have the shared shingle within a shorter prefix, for nothing before it is shared
            smaller = entry.filter((100 + percent) * (F.col("n") - F.col("rank")) >= 2 * percent * F.col("n"))
            order = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.pg") < F.col("b.pg")))
            groups = entry.alias("a").join(smaller.alias("b"), "token").filter(order & apart & _possible("a", "b", percent)).select(F.col("a.pg").alias("x"), F.col("b.pg").alias("y")).distinct()
            groups = groups.unionByName(span.filter("low <> high").select(F.col("pg").alias("x"), F.col("pg").alias("y")))
            side = lambda k, g: member.select(F.col("pg").alias(k), F.col("gid").alias(g), F.col("comp").alias(f"c{g}"))
            pairs = groups.join(side("x", "u"), "x").join(side("y", "v"), "y").filter("cu <> cv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = tables.write(pairs.select("u", "v"), "pairs", few)
        found = tables.write(_verified(pairs, sets, percent, n_sets), f"links-{turn}", few)
        links = found if links is None else links.unionByName(found)
        comp = tables.write(components(links, tables, few).withColumnRenamed("node", "gid"), "tied", few)
        if turn < rounds:
            comp = tables.write(sets.select("gid").join(comp, "gid", "left").select("gid", F.coalesce("comp", "gid").alias("comp")), "comp", few)
    found = comp.select(F.substring("gid", 9, 16).alias("gid"), F.nullif(_least(F.col("comp")), F.lit((1 << 63) - 1)).alias("found"))
    names = tables.write(ids.join(found, "gid", "left").select("gid", F.coalesce("found", "least").alias("component_id")), "names", parts)
    tables.drop("ids", "sets", "pairs", "edges", "tied", "comp", *(f"links-{t}" for t in range(rounds + 1)))
    return base.select("doc_id", "n_shingles", "gid").join(names, "gid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _entries(sets: DataFrame) -> DataFrame:
    """token, rank, pg, n for each group."""
    one = sets.select("pg", "n", "tokens", "ranks").dropDuplicates(["pg"])
    return one.select("pg", "n", F.explode(F.arrays_zip("tokens", "ranks")).alias("e")).select("pg", "n", F.col("e.tokens").alias("token"), F.col("e.ranks").alias("rank"))


def op7_jaccard(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
