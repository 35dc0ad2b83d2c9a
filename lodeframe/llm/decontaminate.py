"""Benchmark decontamination by template canonicalisation.

Words are brought to a canonical form: numbers, units and names become typed placeholders, all else is lower-cased without edge punctuation. Every capitalised word stands for a name, wherever it is: at the start of a sentence a name can't be told from another word, and so the form of a word depends on the word alone. Windows of canonical words are hashed and joined with the windows of all benchmark items. A window of more slots than words is a template of nearly everything, so its words are hashed as they are, in lower case, and it is found verbatim only; that is the rule for items of many slots, such as series of numbers. The same holds for windows of words in capitals, where names don't show. A match at a window says which item and where; matches of one item that keep their distance between document and item lie on one alignment. An alignment counts as a leak if it covers enough of the item's windows and the slots are consistent: within it, equal values of the item stand for equal values of the document and different ones for different ones. So a question asked again with other numbers or names is caught, and a text that merely shares its shape isn't.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, docs_of, pieces, tidied, word_re
from .exchange import GOLDEN, mix, word_hashes

EDGES = ".,;:!?\"'()[]{}«»„“”‘’…"
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
JOINED = re.compile(r"([-+]?[$€£]?\d[\d.,]*)([a-zA-Zµ°%]+)")
#: Units of measure and money. Units of one letter count only behind the digits of the same word.
UNITS = frozenset("mm cm km kg mg lb lbs oz ml sec second seconds min minute minutes hour hours day days week weeks month months year years inch inches ft foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz mhz ghz kb mb gb tb kw".split())
NUM, NAME, UNIT = "\x00num", "\x00name", "\x00unit"


@dataclass(frozen=True)
class Limits:
    window: int = 8
    cover: float = 0.6
    #: Share of a window's words that must be words, not slots.
    fixed: float = 0.5
    #: Items whose windows number more than this are joined by a shuffle and not broadcast.
    broadcast_windows: int = 2_000_000


def canonical(word: str) -> tuple[str, str]:
    """Canonical form and slot value (empty if it's no slot) of a word."""
    bare = word.strip(EDGES)
    if NUMBER.fullmatch(bare):
        return NUM, bare
    low = bare.lower()
    if low in UNITS:
        return UNIT, low
    if m := JOINED.fullmatch(bare):
        return NUM, m[0].lower()
    if bare[:1].isupper() and len(bare) > 1 and not bare.isupper():
        return NAME, bare
    return low, ""


def raw(word: str) -> str:
    return word.strip(EDGES).lower() or word


def loud(word: str) -> bool:
    """Whether a word stands in capitals."""
    bare = word.strip(EDGES)
    return len(bare) > 1 and bare.isupper()


def forms(word: str) -> tuple[str, bool, str, bool]:
    """What :func:`canonical`, :func:`raw` and :func:`loud` say of a word, with a short way for words of letters alone, which most are."""
    bare = word.strip(EDGES)
    if not bare.isalpha():
        form, value = canonical(word)
        return form, bool(value), raw(word), loud(word)
    low, many = bare.lower(), len(bare) > 1
    if low in UNITS:
        return UNIT, True, low, many and bare.isupper()
    if many and bare[0].isupper():
        capitals = bare.isupper()
        return (low, False, low, True) if capitals else (NAME, True, low, False)
    return low, False, low, many and bare.isupper()


class Canon:
    """Canonical and raw forms of words (bytes) as hashes; a table of bounded size remembers them."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.hashes = np.zeros((2, 1 << 12), np.uint64)
        self.flags = np.zeros((2, 1 << 12), bool)

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.seen)
        while n + len(words) > self.flags.shape[1]:
            self.hashes, self.flags = (np.concatenate([x, np.zeros_like(x)], 1) for x in (self.hashes, self.flags))
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        form, slots, raws, capitals = zip(*map(forms, texts))
        at = slice(n, n + len(words))
        self.hashes[0, at] = mix(word_hashes(form))
        self.hashes[1, at] = mix(word_hashes(raws))
        self.flags[0, at], self.flags[1, at] = slots, capitals
        self.seen.update((w, n + i) for i, w in enumerate(words))

    def read(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Hash, slot flag, hash of the raw form and flag for capitals of each word."""
        if len(self.seen) > self.limit:
            self._reset()
        if new := list(set(words).difference(self.seen)):
            self._learn(new)
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        return self.hashes[0, at], self.flags[0, at], self.hashes[1, at], self.flags[1, at]


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts, the text of each, and the place of each text's first word."""
    words = [t.split() for t in texts]  # bytes have white space of ASCII alone
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return list(chain.from_iterable(words)), np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes


#: Windows of raw words have hashes of their own.
RAW = np.uint64(1 << 32)
#: What one step back in a polynomial hash multiplies with: the inverse of the step modulo 2 ** 64.
BACK = np.uint64(pow(int(GOLDEN), -1, 1 << 64))


class Rolled:
    """Polynomial hashes of all windows of a size, by differences of running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, GOLDEN)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), BACK)]), dtype=np.uint64)[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * back, dtype=np.uint64)])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.powers[starts + size - 1]


def windows(read: tuple[np.ndarray, ...], doc: np.ndarray, sizes: list[int], fixed: float, every: bool = False):
    """For each size the starts and hashes of the windows within one text that have enough words that are no slots, and those of the raw words of all others, of windows half of which stand in capitals, or of every window."""
    hashes, slots, raws, capitals = read
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    filled, shouted = sums(slots), sums(capitals) if capitals.any() else None
    own, plain = Rolled(hashes), None
    for size in sizes:
        n = max(0, len(hashes) - size + 1)
        whole = doc[:n] == doc[size - 1 :][:n]
        worded = filled[size : size + n] - filled[:n] <= (1 - fixed) * size
        also = ~worded | every
        if shouted is not None:
            also |= 2 * (shouted[size : size + n] - shouted[:n]) >= size
        at, raw_at = np.flatnonzero(whole & worded), np.flatnonzero(whole & also)
        if len(raw_at) and plain is None:
            plain = Rolled(raws)
        yield size, at, mix(own.at(at, size) + np.uint64(size)), raw_at, mix(plain.at(raw_at, size) + np.uint64(size) + RAW) if len(raw_at) else np.zeros(0, np.uint64)


def item_windows(benchmark: DataFrame, limits: Limits) -> DataFrame:
    """size, hash, item_id, at (place in the item), raw (whether the words are hashed as they are), n_windows (that are templates), n_all. An item shorter than a window is one window of its own size, three words at least."""

    def run(batches):
        canon = Canon()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("size", "hash", "item_id", "at", "raw", "n_windows", "n_all")}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words, doc, _ = split([text])
                size = min(limits.window, len(words))
                if size < 3:
                    continue
                _, at, hashes, every, raws = next(windows(canon.read(words), doc, [size], limits.fixed, True))
                n = len(at) + len(every)
                rows["size"] += [size] * n
                rows["hash"] += np.concatenate([hashes, raws]).view(np.int64).tolist()
                rows["item_id"] += [item] * n
                rows["at"] += [*at.tolist(), *every.tolist()]
                rows["raw"] += [False] * len(at) + [True] * len(every)
                rows["n_windows"] += [len(at)] * n
                rows["n_all"] += [len(every)] * n
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32()), ("raw", pa.bool_()), ("n_windows", pa.int32()), ("n_all", pa.int32())]))

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(tidied(run), "size int, hash long, item_id long, at int, raw boolean, n_windows int, n_all int")


def window_hits(docs: DataFrame, items: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, place, item_id, at, raw, n_windows, n_all of each matching window. A null or empty text has none."""
    n = items.count()
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most limits.window of them

    def doc_windows(batches, known: np.ndarray | None):
        canon = Canon()
        table = None
        if known is not None:  # a bit table sifts most windows before the search
            bits = max(10, min(24, int(np.ceil(np.log2(len(known) * 64 + 1)))))
            table = np.zeros(1 << bits, bool)
            table[known >> np.uint64(64 - bits)] = True

        def sift(at, found):
            if table is not None and len(at):
                on = np.flatnonzero(table[found >> np.uint64(64 - bits)])
                on = on[known[np.minimum(np.searchsorted(known, found[on]), len(known) - 1)] == found[on]]
                at, found = at[on], found[on]
            return at, found

        for piece in pieces(batches, 1_000_000):
            words, doc, begin = split(piece.column(1).cast(pa.binary()).to_pylist())
            ids = piece.column(0)
            for size, at, found, raw_at, raws in windows(canon.read(words), doc, sizes, limits.fixed):
                at, found = (np.concatenate(x) for x in zip(sift(at, found), sift(raw_at, raws)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[at])), pa.array(np.full(len(at), size, np.int32)), pa.array(found.view(np.int64)), pa.array((at - begin[doc[at]]).astype(np.int32))], names=["doc_id", "size", "hash", "place"])

    rows = docs_of(docs)
    known = None
    if n <= limits.broadcast_windows:  # eight bytes each, in an Arrow table
        known = np.unique(items.select("hash").distinct().toArrow().column(0).to_numpy().view(np.uint64))
        if not len(known):
            return rows.limit(0).select("doc_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("at"), F.lit(False).alias("raw"), F.lit(0).alias("n_windows"), F.lit(0).alias("n_all"))
    found = rows.mapInArrow(tidied(lambda batches: doc_windows(batches, known)), "doc_id long, size int, hash long, place int")
    return found.join(items, ["size", "hash"]).select("doc_id", "place", "item_id", "at", "raw", "n_windows", "n_all")


def leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, item_id, covered (windows of the item found on its alignment), n_windows, place (of the first), slots (how many were compared) for each item that a document leaks.

    Null and empty texts leak nothing and items of fewer than three words are not looked for. An item is found by its templates alone, or else by all its windows. Rows with the same id are judged together, null ids too. Other columns are left out. Of the alignments whose slots are consistent the one with most windows is told, of equal ones the earliest. Empty tables give no rows. Insertions move the alignment, so windows within two words of it count as on it.
    """
    tables = Tables(docs.sparkSession, "leaks")
    items = tables.write(item_windows(benchmark, limits), "items")
    hits = window_hits(docs, items, limits)
    lines = hits.select("doc_id", "item_id", "n_windows", "n_all", "raw", "at", "place", (F.col("place") - F.col("at")).alias("shift")).distinct()
    # alignments within two words of each other fall into one of two overlapping bands
    banded = lines.withColumn("band", F.explode(F.array(F.floor(F.col("shift") / 8) * 2, F.floor((F.col("shift") + 4) / 8) * 2 + 1)))
    places = lambda which: F.count_distinct(F.when(which, F.col("at")))
    covered = banded.groupBy("doc_id", "item_id", "n_windows", "n_all", "band").agg(places(~F.col("raw")).alias("alike"), places(F.lit(True)).alias("covered"), F.collect_set(F.struct("at", "shift")).alias("found"), F.min("place").alias("place"))
    least = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * limits.cover))
    alike = F.col("alike") >= least("n_windows")
    enough = covered.filter(alike | (F.col("covered") >= least("n_all"))).select("doc_id", "item_id", "place", "found", F.when(alike, F.col("alike")).otherwise(F.col("covered")).alias("covered"), F.when(alike, F.col("n_windows")).otherwise(F.col("n_all")).alias("n_windows"))
    ways = enough.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("covered", "n_windows", "place", "found")).alias("ways"))
    return consistent(tables.write(ways, "alignments"), docs, benchmark, limits)


def consistent(ways: DataFrame, docs: DataFrame, benchmark: DataFrame, limits: Limits) -> DataFrame:
    """For each document and item the best alignment whose slots are consistent. Only documents with a candidate are read again."""
    ids = ways.select(F.col("doc_id").alias("d")).distinct()
    rows = docs_of(docs)
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("item_text"))
    pairs = ways.withColumnRenamed("doc_id", "d").join(asked, "item_id").join(texts, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "item_id", "ways", "text", "item_text")
    names = ("doc_id", "item_id", "covered", "n_windows", "place", "slots")
    schema = pa.schema([(c, pa.int32() if c in ("n_windows", "place") else pa.int64()) for c in names])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words, item = word_re.findall(row["text"]), word_re.findall(row["item_text"])
                for way in sorted(row["ways"], key=lambda w: (-w["covered"], w["place"])):
                    n = agreed(words, item, [(x["at"], x["shift"]) for x in way["found"]], min(limits.window, len(item)))
                    if n is not None:
                        out.append((row["doc_id"], row["item_id"], way["covered"], way["n_windows"], way["place"], n))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)

    return pairs.mapInArrow(tidied(run), "doc_id long, item_id long, covered long, n_windows int, place int, slots long").dropDuplicates(["doc_id", "item_id"])


def agreed(words: list[str], item: list[str], found: list[tuple[int, int]], size: int) -> int | None:
    """How many slots were compared at the first shift of an alignment, most windows first, at which they are consistent; None without one."""
    count = Counter(shift for _, shift in found)
    for shift in sorted(count, key=lambda x: (-count[x], x)):
        # each word of the item goes where the window nearest to the shift has it, and one outside all windows where the shift has it
        where: dict[int, int] = {}
        for at, own in sorted(found, key=lambda x: (abs(x[1] - shift), x)):
            for j in range(at, at + size):
                where.setdefault(j, own)
        ok, n = compared(words, item, [j + where.get(j, shift) for j in range(len(item))])
        if ok:
            return n
    return None


def compared(words: list[str], asked: list[str], places: list[int]) -> tuple[bool, int]:
    """Whether values of the item's words map one to one to those of the text at their places, and how many slots were compared; a fifth of the slots may disagree."""
    there: dict[str, set] = defaultdict(set)
    back: dict[str, set] = defaultdict(set)
    n = 0
    for w, i in zip(asked, places):
        if not 0 <= i < len(words):
            continue
        kind, value = canonical(w)
        other, found = canonical(words[i])
        if value and found and kind == other:
            n += 1
            there[kind + value].add(found)
            back[kind + found].add(value)
    extra = sum(len(x) - 1 for x in [*there.values(), *back.values()])
    return 5 * extra <= n, n


def op8_decontaminate(spark, sf_dir):
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
