"""Quality rules: how far a text's character classes and common words are from those of its language.

References are learned from the corpus itself, over all documents of each language that has a word list: the median share of each character class and the mean share of each common word. The median keeps the reference clean while less than half of a language is junk. Digits are left out of the classes, for numbers and keys don't make a text bad. A document passes if, for at least one language, the Jensen-Shannon distance (base 2, from 0 to 1) of both histograms is within its threshold. That of the words also stays below the distance of a text without any common word to the reference, and a text has at least a part of the language's share of common words, so a text without them fails whatever its letters. Short texts have noisy histograms, so a test isn't applied to a text with fewer characters, or fewer words, than its minimum; that of words lies above what the base rule asks for. A row of a language without a word list has no reference, so the base rule alone decides; one without a language may be of any. All sums behind the references are of integers, so they don't depend on the order of tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidied, word_re

#: Common function words of each language.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his are this at from or an have which had they you were their one all we can her has there been if more when will would who so no".split(),
    "fr": "de la le et les des en un une du que est pour dans qui par sur au plus ne pas se ce il sont avec ou son mais comme on nous vous ils elle leur cette ces aux été être".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split(),
}
#: The characters that the base rule counts as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "space", "stop", "mark", "symbol", "other", "digit")
#: Of these, the histogram has all but the last. Shares are counted in so many steps of their square root.
USED, STEPS = len(CLASSES) - 1, 1000
#: Shares of common words are summed as whole numbers of this part.
UNIT = 1 << 24
EDGES = ".,;:!?\"'()[]{}#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    chars: float = 0.145
    words: float = 0.5
    #: The distance of words may reach so much of that of a text without common words.
    below: float = 0.95
    #: Least share of common words, as a part of the reference's.
    least_share: float = 0.25
    least_chars: int = 200
    least_words: int = 70
    base_words: int = 50
    base_repeat: int = 50


@lru_cache(maxsize=1)
def vocabulary() -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w for ws in COMMON.values() for w in ws}))}


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry is for all beyond."""
    table = np.full(0x10001, CLASSES.index("other"), np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        table[c] = CLASSES.index(
            "symbol" if c < 128 and chr(c) in SYMBOLS
            else "space" if kind[0] == "Z" or 9 <= c <= 13
            else "upper" if kind in ("Lu", "Lt")
            else "lower" if kind[0] in "LM"
            else "digit" if kind[0] == "N"
            else "stop" if c < 128 and chr(c) in ".,"
            else "mark" if kind[0] == "P"
            else "symbol" if kind[0] == "S"
            else "other"
        )
    return table


class Features:
    """Word counts, repeats and histograms of some texts at once."""

    def __init__(self, texts: list[str]):
        words = [word_re.findall(t) for t in texts]
        n, k, m = len(texts), len(CLASSES), len(vocabulary()) + 1
        self.n_words = np.fromiter(map(len, words), np.int64, n)
        ids: dict[str, int] = {}
        put = ids.setdefault
        self.ids = np.fromiter((put(w, len(ids)) for ws in words for w in ws), np.int64, int(self.n_words.sum()))
        self.doc = np.repeat(np.arange(n), self.n_words)
        self.distinct = len(ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.word_chars = np.bincount(self.doc, sizes[self.ids], n).astype(np.int64)
        bins = np.fromiter((vocabulary().get(w.lower().strip(EDGES), 0) for w in ids), np.int64, len(ids))
        self.common = np.bincount(self.doc * m + bins[self.ids], minlength=n * m).reshape(n, m)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int32) * k, np.fromiter(map(len, texts), np.int64, n))
        self.chars = np.bincount(owner + class_table()[np.minimum(points, 0x10000)], minlength=n * k).reshape(n, k)[:, :USED]
        self.n_chars = np.fromiter(map(len, texts), np.int64, n)

    def repeats(self) -> np.ndarray:
        """Words of each text in windows of three words that it has twice or more."""
        if len(self.ids) < 3:
            return np.zeros(len(self.n_words), np.int64)
        v = self.distinct
        key = (self.ids[:-2] * v + self.ids[1:-1]) * v + self.ids[2:] if v < 1 << 21 else np.unique(np.stack([self.ids[:-2], self.ids[1:-1], self.ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        whole = np.flatnonzero(self.doc[:-2] == self.doc[2:])
        order = whole[np.argsort(key[whole], kind="stable")]
        same = (key[order[1:]] == key[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        again = np.zeros(len(self.ids), bool)
        found = np.concatenate([order[1:][same], order[:-1][same]])
        for j in range(3):
            again[found + j] = True
        return np.bincount(self.doc[again], minlength=len(self.n_words))


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q; rows without a count are at 0."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / mid), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / mid), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((a + b) / 2, 0, None)), 0)


def without_common(q: np.ndarray) -> float:
    """The distance to a reference of a text that has no common word."""
    return float(distance(np.eye(1, len(q)), q)[0])


def references(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Reference histograms of each language that has a word list, learned from every document with enough words. What reaches the driver is bounded by languages, classes, steps and list lengths."""
    m = len(vocabulary()) + 1

    def run(batches: Iterable[pa.RecordBatch]):
        steps = {lang: np.zeros((USED, STEPS + 1), np.int64) for lang in COMMON}
        shares = {lang: np.zeros(m, np.int64) for lang in COMMON}
        for piece in pieces(batches):
            f = Features(piece.column(0).to_pylist())
            langs = np.array(piece.column(1).to_pylist(), dtype=object)
            for lang in COMMON:
                on = (langs == lang) & (f.n_words >= limits.base_words)
                share = f.chars[on] / f.chars[on].sum(1, keepdims=True)
                for c in range(USED):
                    steps[lang][c] += np.bincount(np.sqrt(share[:, c] * STEPS * STEPS).astype(int), minlength=STEPS + 1)
                shares[lang] += np.rint(f.common[on] / f.common[on].sum(1, keepdims=True) * UNIT).astype(np.int64).sum(0)
        for lang in COMMON:
            values = np.concatenate([steps[lang].ravel(), shares[lang]])
            at = np.flatnonzero(values)
            if len(at):  # an empty list has no type
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bin": at.astype(np.int32), "value": values[at]})

    chosen = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isin(*COMMON))
    found: dict[str, np.ndarray] = {}
    for r in chosen.mapInArrow(tidied(run), "lang string, bin int, value long").groupBy("lang", "bin").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["lang"], np.zeros(USED * (STEPS + 1) + m, np.int64))[r["bin"]] = r["value"]
    out = {}
    for lang, x in sorted(found.items()):
        steps, shares = x[:-m].reshape(USED, -1), x[-m:]
        half = (np.cumsum(steps, 1) >= steps.sum(1, keepdims=True) / 2).argmax(1)
        middle = ((half + 0.5 * (half > 0)) / STEPS) ** 2
        out[lang] = (middle / middle.sum(), shares / shares.sum())
    return out


def judge(texts: list[str], langs: list[str | None], refs: dict, limits: Limits) -> dict[str, np.ndarray]:
    """The verdict on each text with its figures. A distance that isn't applied is 0; without references, or for a language that has none, the base rule decides."""
    f = Features(texts)
    repeat = f.repeats()
    failed = (f.n_words < limits.base_words) | (100 * repeat > limits.base_repeat * f.n_words)
    near = np.array([not refs or (lang is not None and lang not in COMMON) for lang in langs], bool)
    chars, words = np.where(near, 0.0, 1.0), np.where(near, 0.0, 1.0)
    for p, q in refs.values():
        a, b = distance(f.chars, p), distance(f.common, q)
        a[f.n_chars < limits.least_chars] = 0
        short = f.n_words < limits.least_words
        b[short] = 0
        enough = short | (f.n_words - f.common[:, 0] >= limits.least_share * (1 - q[0]) * f.n_words)
        near |= (a <= limits.chars) & (b <= min(limits.words, limits.below * without_common(q))) & enough
        chars, words = np.minimum(chars, a), np.minimum(words, b)
    return {
        "n_words": f.n_words, "word_chars": f.word_chars, "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64), "n_repeat_words": repeat.astype(np.int64),
        "base_failed": failed, "kept": ~failed & near, "char_distance": chars, "word_distance": words,
    }


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def verdicts(docs: DataFrame, limits: Limits = Limits(), refs: dict | None = None) -> DataFrame:
    """doc_id and the verdict with its figures for every row.

    A null or empty text has no words and fails. Without any document in a language that has a word list, and for rows of a language without one, the base rules alone decide. Rows of a null language are judged against all references. Repeated rows and null ids stay. An empty table gives no rows.
    """
    refs = references(docs, limits) if refs is None else refs

    def run(batches):
        for piece in pieces(batches):
            out = judge(piece.column(1).to_pylist(), piece.column(2).to_pylist(), refs, limits)
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x) for x in out.values())], names=["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(tidied(run), f"doc_id long, {VERDICT}")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows whose documents are kept, as they are, with all their columns. Null and empty texts go; repeated rows and null ids are judged like any; an empty table gives no rows."""
    refs = references(docs, limits)

    def run(batches):
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
            langs = piece.column(piece.schema.get_field_index("lang")).to_pylist()
            yield piece.filter(pa.array(judge(texts, langs, refs, limits)["kept"]))

    return docs.mapInArrow(tidied(run), docs.schema)


def op4_quality(spark, sf_dir):
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
