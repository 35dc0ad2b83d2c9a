"""Language-model scores by a weighted backoff automaton.

The model is an interpolated n-gram model: with c the count of an n-gram or context in the training texts, P(w|h) = (c(hw) + m P(w|h')) / (c(h) + m), where h' is h without its first word and m the strength of that order; below all, P(w) = (c(w) + 1) / (N + V + 1). Each counted context is a state and each counted n-gram an arc of it; a state's failure arc leads to that of the shorter context and weighs log10(m / (c(h) + m)). A text is read once from left to right: at each word the automaton takes the arc of its state, or failure arcs until one has an arc, and moves to the longest counted context that ends there.

Counts come from the whole corpus by the packed exchange; each block builds just the part of the automaton that its own texts can reach, so neither the driver nor any task holds the model.
"""

from __future__ import annotations

from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, docs_of, files_for, text_volume
from .exchange import ANSWERED, BLOCK_BYTES, GOLDEN, Words, ddl, mix, n_ranges, read_block, with_totals, word_blocks, word_hashes

#: Stand-ins for the start and the end of a text; no word has white space.
START, END = "\n<", "\n>"


class Grams:
    """The n-grams of some texts. For each order: sorted distinct hashes and, for each token, the place of the n-gram that ends there (-1: it would reach over the start)."""

    def __init__(self, words: Words, order: int):
        self.sizes = words.sizes + 1  # with the end
        hashed = np.concatenate([mix(word_hashes([START, END])), words.hashes])
        # each text stands behind one start mark, which is a context but not a token
        ends = np.cumsum(self.sizes + 1)
        lead = ends - self.sizes - 1
        tokens = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        self.is_token = np.ones(len(tokens), bool)
        self.is_token[lead] = False
        is_word = self.is_token.copy()
        is_word[ends - 1] = False
        tokens[ends - 1] = 1
        tokens[is_word] = words.ids + 2
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        self.within = np.arange(len(tokens)) - np.repeat(lead, self.sizes + 1)
        rolled = hashed[tokens]
        self.hashes, self.places = [], []
        for k in range(1, order + 1):
            if k > 1:
                rolled = np.concatenate([np.zeros(1, np.uint64), mix(rolled[:-1] * GOLDEN + hashed[tokens[1:]] + np.uint64(k))])
            whole = self.within >= k - 1
            distinct, place = np.unique(rolled[whole], return_inverse=True)
            places = np.full(len(tokens), -1, np.int32)
            places[whole] = place
            self.hashes.append(distinct)
            self.places.append(places)
        self.mark = self.places[0][0]

    def counts(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Of each order's distinct n-grams in the chosen texts."""
        on = chosen[self.doc]
        return [np.bincount(p[on & (p >= 0)], minlength=len(h)) for p, h in zip(self.places, self.hashes)]


def automaton(grams: Grams, totals: list[np.ndarray], n: int, v: int, strengths: tuple[float, ...]):
    """For each order the weights of the arcs that end at each place and, for each lower order, of the failure arcs; None where there is none."""
    order = len(totals)
    weight = (totals[0] + 1) / (n + v + 1)
    arcs, fails = [np.log10(weight)[grams.places[0]].tolist()], [[]]
    share = weight[grams.places[0]]
    for k in range(2, order + 1):
        m = strengths[k - 2]
        at, context = grams.places[k - 1], np.concatenate([[-1], grams.places[k - 2][:-1]])
        on = at >= 0
        c, h = np.zeros(len(at)), np.zeros(len(at))
        c[on] = totals[k - 1][at[on]]
        h[on] = totals[k - 2][context[on]]
        share = np.where(h > 0, (c + m * share) / (h + m), share)
        arcs.append([x if seen else None for x, seen in zip(np.log10(share).tolist(), (c > 0).tolist())])
        fails.append(np.where(h > 0, np.log10(m / (h + m)), 0.0).tolist())
    return arcs, fails


def traverse(arcs: list[list], fails: list[list], known: list[bool], start: int, end: int) -> float:
    """log10 probability of the tokens from start to end, the first in the state of the start mark."""
    top, score, state = len(arcs) - 1, 0.0, min(1, len(arcs) - 1)
    for i in range(start, end):
        while state and arcs[state][i] is None:
            score += fails[state][i]
            state -= 1
        score += arcs[state][i]
        state = min(state + 1, top) if known[i] else 0
    return score


#: Bytes of the hashes of single words, and of longer n-grams: of a billion of these one in about 300,000 shares its hash with another.
WIDE, NARROW = 8, 6
#: Kinds of the exchange: n-grams by their order, and the starts of training texts.
STARTS = 0


def score(docs: DataFrame, train: F.Column, order: int = 3, strengths: tuple[float, ...] | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", **exchange) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``train`` tells which rows the model learns from; where it is null, the row is held out. ``strengths`` are those of the orders from 2 on; without them each is the mean number of distinct words that follow a context of its length in the training texts. A null or empty text is its end token alone. With no training rows every token has the share 1 / (0 + 0 + 1). Repeated rows count as often as they stand, null ids stay null and other columns are left out. An empty table gives no rows.

    Words and pairs are counted in one exchange and each further order in one of its own, so that the packets of one go before the next begins; between them only the totals are kept.
    """
    spark = docs.sparkSession
    rows = docs_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("chosen")), "doc_id", "text", "chosen")
    tables = Tables(spark, "lm")
    volume = text_volume(rows)[1]
    parts, ranges = files_for(volume=volume), n_ranges(volume)
    blocks = tables.write(word_blocks(rows, block_bytes), "blocks", parts)

    def items_of(first: int, last: int):
        def items(table: pa.Table):
            words, _, chosen = read_block(table)
            chosen = np.array(chosen, bool)
            grams = Grams(words, last)
            counts = grams.counts(chosen)
            counts[0][grams.mark] = 0  # a context, but not a token: counted as a kind of its own
            out = {k: (grams.hashes[k - 1], counts[k - 1]) for k in range(first, last + 1)}
            return out | {STARTS: (mix(word_hashes([START])), np.array([chosen.sum()]))} if first == 1 else out

        return items

    def keep(table: pa.Table, found: dict) -> pa.Table:
        if not table.num_rows:
            return ANSWERED.empty_table()
        block = table.column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*(f.row(block, kind) for kind, f in sorted(found.items()))), ANSWERED.types)], schema=ANSWERED)

    def finish(table: pa.Table, found: dict) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        words, ids, chosen = read_block(table)
        grams, chosen = Grams(words, order), np.array(chosen, bool)
        single, n, v = found[1].totals, found[1].total, found[1].distinct
        contexts = [single.copy(), *(found[k].totals for k in range(2, order + 1))]
        contexts[0][grams.mark] = found[STARTS].total
        weights = strengths or [max(1.0, found[k].distinct / max(1, found[k - 1].distinct)) for k in range(2, order + 1)]
        arcs, fails = automaton(grams, contexts, n, v, weights)
        seen = (single[grams.places[0]] > 0) & grams.is_token
        moves, ends = seen.tolist(), np.cumsum(grams.sizes + 1)
        scores = [traverse(arcs, fails, moves, int(e - s), int(e)) for s, e in zip(grams.sizes, ends)]
        base = np.where(grams.is_token, np.log10((single + 1) / (n + v + 1))[grams.places[0]], 0)
        rows = len(ids)
        return pa.Table.from_arrays([
            pa.array(ids, pa.int64()), pa.array(~chosen), pa.array(grams.sizes), pa.array(np.bincount(grams.doc[seen], minlength=rows).astype(np.int64)),
            pa.array(np.full(rows, n, np.int64)), pa.array(np.bincount(grams.doc, base, rows)), pa.array(np.array(scores, float)),
        ], schema=OUT)

    known, first, last = None, 1, min(order, 2)
    while True:
        widths = {k: NARROW if k > 1 else WIDE for k in range(first if first > 1 else 0, last + 1)}
        ends = last == order
        done = with_totals(blocks, ranges, items_of(first, last), finish if ends else keep, SCORED if ends else ddl(ANSWERED), widths, known, **exchange)
        if ends:
            return done
        known = tables.write(done, "known", parts)
        first = last = last + 1


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op1_lm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 != 2)
