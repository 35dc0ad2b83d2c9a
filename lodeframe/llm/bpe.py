"""Byte-level BPE with the tokenizers library, over Arrow batches.

Byte-level BPE works on each match of its splitting pattern alone, and a match never reaches across a space that stands before a character that isn't white space. So a text falls into chunks there, each chunk seen is encoded once while a table of bounded size remembers it, and a text's ids are gathered from the table. New chunks are encoded many at a time, as running texts, for a call for each costs more than the merges.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import docs_of, pieces, tidied

BOUNDARY = re.compile(r" (?=\S)")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: How a vocabulary shows a space.
SPACE = byte_alphabet()[32]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_tokenizer(path: str, pattern: str):
    """A tokenizers BPE model of a rank file: a pair merges if its bytes joined are a token, the lowest rank first; a whole match that is a token is taken as it is."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    alphabet = byte_alphabet()
    ranks = read_ranks(path)
    shown = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={shown[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@lru_cache(maxsize=4)
def file_tokenizer(path: str):
    """A tokenizer file; strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class Encoder:
    """Encodes texts by chunks. Beyond ``limit`` entries the table of chunks keeps those that came up again, half the limit at most."""

    def __init__(self, tokenizer, limit: int = 300_000):
        self.tokenizer, self.limit = tokenizer, limit
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int32)
        self.hits = np.zeros(1 << 14, np.int32)
        self.n = self.used = 0
        vocab = tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith(SPACE)]] = True

    def _trim(self) -> None:
        again = np.flatnonzero(self.hits[: self.n] > 1)
        if len(again) > self.limit // 2:
            again = np.sort(again[np.argpartition(-self.hits[again], self.limit // 2)[: self.limit // 2]])
        place = np.full(self.n, -1)
        place[again] = np.arange(len(again))
        for table in (self.first, self.rest):
            kept = [(w, place[i]) for w, i in table.items() if place[i] >= 0]
            table.clear()
            table.update((w, int(i)) for w, i in kept)
        sizes = self.sizes[again]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.n, self.used = len(again), int(ends[-1]) if len(again) else 0
        self.flat[: self.used] = self.flat[np.repeat(self.starts[again] - (ends - sizes), sizes) + np.arange(self.used)]
        self.starts[: self.n], self.sizes[: self.n] = ends - sizes, sizes
        self.hits[:] = 0

    def _learn(self, table: dict[str, int], new: list[str], lead: str) -> None:
        """Enter chunks. Those that begin with a space and have no other are encoded as running texts, cut again where a token begins with a space."""
        joined = [w for w in new if " " not in w] if lead else []
        for at in range(0, len(joined), 20_000):
            some = joined[at : at + 20_000]
            runs = [lead + lead.join(some[i : i + 500]) for i in range(0, len(some), 500)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)), np.int64)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(some):  # the tokenizer has other ways with spaces
                joined = joined[:at]
                break
            self._enter(table, some, ids, np.diff(begins, append=len(ids)))
        alone = [w for w in new if w not in table] if len(joined) < len(new) else []
        for at in range(0, len(alone), 5_000):
            some = alone[at : at + 5_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([lead + w for w in some], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._enter(table, some, np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes)

    def _enter(self, table: dict[str, int], some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(some) > len(self.starts):
            self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.hits))
        at = slice(self.n, self.n + len(some))
        self.flat[self.used : self.used + total] = ids
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at] = sizes
        table.update(zip(some, range(self.n, self.n + len(some)), strict=True))
        self.n += len(some)
        self.used += total

    def _places(self, table: dict[str, int], words: list[str], lead: str) -> np.ndarray:
        """Where the table has each of the words."""
        places = np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(places < 0)):
            new = [words[i] for i in missing]
            self._learn(table, list(dict.fromkeys(new)), lead)
            places[missing] = np.fromiter(map(table.__getitem__, new), np.int64, len(new))
        return places

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if self.n > self.limit:
            self._trim()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Most texts have spaces between words alone: they are cut at all of them, and each distinct word is looked up once.
        cut = pc.split_pattern(column, " ")
        counts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        begins = np.cumsum(counts) - counts
        words = cut.flatten().dictionary_encode()
        known, index = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        del cut, words
        odd = np.fromiter((not w or w[0].isspace() for w in known), bool, len(known))[index]
        empty = np.fromiter((not w for w in known), bool, len(known))[index[begins]]
        odd[begins] = empty
        odd_text = np.logical_or.reduceat(odd, begins)
        rest = np.repeat(~odd_text, counts)
        rest[begins] = False
        rest = index[rest]
        needed = np.flatnonzero(np.bincount(rest, minlength=len(known)))
        place = np.zeros(len(known), np.int64)
        place[needed] = self._places(self.rest, [known[i] for i in needed], " ")
        rest = place[rest]
        firsts = self._places(self.first, [known[i] for i in index[begins[~odd_text]]], "")
        # The others are cut by the rule.
        other_firsts, other_rest = [], []
        for k in np.flatnonzero(odd_text):
            text = column[int(k)].as_py()
            parts = BOUNDARY.split(text) if text else []
            if parts and not parts[0]:  # the text begins with the space of its first chunk
                parts[:2] = [" " + parts[1]]
            counts[k] = len(parts)
            other_firsts += parts[:1]
            other_rest += parts[1:]
        entries = np.empty(int(counts.sum()), np.int64)
        begins = (np.cumsum(counts) - counts)[counts > 0]
        odd_text = odd_text[counts > 0]
        other = np.repeat(odd_text, counts[counts > 0])
        inner = np.ones(len(entries), bool)
        inner[begins] = False
        entries[inner & ~other], entries[begins[~odd_text]] = rest, firsts
        if len(other_firsts):
            entries[inner & other], entries[begins[odd_text]] = self._places(self.rest, other_rest, " "), self._places(self.first, other_firsts, "")
        seen = np.bincount(entries, minlength=1)
        self.hits[: len(seen)] += seen.astype(np.int32)
        sizes = self.sizes[entries].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[entries] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


class Decoder:
    """Bytes of ids: the vocabulary's characters go back through the byte table, and a character split over tokens is whole again when their bytes are joined."""

    def __init__(self, tokenizer):
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.table = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            self.table[i] = bytes(back[c] for c in shown)
        self.sizes = np.fromiter(map(len, self.table), np.int64, len(self.table))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token starts."""
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes


def _maker(path: str, pattern: str | None):
    return file_tokenizer(path) if pattern is None else rank_tokenizer(path, pattern)


#: Entries of the table of chunks for a rank file, whose worker also holds the ranks, and for a tokenizer file.
RANK_CHUNKS, FILE_CHUNKS = 150_000, 1_000_000


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None = None) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each Python worker, so that its tasks share the table of chunks."""
    tokenizer = _maker(path, pattern)
    return Encoder(tokenizer, FILE_CHUNKS if pattern is None else RANK_CHUNKS), Decoder(tokenizer)


def forget() -> None:
    """Drop all that a worker remembers of tokenizers."""
    for kept in (codec, rank_tokenizer, file_tokenizer, read_ranks):
        kept.cache_clear()


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and, if wanted, starts (array of int: the byte at which each token starts), for every row.

    ``pattern`` is given for rank files and None for tokenizer files. A null or empty text has no ids. Repeated rows stay; other columns are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        encoder, decoder = codec(path, pattern)
        for piece in pieces(batches):
            ids, counts = encoder.encode(piece.column(1))
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            out = [piece.column(0), pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))]
            if offsets:
                parts = [decoder.offsets(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
                out.append(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(parts).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "starts"][: len(out)])

    return docs_of(docs, id_col, text_col).mapInArrow(tidied(run, codecs=True), "doc_id long, ids array<int>" + ", starts array<int>" * offsets)


def decode(tokens: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, content (binary) of rows with doc_id and ids; a null or empty list has no bytes. Repeated rows and null ids stay; an empty table gives no rows."""

    def run(batches):
        _, decoder = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoder.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return tokens.select("doc_id", "ids").mapInArrow(tidied(run, codecs=True), "doc_id long, content binary")


def digests(docs: DataFrame, path: str, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, and decoded from the ids, in one pass; and the ids, if wanted, behind n_tokens.

    A null or empty text has no ids and no bytes. Repeated rows and null ids stay; other columns are left out. An empty table gives no rows.
    """
    import hashlib

    def run(batches):
        encoder, decoder = codec(path, pattern)
        for piece in pieces(batches):
            ids, counts = encoder.encode(piece.column(1))
            parts = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
            out = {"doc_id": piece.column(0), "n_tokens": pa.array(counts)}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            out["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in parts])
            out["decoded_sha256"] = pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in parts])
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs_of(docs).mapInArrow(tidied(run, codecs=True), "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
