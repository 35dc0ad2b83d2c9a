"""Secret scans: fixed patterns and a linear-chain conditional random field.

The field tags each word of a text as begin, inside or outside of a secret from the shapes of the word and its neighbours and from features of the file. It is trained here, on sequences made by a rule from a fixed seed, by gradient ascent on the regularised log-likelihood. Viterbi decoding is exact but need not touch every word: where the outside score leads by more than any transitions could win back, the best path is outside, so only the runs between such words are decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, pieces, word_re

#: The patterns of the base rule and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

KEYWORD = re.compile(r"pass|pwd|secret|token|key|auth|bearer|cred", re.I)
PREFIX = re.compile(r"""["'(=:]*(sk[-_]|pk_|rk_|gh[pousr]_|github_pat_|xox[abprs]-|glpat-|AKIA|ASIA|AIza|eyJ|ya29|npm_|hf_|SG\.)""")
EDGES = "\"'`.,;:!?()[]{}<>|"
FEATURES = (
    "short", "middle", "long", "longer", "longest", "upper", "title", "plain", "digits", "some_digit", "mixed", "all_hex", "base64", "changes", "many_changes", "keyword", "key_end", "prefix", "mark", "quote_open", "quote_close", "assigned", "url", "mail", "no_vowel", "other_script", "fence",
)
AT = {name: k for k, name in enumerate(FEATURES)}
N_FILE = 3
O, B, I = 0, 1, 2


def shape(word: str) -> list[int]:
    """Features of a word."""
    core = word.strip(EDGES)
    n = len(core)
    on = ["short" if n < 5 else "middle" if n < 8 else "long" if n < 16 else "longer" if n < 32 else "longest"]
    if core.isalpha() and not core.isascii():
        on.append("other_script")
    if core.isalpha() and (core.islower() or core[1:].islower()):
        on.append("plain" if core.islower() else "title")
        if n > 2 and KEYWORD.search(core):
            on.append("keyword")
            if word[-1] in "=:":
                on.append("key_end")
        if word[0] in "\"'`":
            on.append("quote_open")
        if word[-1] in "\"'`":
            on.append("quote_close")
        return [AT[x] for x in on]
    if not core:
        on.append("fence" if word.startswith("---") else "mark")
        if word in ("=", ":", ":=", "=>", "=="):
            on.append("key_end")
        return [AT[x] for x in on]
    if core.isdigit():
        on.append("digits")
    elif any(c.isdigit() for c in core):
        on.append("some_digit")
    if core.isupper():
        on.append("upper")
    if any(c.islower() for c in core) and any(c.isupper() for c in core[1:]) and any(c.isdigit() for c in core):
        on.append("mixed")
    if n >= 16 and not set(core) - set("0123456789abcdef"):
        on.append("all_hex")
    if n >= 12 and re.fullmatch(r"[A-Za-z0-9+/_=-]+", core):
        on.append("base64")
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in core]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if changes * 4 >= n and n >= 8:
        on.append("changes")
        if changes * 2 >= n:
            on.append("many_changes")
    if KEYWORD.search(core):
        on.append("keyword")
    if word[-1] in "=:":
        on.append("key_end")
    if PREFIX.match(word):
        on.append("prefix")
    if word[0] in "\"'`":
        on.append("quote_open")
    if word[-1] in "\"'`":
        on.append("quote_close")
    if re.search(r"\w[\"']?[=:][\"']?[\w+/-]{8}", word):
        on.append("assigned")
    if "://" in word or "www." in word:
        on.append("url")
    if re.search(r"\w@\w+\.", word):
        on.append("mail")
    if n >= 8 and not set(core.lower()) & set("aeiou"):
        on.append("no_vowel")
    if "-----" in word:
        on.append("fence")
    return [AT[x] for x in on]


def file_features(text: str) -> list[bool]:
    return ["=" in text, ":" in text, "-----BEGIN" in text]


def sequences(n: int = 700, seed: int = 7) -> list[tuple[list[str], list[int], list[bool]]]:
    """Made-up lines of words with their tags and the features of the file they stand in."""
    r = random.Random(seed)
    pick = lambda alphabet, low, high: "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))
    letters, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    parts = "the of er in tion an re he ou en le la de qu ci os ung ver sch be st ment eau é ü ñ ó".split()

    def plain() -> str:
        w = "".join(r.choice(parts) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6))))
        w = r.choice((w, w, w, w, w, w.capitalize(), w.upper() if r.random() < 0.3 else w))
        return w + r.choice(("", "", "", "", ".", ",", ":", "!!", "###", "$$$") if r.random() < 0.4 else ("",))

    def lookalike() -> str:
        return r.choice((
            lambda: pick(string.digits, 4, 19), lambda: f"{plain()}@{pick(string.ascii_lowercase, 3, 9)}.com", lambda: f"https://{pick(string.ascii_lowercase, 3, 9)}.org/{pick(string.ascii_lowercase, 2, 12)}/{pick(string.digits, 1, 6)}",
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{plain()}-{plain()}", lambda: plain().capitalize() + plain().capitalize(),
            lambda: f"+{pick(string.digits, 2, 3)}-{pick(string.digits, 3, 4)}-{pick(string.digits, 4, 6)}", lambda: f"{pick(string.ascii_lowercase, 3, 8)}_{pick(string.ascii_lowercase, 3, 8)}={pick(string.digits, 1, 4)}", lambda: r.choice(("|", "-", "=", ":", "*", "---")), lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}",
        ))()

    def secret() -> list[tuple[str, int]]:
        value = r.choice((
            lambda: pick("0123456789abcdef", 24, 64), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: r.choice(("ghp_", "gho_", "hf_", "npm_")) + pick(letters, 30, 36), lambda: r.choice(("sk-", "sk_live_", "pk_test_", "rk_live_")) + pick(letters, 20, 48),
            lambda: pick(b64, 24, 60) + r.choice(("", "=", "==")), lambda: "xoxb-" + pick(string.digits, 10, 12) + "-" + pick(letters, 20, 24), lambda: "eyJ" + pick(letters, 15, 30) + "." + pick(letters, 20, 40) + "." + pick(letters, 20, 40), lambda: "AIza" + pick(letters, 35, 35), lambda: pick(letters + "!@#$%", 10, 20),
        ))()
        name = r.choice("password passwd secret token api_key apikey auth_token access_key credential pwd API_KEY Secret".split())
        quote = r.choice(('"', '"', "'", ""))
        how = r.randrange(6)
        if how == 0:
            return [(name, O), (r.choice(("=", ":", ":=")), O), (quote + value + quote, B)]
        if how == 1:
            return [(name + r.choice("=:"), O), (quote + value + quote, B)]
        if how == 2:
            return [(f"{name}={quote}{value}{quote}", B)]
        if how == 3:
            return [(r.choice(("Bearer", "Authorization:", "token", "key")), O), (value, B)]
        if how == 4:
            lines = [(pick(b64, 40, 64), I) for _ in range(r.randint(1, 3))]
            return [("-----BEGIN", O), ("PRIVATE", O), ("KEY-----", O), (pick(b64, 40, 64), B), *lines, ("-----END", O), ("PRIVATE", O), ("KEY-----", O)]
        return [(value if len(value) > 20 else f"{name}={value}", B)]

    out = []
    for _ in range(n):
        line: list[tuple[str, int]] = []
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            line += [(plain() if r.random() < 0.85 else lookalike(), O) for _ in range(r.randint(0, 8))] + secret()
        line += [(plain() if r.random() < 0.8 else lookalike(), O) for _ in range(r.randint(1, 12))]
        words = [w for w, _ in line]
        out.append((words, [t for _, t in line], file_features(" ".join(words) if r.random() < 0.7 else " ".join(words) + " a = b : c")))
    return out


class Field:
    """Weights: for the features of a word, of the one before and of the next, for the file, and for transitions."""

    def __init__(self, own, before, after, file, moves):
        self.own, self.before, self.after, self.file, self.moves = own, before, after, file, moves
        gain = [moves[p, x] + moves[x, q] - moves[p, O] - moves[O, q] for x in (B, I) for p in range(3) for q in range(3)]
        self.lead = max(0.0, *map(float, gain)) + 1e-6

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a run between two words that are outside."""
        best, back = scores[0] + self.moves[O], []
        for row in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        tags = [int((best + self.moves[:, O]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def emissions(self, words: list[str], file: list[bool]) -> np.ndarray:
        own = [shape(w) for w in words]
        out = np.stack([self.own[f].sum(0) for f in own])
        out[1:] += np.stack([self.before[f].sum(0) for f in own])[:-1]
        out[:-1] += np.stack([self.after[f].sum(0) for f in own])[1:]
        return out + self.file[np.array(file)].sum(0)


@lru_cache(maxsize=1)
def trained(steps: int = 160, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Train on :func:`sequences` with Adam; forward and backward sums run over all sequences at once."""
    data = sequences()
    n, size, f = len(data), max(len(w) for w, *_ in data), len(FEATURES)
    x = np.zeros((n, size, 3 * f + N_FILE))
    y = np.zeros((n, size), np.int64)
    real = np.zeros((n, size), bool)
    for k, (words, tags, file) in enumerate(data):
        real[k, : len(words)] = True
        y[k, : len(words)] = tags
        for i, w in enumerate(words):
            on = shape(w)
            x[k, i, on] = 1
            if i + 1 < len(words):
                x[k, i + 1, [f + j for j in on]] = 1
            if i:
                x[k, i - 1, [2 * f + j for j in on]] = 1
            x[k, i, 3 * f :] = file
    flat, truth = x[real], np.eye(3)[y] * real[..., None]
    pairs = real[:, 1:]
    seen_moves = np.einsum("nia,nib->ab", truth[:, :-1] * pairs[..., None], truth[:, 1:])
    last = real.sum(1) - 1
    seen_moves[O] += truth[:, 0].sum(0)
    seen_moves[:, O] += truth[np.arange(n), last].sum(0)
    weights = np.zeros(x.shape[2] * 3 + 9)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    lse = lambda a, axis: (t := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - t).sum(axis))
    for step in range(1, steps + 1):
        w, moves = weights[:-9].reshape(-1, 3), weights[-9:].reshape(3, 3)
        e = x @ w
        ahead, behind = np.zeros((n, size, 3)), np.zeros((n, size, 3))
        ahead[:, 0] = e[:, 0] + moves[O]
        for i in range(1, size):
            ahead[:, i] = np.where(real[:, i, None], lse(ahead[:, i - 1, :, None] + moves, 1) + e[:, i], ahead[:, i - 1])
        for i in range(size - 1, -1, -1):
            follow = lse(moves + (e[:, i + 1] + behind[:, i + 1])[:, None, :], 2) if i + 1 < size else 0
            behind[:, i] = np.where((i == last)[:, None], moves[:, O], follow)
        z = lse(ahead[np.arange(n), last] + moves[:, O], 1)
        share = np.exp(ahead + behind - z[:, None, None]) * real[..., None]
        two = np.exp(ahead[:, :-1, :, None] + moves + (e + behind)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        expected = two.sum((0, 1))
        expected[O] += share[:, 0].sum(0)
        expected[:, O] += share[np.arange(n), last].sum(0)
        grad = np.concatenate([(flat.T @ (truth - share)[real]).ravel(), (seen_moves - expected).ravel()]) / n - decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = weights[:-9].reshape(-1, 3)
    return Field(w[:f], w[f : 2 * f], w[2 * f : 3 * f], w[3 * f :], weights[-9:].reshape(3, 3))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of what the patterns find; leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Tagger:
    """Tags words of many texts; the scores of each word are remembered in a table of bounded size."""

    def __init__(self, field: Field, limit: int = 500_000):
        self.field, self.limit = field, limit
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, 9))

    def tag(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the words (first, last) of each secret."""
        if len(self.seen) > self.limit:
            self._reset()
        words = [word_re.findall(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not flat:
            return out
        if new := [w for w in dict.fromkeys(flat) if w not in self.seen]:
            n, f = len(self.seen), self.field
            while n + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            table = np.concatenate([f.own, f.before, f.after], 1)
            shapes = [shape(w) for w in new]
            ends = np.cumsum([len(s) for s in shapes])
            self.scores[n : n + len(new)] = np.add.reduceat(table[[i for s in shapes for i in s]], np.concatenate([[0], ends[:-1]]))
            self.seen.update(zip(new, range(n, n + len(new))))
        rows = self.scores[np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))]
        doc = np.repeat(np.arange(len(texts)), sizes)
        starts = np.cumsum(sizes) - sizes
        score = rows[:, :3].copy()
        joined = doc[1:] == doc[:-1]
        score[1:] += rows[:-1, 3:6] * joined[:, None]
        score[:-1] += rows[1:, 6:9] * joined[:, None]
        score += np.array([self.field.file[np.array(file_features(t))].sum(0) for t in texts])[doc]
        open_ = np.flatnonzero(score[:, O] - score[:, 1:].max(1) <= self.field.lead)
        if not len(open_):
            return out
        cuts = np.flatnonzero((np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])) + 1
        for run in np.split(open_, cuts):
            tags = self.field.viterbi(score[run])
            for i, t in zip(run.tolist(), tags):
                if t == O:
                    continue
                k = int(doc[i])
                at = i - int(starts[k])
                if t == I and out[k] and out[k][-1][1] == at - 1:
                    out[k][-1] = (out[k][-1][0], at)
                else:
                    out[k].append((at, at))
        return out


LEAD_IN = re.compile(r"""[\w.-]*["']?[=:]["']?(?=[\w+/.-]{8})""")


def spans_of(text: str, tagged: list[tuple[int, int]], least: int = 8) -> list[tuple[int, int, int]]:
    """All spans of a text: those of the patterns, and the tagged secrets that touch none of them, without quotes and names around them."""
    base = base_spans(text)
    if not tagged:
        return base
    places = [m.span() for m in word_re.finditer(text)]
    extra = []
    for first, last in tagged:
        start, end = places[first][0], places[last][1]
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        if (m := LEAD_IN.match(text, start, end)) and KEYWORD.search(m[0]):
            start = m.end()
        if end - start >= least and not any(a < end and start < b for a, _, b in base):
            extra.append((start, KINDS.index("crf"), end))
    return sorted(base + extra)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row; spans are kind:start:end in code points, comma-joined by start.

    A null or empty text has no spans. Repeated rows stay. An empty table gives no rows.
    """
    field = trained()

    def run(batches):
        tagger = Tagger(field)
        for piece in pieces(batches):
            texts = piece.column(1).to_pylist()
            found = [spans_of(t, tags) for t, tags in zip(texts, tagger.tag(texts))]
            text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            base = [[s for s in spans if s[1] < 3] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)), pa.array([hashlib.sha256(text(s).encode()).hexdigest() for s in base]), pa.array([text(s) for s in found])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secrets(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
