"""Each stage of the pipeline against a brute-force version, on rows with null ids, null and empty and long texts, repeated rows, ties and clashing columns, and on an empty table."""

import base64
import hashlib
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import quality
from tests.llm.test_ops import _edit, _leaks_by_rule

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Names that the operators use inside.
CLASHING = ("gone", "d", "n_lines", "n_dropped", "identity", "carried", "key", "first", "block", "component_id", "place", "size", "chosen")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
ITEMS = ["Tom buys 12 apples and Ann buys 30 pears in March, so how many pieces of fruit do both of them have at home now?", None, "two words"]


def _rows():
    r = random.Random(8)
    words = [a + b for a in "the of and ra sol mi ka ton ber lun".split() for b in ("", "a", "en", "ing", "ou")]
    said = quality.COMMON["en"]
    prose = lambda n: " ".join(r.choice(said) if r.random() < 0.4 else r.choice(words) for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(prose(r.randint(9, 25)) for _ in range(r.randint(4, 8)))
    base = [text() for _ in range(12)]
    near = [re.sub(r"\S+ \S+", "Other start", t, count=1) for t in base[:4]]
    leak = [text() + "\n" + ITEMS[0].replace("Tom", "Jim").replace("12", "88") + "\n" + text(), text() + "\n" + ITEMS[0]]
    lines = [base[5].split("\n")[0] + "\n" + text(), "One short line here\n" + text(), "One short line here\n" + text(), "\n\n\t\n"]
    long = [" ".join(prose(20) for _ in range(300))]
    texts = [*base, *near, *leak, *lines, *long, base[3], base[3], "", "", None, "qwx zkj " * 60, base[7], base[8] + " extra"]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2] = ids[6] = None  # without an id: a copy of 7, one near 8, and one of its own
    ids[-8], ids[-9] = 5, 5  # an id that three rows share, two of them copies
    return [(i, t, None if k % 7 == 0 else "en", "s", len(t or ""), *(f"{c}{k}" for c in CLASHING)) for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, rows):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    return str(at)


def _identity(row):
    if row[0] is not None:
        return row[0]
    return (xxhash.xxh64_intdigest((row[1] or "").encode(), 42) & ((1 << 62) - 1)) | 1 << 62


def _same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def _shingles(text):
    w = W.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_quality(spark, docs, rows, sf_dir):
    refs, limits = quality.references(docs), quality.Limits()
    kept = quality.judge([r[1] or "" for r in rows], [r[2] for r in rows], refs, limits)["kept"]
    assert 0 < sum(kept) < len(rows)
    _same(corpus_pipeline.good(spark, docs, sf_dir), [r for r, k in zip(rows, kept) if k])


def test_lines(spark, docs, rows, sf_dir):
    places = {}  # (identity, place) of each line: its words
    for r in rows:
        for at, line in enumerate((r[1] or "").split("\n") if r[1] is not None else ()):
            places.setdefault((_identity(r), at), []).append(tuple(W.findall(line)))
    first = {}
    for at, found in sorted(places.items()):
        for words in found:
            first.setdefault(words, at)
    close = {w for w in first if len(w) >= 8 for v in first if len(v) >= 8 and v != w and first[v] < first[w] and _edit(list(w), list(v)) <= 1}
    want = []
    for r in rows:
        if r[1] is None:
            want.append((*r[:4], None, *r[5:]))
            continue
        gone = {at for (i, at), found in places.items() if i == _identity(r) and any(len(w) >= 3 and (first[w] != (i, at) or w in close) for w in found)}
        all_lines = r[1].split("\n")
        rest = "\n".join(x for at, x in enumerate(all_lines) if at not in gone)
        if not gone or W.search(rest):
            want.append((r[0], rest, *r[2:4], len(rest), *r[5:]))
    assert len(want) < len(rows)
    out = corpus_pipeline.without_repeated_lines(spark, docs, sf_dir)
    assert out.columns == docs.columns
    _same(out, want)


def test_near_duplicates(spark, docs, rows, sf_dir):
    ids = [_identity(r) for r in rows]
    sets = [_shingles(r[1]) for r in rows]
    comp = ids[:]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                n = len(a & b)
                if a and b and 100 * n >= 75 * (len(a) + len(b) - n):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    gone = {i for i, c in zip(ids, comp) if i != c}
    assert gone
    _same(corpus_pipeline.one_of_each(spark, docs, sf_dir), [r for r, i in zip(rows, ids) if i not in gone])


def test_decontamination(spark, docs, rows, sf_dir):
    found = {d for d, _ in _leaks_by_rule([r[1] or "" for r in rows], [ITEMS[0]])}
    gone = {_identity(rows[d]) for d in found}
    assert len(found) == 2
    _same(corpus_pipeline.uncontaminated(spark, docs, sf_dir), [r for r in rows if _identity(r) not in gone])


def test_tokens(spark, docs, rows, sf_dir):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), ids, hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    _same(corpus_pipeline.tokens(spark, docs, sf_dir), want)


def test_empty_tables(spark, docs, sf_dir, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.uncontaminated(spark, docs, str(tmp_path)).count() == docs.count()


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), SCHEMA)
        assert docs.columns == before
    want = corpus_pipeline.tokens(spark, docs, sf_dir).select("ids_sha256", "decoded_sha256")
    got = corpus_pipeline.run(spark, sf_dir)
    assert 0 < got.count() and [c for c in got.columns][:2] == ["doc_id", "n_tokens"]
    _same(got.select("ids_sha256", "decoded_sha256"), list(map(tuple, want.collect())))
    assert got.filter(F.col("doc_id").isNull()).count() >= 1
