"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame operations only.

Two lines are near duplicates if one becomes the other by at most one edit of a word: a word inserted, deleted or replaced. The neighbourhood of a line holds the line itself and every variant with one word deleted; lines within one edit have a variant in common, so an equality join on hashed variants finds all candidates, and the edit distance is then verified. A line goes if an earlier line of the corpus (by document id, then by place) is within the bound, and so the earliest of a family stays. Short lines, of which one word is much, go only if an equal line stands earlier.

The texts are read once into a table of line digests and once more for the words of lines that may have a partner. Equal lines are reduced to their earliest occurrence. An edit leaves the words before it or behind it as they are, so lines within one edit share their first or their last half: lines that share neither with any other line have no partner and emit no variants. Both steps combine counts before they shuffle. In the join, the lines of one variant meet as pairs only through minima: for each variant and place of the deleted word, the earliest line; so a template that a third of all lines follow costs each line one row. A line that stands very often has its occurrences dealt over many tasks, each with a copy of its one verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, files_for, text_volume

#: Lines of so many words have a neighbourhood, and equal lines of so many words go too; blank lines and lines of one or two words are layout (breaks, headings, list marks).
LEAST_WORDS, LEAST_EXACT = 8, 3
#: A set of lines up to this many rows (40 bytes each, so about 12 MB) is broadcast to the scan that looks for their texts; a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Lines with more occurrences than this and than one in HOT_SHARE of all are dealt over HOT_SALTS tasks; there are HOT_SHARE of them at most.
HOT_ROWS, HOT_SHARE, HOT_SALTS = 1000, 2000, 64
#: The variants of lines up to this length are made within the row, those of longer ones over rows of words.
IN_ROW = 128


def _norm(line: Column) -> Column:
    """The words of a line with one space between. Most lines are that already but for their ends, and only others are rewritten."""
    odd = F.lit(False)
    for c in ("  ", "\t", "\v", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.trim(F.regexp_replace(F.translate(line, "\t\v\f\r", "    "), " +", " "))).otherwise(F.trim(line))


def line_table(docs: DataFrame, least_words: int, least_exact: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, at, key (the digest of the normalised line) of each line with at least ``least_exact`` words; those with ``least_words`` also have h1, h2, t1, t2, digests of the first and last words for both ways to halve the line. Lines of n and of n + 1 words agree on the size n div 2.

    Lines are normalised before they are exploded, and the words go through a one-element generator: behind a generator each is a plain attribute that nothing computes again.
    """
    least = min(least_words, least_exact)
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.transform(F.split(F.col(text_col), "\n"), _norm)).alias("at", "norm"))
    lines = lines.filter(F.octet_length("norm") >= 2 * least - 1)
    worded = lines.select("doc_id", "at", "norm", F.explode(F.array(F.split("norm", " "))).alias("words")).filter(F.size("words") >= least)
    n = F.size("words")
    part = lambda kind, size: F.when(n >= least_words, F.xxhash64(F.lit(kind), size, F.array_join(F.slice("words", 1, size) if kind == "head" else F.slice("words", -size, size), " ")))
    a, b = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return worded.select("doc_id", "at", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("key"), part("head", a).alias("h1"), part("head", b).alias("h2"), part("tail", a).alias("t1"), part("tail", b).alias("t2"))


def words_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, first, words of the wanted lines (key, first)."""
    places = wanted.select(F.col("first.doc_id").alias("d"), F.col("first.at").alias("a"), "key", "first")
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    lines = lines.filter(F.octet_length("line") >= 2 * LEAST_WORDS - 1)
    if wanted.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    found = lines.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("at") == F.col("a")))
    # rows that repeat an id have several lines at one place, so the digest decides
    named = found.select("key", "first", F.explode(F.array(_norm(F.col("line")))).alias("norm")).filter(F.unhex(F.md5(F.col("norm").cast("binary"))) == F.col("key"))
    return named.select("key", "first", F.split("norm", " ").alias("words")).dropDuplicates(["key"])


def near_lines(docs: DataFrame, lines: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, first (doc_id, at of the earliest occurrence), n (how often it stands) of each distinct line of a line table, and drop: whether an earlier different line is within one edit."""
    distinct = tables.write(lines.groupBy("key", "h1", "h2", "t1", "t2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct", files_for(lines.count()))
    parts = files_for(distinct.count())
    half = distinct.filter(F.col("h1").isNotNull()).select("key", F.explode(F.array_distinct(F.array("h1", "h2", "t1", "t2"))).alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    close = half.join(shared, "half", "left_semi").select("key").distinct()
    firsts = tables.write(distinct.join(close, "key", "left_semi").select("key", "first"), "firsts", parts)
    some = tables.write(words_of(docs, firsts, id_col, text_col), "some", parts)
    # eight bytes name a line here; should two lines share them, the words still decide below
    variants = tables.write(neighbourhood(some.select(F.xxhash64("key").alias("id"), "first", "words")), "variants", parts)
    # the earliest line for each variant and place; a line meets the earliest of its own place (a replaced word) and the line that is the variant (a deleted word), which meets the earliest of all places
    lead = variants.groupBy("variant", "gone").agg(F.min(F.struct("first", "id")).alias("lead"), F.count(F.lit(1)).alias("c"))
    by_variant = lead.groupBy("variant").agg(F.sum("c").alias("c"), F.min(F.when(F.col("gone") == -1, F.col("lead"))).alias("whole"), F.min(F.when(F.col("gone") != -1, F.col("lead"))).alias("less")).filter("c > 1")
    met = variants.join(by_variant, "variant")
    same_place = variants.join(lead.filter("c > 1 and gone <> -1"), ["variant", "gone"]).select("id", "first", F.col("lead").alias("other"))
    inserted = met.select("id", "first", F.when(F.col("gone") == -1, F.col("less")).otherwise(F.col("whole")).alias("other"))
    pairs = tables.write(same_place.unionByName(inserted).filter(F.col("other.first") < F.col("first")).select("id", F.col("other.id").alias("other")).distinct(), "pairs", parts)
    tables.drop("firsts", "variants")
    side = lambda k, w: some.select(F.xxhash64("key").alias(k), F.struct("key", "first", "words").alias(w))
    met = pairs.join(side("id", "x"), "id").join(side("other", "y"), "other").filter(F.col("y.first") < F.col("x.first"))
    verified = met.filter(within_one_edit(F.col("x.words"), F.col("y.words"))).select("x.key").distinct()
    return distinct.select("key", "first", "n").join(verified.withColumn("near", F.lit(True)), "key", "left").select("key", "first", "n", F.coalesce("near", F.lit(False)).alias("drop"))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """id, first, gone, variant: a digest of each line (gone -1) and of each variant without one word.

    The digest of words is the XOR of the hashes of each word and its place, so that of a variant is made of two running XORs: over the words before the deleted one, and over those behind it, moved by one place.
    """
    digest = lambda x, n: F.xxhash64(x, n)
    none = F.array(F.lit(0).cast("long"))
    short = lines.filter(F.size("words") <= IN_ROW).withColumn("n", F.size("words"))
    running = lambda hashes: F.aggregate(hashes, none, lambda sums, h: F.concat(sums, F.array(F.element_at(sums, -1).bitwiseXOR(h))))
    short = short.select("id", "first", "n", running(F.transform("words", lambda w, i: F.xxhash64(w, i))).alias("before"), running(F.reverse(F.transform("words", lambda w, i: F.xxhash64(w, i - 1)))).alias("behind"))
    made = F.transform(F.sequence(F.lit(-1), F.col("n") - 1), lambda i: F.struct(i.alias("gone"), F.when(i < 0, digest(F.element_at("before", -1), F.col("n"))).otherwise(digest(F.element_at("before", F.greatest(i, F.lit(0)) + 1).bitwiseXOR(F.element_at("behind", F.col("n") - F.greatest(i, F.lit(0)))), F.col("n") - 1)).alias("variant")))
    in_row = short.select("id", "first", F.explode(made).alias("v")).select("id", "first", "v.*")

    words = lines.filter(F.size("words") > IN_ROW).select("id", "first", F.size("words").alias("n"), F.posexplode("words").alias("gone", "w")).select("id", "first", "n", "gone", F.xxhash64("w", "gone").alias("here"), F.xxhash64("w", F.col("gone") - 1).alias("moved"))
    whole = Window.partitionBy("id", "first")
    upto = whole.orderBy("gone").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor("here").over(upto).bitwiseXOR(F.col("here"))
    after = F.bit_xor("moved").over(whole).bitwiseXOR(F.bit_xor("moved").over(upto))
    less = words.select("id", "first", "gone", digest(before.bitwiseXOR(after), F.col("n") - 1).alias("variant"))
    full = words.groupBy("id", "first", "n").agg(F.bit_xor("here").alias("x")).select("id", "first", F.lit(-1).alias("gone"), digest(F.col("x"), F.col("n")).alias("variant"))
    return in_row.unionByName(less).unionByName(full)


def within_one_edit(x: Column, y: Column) -> Column:
    """Whether the word lists are at an edit distance of one at most: what stands before the first and behind the last difference covers all but one word of the longer."""
    n, m = F.size(x), F.size(y)
    # the length of the common prefix is the first place that differs; the suffix is that of the reversed lists
    ahead = lambda a, b: F.coalesce(F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False), F.least(n, m).cast("long") + 1) - 1
    before, behind = ahead(x, y), ahead(F.reverse(x), F.reverse(y))
    return (F.abs(n - m) <= 1) & (before + behind >= F.greatest(n, m) - 1)


def repeated(lines: DataFrame, verdicts: DataFrame, tables: Tables, parts: int) -> DataFrame:
    """doc_id, at of the lines of a line table that go: those that are dropped and those that stand earlier. Occurrences of a line meet its verdict by key and salt; the salts of all but hot lines are 0."""
    some = tables.write(verdicts.filter(F.col("drop") | (F.col("n") > 1)), "verdicts", parts)
    total = some.agg(F.sum("n")).first()[0] or 0
    hot = some.filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("key", F.lit(HOT_SALTS).alias("salts"))
    salted = lambda df, salt: df.join(F.broadcast(hot), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salt)
    own = salted(lines.select("key", "doc_id", "at"), F.pmod(F.xxhash64("doc_id", "at"), F.col("salts")))
    told = salted(some, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
    met = own.join(told.select("key", "salt", "first", "drop"), ["key", "salt"])
    return met.filter(F.col("drop") | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("at") != F.col("first.at"))).select("doc_id", "at")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), least_exact: int = LEAST_EXACT) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every row, without its near-duplicate lines, and the columns to carry along in the struct ``carried``, whatever their names.

    Lines are compared by their words; those with fewer than ``least_words`` go only if an equal line stands earlier, and those with fewer than ``least_exact`` always stay. A longer line goes if an equal line stands earlier in the corpus, or if the earliest equal line has an earlier one within one edit. A null text stays null with no lines, an empty one has one empty line that stays. Rows with the same id count as one place each: repeated rows keep the lines of all of them; null ids come first. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "lines")
    lines = tables.write(line_table(docs, least_words, least_exact, id_col, text_col), "lines", files_for(volume=text_volume(docs, text_col)[1]))
    parts = files_for(lines.count())
    gone = repeated(lines, near_lines(docs, lines, tables, id_col, text_col), tables, parts)
    dropped = tables.write(gone.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("at").alias("gone")), "dropped", parts)
    tables.drop("lines", "distinct", "some", "pairs", "verdicts")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    joined = rows.join(dropped.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")), "left")  # one plan at every size
    all_lines = F.split("text", "\n")
    stay = F.filter(all_lines, lambda _, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return joined.select("doc_id", F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(stay, "\n").alias("text"), *(["carried"] if carry else []))


def op3_lines(spark, sf_dir):
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l
), w AS (
  SELECT *, string_split(norm, ' ') AS ws FROM k WHERE len(string_split(norm, ' ')) >= 3
), d AS (
  SELECT norm, any_value(ws) AS ws, min((doc_id, pos)) AS first FROM w GROUP BY norm
), v AS (
  SELECT norm, first, i AS gone, array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ') AS variant FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 8)
  UNION ALL SELECT norm, first, 0, norm FROM d WHERE len(ws) >= 8
), near AS (
  SELECT DISTINCT b.norm FROM v a JOIN v b ON a.variant = b.variant AND a.norm <> b.norm AND a.first < b.first AND (a.gone = b.gone OR a.gone = 0 OR b.gone = 0)
), out AS (
  SELECT w.doc_id, w.pos FROM w JOIN d USING (norm) WHERE (w.doc_id, w.pos) <> d.first OR norm IN (SELECT norm FROM near)
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(out.pos)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (out.pos IS NULL), '') AS text
FROM l LEFT JOIN out ON l.doc_id = out.doc_id AND l.pos = out.pos GROUP BY l.doc_id
"""
