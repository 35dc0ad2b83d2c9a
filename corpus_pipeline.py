"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents, and other columns and an empty table go through. Rows that repeat an id are one document where a stage judges documents: they stay or go together. A row without an id is told by its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import bpe, decontaminate, linededup, neardup, quality
from lodeframe.llm.common import Tables, files_for, text_volume

#: Ids given to rows without one begin here, above those of documents, so a row that has an id is preferred.
GIVEN = 1 << 62


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _identity() -> Column:
    """The id of a row, or one made of its text."""
    made = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(GIVEN - 1)).bitwiseOR(F.lit(GIVEN))
    return F.coalesce(F.col("doc_id").cast("long"), made)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose identity is in gone (one column), as they were."""
    key, other = _free(docs, "identity"), _free(docs, "gone")
    ids = gone.toDF(other).distinct()
    return docs.withColumn(key, _identity()).join(ids, F.col(key) == F.col(other), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _compact(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows in as many partitions as the texts they come from ask for, or fewer: a small corpus isn't scattered over hundreds of files."""
    return out.coalesce(files_for(volume=text_volume(docs)[1]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_identity().alias("doc_id"), "text")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are. Null and empty texts have no words and go; repeated rows are judged alike; a text of any length is judged whole."""
    return _compact(quality.keep_good(docs), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their near-duplicate lines; n_chars follows the text. A document that loses lines and has no word left goes; a null or empty text stays as it is. Of equal lines that of the least id and place stays; rows that repeat an id keep their lines alike; rows without an id come last."""
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    identity = _free(docs, "identity")
    done = linededup.dedup_lines(docs.withColumn(identity, _identity()), id_col=identity, carry=tuple(own))
    rest = done.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return _compact(rest.select(*((made[c] if c in made else F.col("carried").getField(c)).alias(c) for c in docs.columns)), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id, as it is. Null and empty texts are nobody's duplicate and stay."""
    found = neardup.near_duplicates(_texts(docs))
    return _compact(_without(docs, found.filter("doc_id <> component_id").select("doc_id")), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, as they are. Null and empty texts leak nothing and stay; without items all stay."""
    found = decontaminate.leaks(_texts(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _compact(_without(docs, found.select("doc_id")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the sha256 of ids and of the bytes decoded from them, of every row. A null or empty text has no ids; repeated rows and null ids stay."""
    return _compact(bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True), docs)


STAGES = [
    ("quality", good),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("tokens", tokens),
]

#: No stage but the second can be told in SQL: references by language, exact set joins over word shingles and byte-level BPE can't. tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, last = Tables(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if last:
            tables.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
