"""Documents into partitions of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_count, trimmed

DEFAULT_MAX, LOCKFILE_MAX = 8000, 2000
SECTION = "\n(?=# )"


def section_title(text: Column) -> Column:
    title = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.when(title != "", trimmed(title))


def sections(text: Column) -> Column:
    """Array of sections that start with a first-level heading."""
    return F.filter(F.transform(F.split(text, SECTION), trimmed), lambda s: s != "")


def greedy_starts(lines: Column, limit: Column | int) -> Column:
    """First lines (from 0) of windows that take lines, each with its line end, while they fit; the first line always fits. The fold carries the starts alone, not the lines."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    zero = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(state: Column, line: Column) -> Column:
        size = F.char_length(line) + 1
        over = (state["size"] > 0) & (state["size"] + size > limit)
        return F.struct(F.when(over, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"), F.when(over, size).otherwise(state["size"] + size).alias("size"), (state["at"] + 1).alias("at"))

    return F.aggregate(lines, zero, step, lambda s: s["starts"])


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named; lambdas would compute a plain expression again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_array(text: Column, limit: Column | int) -> Column:
    """Array of content, start_line, end_line of greedy line windows; blank windows are left out."""

    def of(lines: Column) -> Column:
        def spans(starts: Column) -> Column:
            return F.transform(starts, lambda s, i: F.struct(s.alias("a"), F.coalesce(F.try_element_at(starts, i + 2), F.size(lines)).alias("b")))

        made = F.transform(let(greedy_starts(lines, limit), spans), lambda x: F.struct(trimmed(F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n")).alias("content"), (x["a"] + 1).alias("start_line"), x["b"].alias("end_line")))
        return F.filter(made, lambda x: x["content"] != "")

    return let(F.split(text, "\n"), of)


def line_windows(df: DataFrame, text: str, limit: Column | int) -> DataFrame:
    """df with window_index, content, start_line, end_line. Windows are made and numbered within their row."""
    out = df.select("*", F.posexplode(window_array(F.col(text), limit)).alias("window_index", "_w"))
    return out.select(*df.columns, "window_index", "_w.*")


def _section_parts(text: Column, limit: Column) -> Column:
    """Array of partitions of a long document: whole sections, and slices of those beyond the limit."""
    none = F.lit(None).cast("int")

    def piece(content: Column, place: Column, whole: bool, title: Column) -> Column:
        return F.struct(content.alias("content"), none.alias("start_line"), none.alias("end_line"), place.alias("place"), F.lit(whole).alias("whole"), title.alias("section"))

    def of(section: Column, place: Column) -> Column:
        def titled(title: Column) -> Column:
            slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(section) - 1), limit), lambda a: piece(trimmed(F.substring(section, a + 1, limit)), place, False, title))
            return F.when(F.char_length(section) <= limit, F.array(piece(section, place, True, title))).otherwise(slices)

        return let(section_title(section), titled)

    return F.filter(F.flatten(F.transform(sections(text), of)), lambda x: x["content"] != "")


def partition_documents(docs: DataFrame) -> DataFrame:
    """partition_id, path, index, total, status, content, start_line, end_line, doc_offset, section of each partition. docs: path, source_type, artifact_kind, content, and parse_error if known. All partitions of a document are made within its row: one scan and no shuffle."""
    limit, code = F.col("limit"), F.col("source_type") == "code"
    bad = F.col("parse_error").isNotNull() if "parse_error" in docs.columns else F.lit(False)
    base = docs.select("path", "source_type", F.regexp_replace("content", "\r\n", "\n").alias("text"), F.when(F.col("artifact_kind") == "lockfile", LOCKFILE_MAX).otherwise(DEFAULT_MAX).alias("limit"), bad.alias("bad")).withColumn("big", F.char_length("text") > limit)
    none, no_title = F.lit(None).cast("int"), F.lit(None).cast("string")
    whole = F.struct(F.col("text").alias("content"), F.when(code, F.lit(1)).alias("start_line"), F.when(code, line_count(F.col("text")).cast("int")).alias("end_line"), F.when(code, none).otherwise(0).alias("place"), F.lit(True).alias("whole"), no_title.alias("section"))
    windows = F.transform(window_array(F.col("text"), limit), lambda x: F.struct(x["content"].alias("content"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), none.alias("place"), F.lit(True).alias("whole"), no_title.alias("section")))
    parts = F.when(~F.col("big"), F.array(whole)).when(code, windows).otherwise(_section_parts(F.col("text"), limit))
    # the one-element generator makes the array an attribute that is not computed again
    found = base.select("path", "bad", "big", F.explode(F.array(parts)).alias("p")).select("path", "bad", "big", F.size("p").cast("long").alias("total"), F.posexplode("p").alias("index", "x"))
    status = F.when(F.col("bad"), "degraded").when(F.col("big") & (F.col("index") == 0), "partial").otherwise("complete")
    return found.select(
        "path", "index", "x.content", "x.start_line", "x.end_line", F.when(F.col("x.place").isNotNull(), F.when(F.col("x.whole"), F.col("x.place")).otherwise(F.col("index"))).alias("doc_offset"), "x.section", "total", status.alias("status"), F.concat_ws(":", "path", F.col("index").cast("string")).alias("partition_id"),
    )


#: Precedence of partition states.
STATUS_ORDER = ("failed", "partial", "degraded", "skipped", "complete")


def status_rollup(partitions: DataFrame) -> DataFrame:
    """path and the state that takes precedence among its partitions."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return partitions.groupBy("path").agg(F.min_by("status", rank).alias("status"))


def merge_parsed(parts: DataFrame, arrays: tuple[str, ...], firsts: tuple[str, ...] = ("language", "package_name")) -> DataFrame:
    """One row per path from the parsed partitions of it (path, index, arrays and values): arrays one after another in the order of partitions, of each value the first that isn't null."""
    ordered = F.sort_array(F.collect_list(F.struct("index", *(F.col(c) for c in (*arrays, *firsts)))))
    whole = parts.groupBy("path").agg(ordered.alias("p"))
    known = lambda c: F.transform(F.filter("p", lambda x: x[c].isNotNull()), lambda x: x[c])
    return whole.select("path", *(F.flatten(known(c)).alias(c) for c in arrays), *(F.try_element_at(known(c), F.lit(1)).alias(c) for c in firsts))
