"""Structural blocks of TypeScript and JavaScript files without a parser: top-level declarations by brackets. An approximation of a syntax tree; files without any fall back to line windows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Declaration kinds by how they start.
STARTS = (
    ("import_statement", r"import\b"),
    ("class_declaration", r"(?:abstract\s+)?class\b"),
    ("interface_declaration", r"interface\s+\w"),
    ("enum_declaration", r"(?:const\s+)?enum\s+\w"),
    ("type_alias_declaration", r"type\s+\w+"),
    ("function_declaration", r"(?:async\s+)?function\b"),
    ("lexical_declaration", r"(?:const|let)\b"),
    ("variable_declaration", r"var\b"),
)
STARTS = tuple((kind, re.compile(p)) for kind, p in STARTS)
EXPORT = re.compile(r"export\b")
#: What may matter in code: comments, strings, templates, brackets, slashes, ends; all else is skipped at once.
MARKS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[`{}()\[\];/\n]", re.S)
TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(?:`|\$\{|\Z)", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: A slash begins a regular expression behind one of these, and divides behind anything else.
BEFORE_REGEX = re.compile(r"(?:^|[-+*%=(,;:!&|?{}\[~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await))\s*\Z")
GOES_ON = re.compile(r"\s*(?:from\b|as\b|=>|[.;,)=]|satisfies\b)")
GOES_ON_BELOW = re.compile(r"\s*(?:[.|&?:=+{]|\n)")
BLANK = re.compile(r"\s*")


def code_marks(text: str) -> list[tuple[str, int, int]]:
    """(character, start, end) of each bracket, semicolon and line end that is code, and not part of a comment, string, template text or regular expression. Templates nest: the code within ${} is read as code. One pass."""
    out: list[tuple[str, int, int]] = []
    inside: list[int] = []  # depth of braces at which each open template goes on
    at, braces = 0, 0
    while m := MARKS.search(text, at):
        c, at = m[0], m.end()
        if c == "/":
            found = REGEX.match(text, m.start()) if BEFORE_REGEX.search(text[max(0, m.start() - 40) : m.start()]) else None
            at = found.end() if found else at
            continue
        if c == "`" or c == "}" and inside and inside[-1] == braces:
            if c == "}":
                inside.pop()
            rest = TEMPLATE.match(text, at)
            at = rest.end()
            if rest[0].endswith("${"):
                inside.append(braces)
            continue
        if len(c) > 1 or c in "\"'":
            continue
        braces += (c == "{") - (c == "}")
        out.append((c, m.start(), m.end()))
    return out


def blocks_of(text: str) -> list[dict]:
    """kind, content, start_line, end_line of each top-level declaration."""
    out, at, n = [], 0, len(text)
    marks = code_marks(text)
    starts = [a for _, a, _ in marks]
    line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
    while at < n:
        head = BLANK.match(text, at).end()
        if head >= n:
            break
        kind = "export_statement" if EXPORT.match(text, head) else next((k for k, p in STARTS if p.match(text, head)), None)
        depth, end = 0, n
        for i in range(bisect_left(starts, head), len(marks)):
            c, _, after = marks[i]
            ahead = text[after : after + 40]
            if c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
                if depth <= 0 and c == "}" and not GOES_ON.match(ahead):
                    end = after
                    break
            elif depth <= 0 and (c == ";" or c == "\n" and (kind is None or not GOES_ON_BELOW.match(ahead))):
                end = after
                break
        if kind:
            body = text[head:end].strip()
            first = bisect_right(line_starts, head)
            out.append({"kind": kind, "content": body, "start_line": first, "end_line": first + body.count("\n")})
        at = max(end, head + 1)
    return out


SCRIPTS = (".ts", ".js", ".mjs", ".tsx", ".jsx")


def with_blocks(docs: DataFrame, parse=blocks_of) -> DataFrame:
    """docs with the columns blocks (null unless the file is TypeScript or JavaScript and has some) and parse_error (null unless ``parse`` failed on the file, which then has no blocks). One file's failure is its own. Only the texts of scripts go through Python."""
    schema = "array<struct<kind: string, content: string, start_line: int, end_line: int>>"

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((parse(t) or None if t is not None else None, None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(out, columns=["blocks", "parse_error"])

    parsed = F.pandas_udf(run, f"blocks {schema}, parse_error string")
    is_script = F.lit(False)
    for end in SCRIPTS:
        is_script = is_script | F.col("path").endswith(end)
    return docs.withColumn("_p", parsed(F.when(is_script, F.col("content")))).withColumn("blocks", F.col("_p.blocks")).withColumn("parse_error", F.col("_p.parse_error")).drop("_p")
