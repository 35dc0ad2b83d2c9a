"""Cases that an operator once left out: long documents, lone alignments, short lines and the like."""

import hashlib
import re

import pytest

from lodeframe.plans import catalog
from tests.run_query import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["doc_section_split", "section_titles", "chunk_identity", "chunk_key"])
def test_sections_of_long_documents(spark, tmp_path, name):
    texts = ["One. Two words. Three", "A sentence of some length. " * 300 + "The end", "x" * 5000]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got, odd = compare(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])
    assert odd is None
    want = []  # path, place, content
    for i, t in enumerate(texts):
        parts = [s.strip("\n ") for s in re.split(r"\n(?=# )", "# " + t.replace(". ", "\n# "))]
        want += [(f"d/{i}.md", j, s) for j, s in enumerate(filter(None, parts))]
    assert len(want) == 3 + 301 + 1 and sorted(got["path"]) == sorted(p for p, _, _ in want)
    if name == "doc_section_split":
        assert set(zip(got["path"], got["idx"], got["content_hash"])) == {(p, j, hashlib.sha256(s.encode()).hexdigest()) for p, j, s in want}
