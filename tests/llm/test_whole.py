"""Cases that an operator once left out: lone alignments, short lines and the like."""

import random
import re

import pytest

import corpus_pipeline
from lodeframe.llm import decontaminate, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_rejects_texts_without_common_words(spark):
    r = random.Random(1)
    word = lambda least=2: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(least, 9)))
    said = [w for w in quality.COMMON["en"] if w != "no"]
    prose = lambda n: " ".join(r.choice(said) if r.random() < 0.3 else word() for _ in range(n)).capitalize() + "."
    good = [" ".join(prose(10) for _ in range(20)) for _ in range(40)]
    noise = "\n".join(" ".join(word() for _ in range(10)).capitalize() + "." for _ in range(20))
    letters = "\n".join(" ".join(word(1) for _ in range(10)).capitalize() + "." for _ in range(20))
    digits = " ".join(str(r.randint(10**6, 10**7)) for _ in range(55)) + " the of"
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*good, noise, letters, digits])], SCHEMA)
    got = {v.doc_id: v for v in quality.verdicts(df).collect()}
    assert all(got[i].kept for i in range(40))
    assert not any(got[i].kept or got[i].base_failed for i in (40, 41, 42))
    assert got[42].char_distance > quality.Limits().chars


def _leaks(spark, texts, items, **limits):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, decontaminate.Limits(**limits)).collect()}


@pytest.mark.parametrize("limits", [{}, {"broadcast_windows": 0}])
def test_items_of_slots_are_found_verbatim(spark, limits):
    items = [
        "Continue: 2, 4, 8, 16, 32, 64, 128, ?",
        "Rank Paris, London, Berlin, Madrid, Rome and Vienna by size",
        "12 13 14",
        "Write down which of these numbers is even and which is odd: 11, 12, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42",
        "Fresh bread smells good today",
    ]
    texts = ["Some words before it and then " + x + " and a few words more" for x in items]
    others = ["Continue: 3, 5, 9, 17, 33, 65, 129, ?", "Rank Oslo, Lisbon, Athens, Dublin, Prague and Warsaw by size", "12 15 14"]
    alike = "Write down which of these numbers is even and which is odd: 51, 52, 55, 58, 61, 64, 67, 70, 73, 76, 79, 82"
    assert _leaks(spark, [*texts, *others, alike], items, **limits) == {*((i, i) for i in range(5)), (8, 3)}


ITEM = "when Sam Miller buys 12 kg of apples and then Sam Miller gives away 12 kg of pears how many kg of fruit has Sam Miller now"


def test_every_alignment_is_checked(spark):
    """A text of the item's shape with inconsistent slots comes first, or again and again; the verbatim item behind it counts."""
    other = ITEM
    for x, y in zip(("Sam Miller", "12 kg", "Sam Miller", "12 kg", "Sam Miller"), ("Tom Jones", "40 kg", "Ruth Baker", "7 kg", "Anna Cook")):
        other = other.replace(x, y, 1)
    assert _leaks(spark, [other, other + " x y z " + ITEM, ITEM + " x y z " + other, " x ".join([other] * 5 + [ITEM])], [ITEM]) == {(1, 0), (2, 0), (3, 0)}


def test_a_stray_window_moves_no_alignment():
    words, item = ["x", *ITEM.split()], ITEM.split()
    found = [(at, 1) for at in range(len(item) - 7)]
    n = decontaminate.agreed(words, item, found, 8)
    assert n and decontaminate.agreed(words, item, [*found, (3, -2)], 8) == n
    wrong = list(words)
    wrong[2:4], wrong[12:14], wrong[24:26] = ["Tom", "Jones"], ["Ruth", "Baker"], ["Anna", "Cook"]
    assert decontaminate.agreed(wrong, item, found, 8) is None and decontaminate.agreed(wrong, item, [*found, (3, -2)], 8) is None


def test_equal_short_lines_go(spark):
    texts = ["All rights reserved.\nOne\n\nReleased under the MIT License.\nits own words", "Two\n All  rights reserved.\n\nOne\nAll rights kept.", "Released under the MIT License.", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: "Two\n\nOne\nAll rights kept.", 3: None}
