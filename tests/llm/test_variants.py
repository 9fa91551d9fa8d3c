"""Spelling variants on small inputs: odd rows, long words, ties, brute force and checking SQL."""

from brute import vocabulary
from llm_compare import compare, connect
from test_llm import ODD, SMALL, table

from lettertrail.llm import spelling


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_against_sql(spark):
    assert compare(spark, connect(SMALL), SMALL, "op11_spelling_variants") is None


def test_neighbours_brute_force(spark):
    words = ["a" * n for n in (1, 2, 3, 9, 10, 11, 40, 41)] + ["b" + "a" * 9, "a" * 5 + "b" + "a" * 4, "", "x", "straße", "strasse", "strase", "été", "ete", "eté", "abab", "baba", "ababa", "z" * 300, "z" * 150 + "y" + "z" * 149, "z" * 299]
    rows = spark.createDataFrame([(w,) for w in [*words, "x", None]], "word string")
    got = {(r["word"], r["near"]) for r in spelling.neighbours(rows).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_forms_ties_and_roots(spark):
    counts = [("kattze", 3), ("katze", 6), ("matze", 6), ("katzen", 12), ("katzeny", 13), ("allein", 5)]
    rows = spark.createDataFrame(counts, "word string, n bigint")
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(rows).collect()}
    assert got == {
        "kattze": ("katze", "katzen", 1, 6), "katze": ("katzen", "katzen", 3, 12), "matze": (None, "matze", 1, None),
        "katzen": (None, "katzen", 2, None), "katzeny": (None, "katzeny", 1, None), "allein": (None, "allein", 0, None)}
    tied = spark.createDataFrame([("house", 2), ("mouse", 9), ("douse", 9)], "word string, n bigint")
    assert {r["word"]: r["form"] for r in spelling.variants(tied).collect()} == {"house": "douse", "mouse": None, "douse": None}


def test_vocabulary_of_odd_rows(spark):
    rows = [*ODD, *[(None, "Größe x größE")] * 2, (9, "ABCDE-abcde.AbCdE abcd abcd abcd"), (10, "vw" * 3000)]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(table(spark, rows)).collect()}
    assert got == vocabulary(rows) and got["abcde"] + got["größe"] >= 5
    assert spelling.spelling_variants(table(spark, [])).collect() == []
