import re
from collections import Counter

import pytest

from fleetlens.llm import cleaning

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j + k for j in range(len(w) - 2) if seen[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CASES = [
    None, "", " \n ", "a", "a b a b a b a b", "x y z\nx y z\n\nx y z", "a\x0bb\x0cc\r\nd", "ß non breaking space 漢字 🙂🙂", "##|| <b> $5 & 10%", "l\n\nl\n l",
    "one two three " * 400, "\n".join(f"line {i % 7} of words" for i in range(3000)),
]


def test_counts_equal_a_plain_count(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in cleaning.with_counts(rows).collect():
        n, chars, symbols, dup, repeat = base(CASES[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and (not r.kept or not r.base_failed)


GOOD = "This is a plain sentence of some length, and it ends as it should."


@pytest.mark.parametrize("line, fails", [
    (GOOD, False), ("Short title", False), ("He said: no!", False), ("Home | News | Sport | Weather", True), ("Home > World > Europe", True),
    ("BUY NOW!! CHEAP!! BEST OFFER!!", True), ("NATO and the EU met.", False), ("word### other$$$ third&&& fourth***", True), ("Copyright 2020 by us", True),
    ("Licensed under the MIT License.", True), ("Please accept all cookies to go on.", True), ("la la la la la la la la la la la la la.", True),
    ("many words that go on and on and never come to any end whatever they say", True), ("many words that go on and on and then do come to an end whatever。", False),
])
def test_rules(spark, line, fails):
    rows = spark.createDataFrame([(line,)], "line string")
    from pyspark.sql import functions as F

    assert rows.select(cleaning.line_fails(F.col("line"), cleaning.words_in(F.col("line"))).alias("f")).first().f == fails


def test_lines_go_and_documents_that_lose_too_much(spark):
    clean = "\n".join(f"Sentence{i} tells{i} something{i} new{i}, and then{i} it{i} ends{i}." for i in range(10))
    junk = "\n".join(f"LOUD{i}!! LOUDER{i}!! LOUDEST{i}!! SHOUT{i}!!" for i in range(60))
    rows = spark.createDataFrame([(1, clean + "\nAll rights reserved."), (2, clean + "\n" + junk), (3, "too short.")], "doc_id long, text string")
    got = {r.doc_id: r for r in cleaning.with_counts(rows).collect()}
    assert got[1].kept and got[1].clean_text == clean and not got[2].kept and not got[2].base_failed and not got[3].kept
    assert [tuple(r) for r in cleaning.cleaned(rows).collect()] == [(1, clean)]


def test_no_python_in_the_plan(spark, nasty):
    for df in (cleaning.with_counts(nasty), cleaning.cleaned(nasty)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nasty_rows(spark, nasty, nothing):
    rows = cleaning.with_counts(nasty)
    assert rows.columns == [*[c for c in nasty.columns if c not in cleaning.COUNTS], *cleaning.COUNTS]
    assert sorted(map(str, (tuple(r)[1:2] + (r.n_words,) for r in rows.select("doc_id", "text", "n_words").collect()))) == sorted(
        map(str, ((r.text, base(r.text)[0]) for r in nasty.collect())))
    kept = cleaning.cleaned(nasty)
    assert kept.columns == nasty.columns and {1, 2, 3, 4, 10} <= {r.doc_id for r in kept.collect()} and cleaning.with_counts(nothing).count() == 0
    assert cleaning.cleaned(nothing).count() == 0
