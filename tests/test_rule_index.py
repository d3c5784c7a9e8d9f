"""First matches among many rules, against trying every rule in order."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.operators.rule_index import first_matches, indexed_ttl, name_pieces, prepared_rules, required_pieces

WORDS = ["db", "os", "cpu", "load", "SQL", "queries", "innodb", "lock", "time", "avg", "max", "total", "Ünï", "io"]


def plain(names, rules):
    ordered = [(o, t, re.compile(p)) for o, p, t in sorted(rules, key=lambda r: (r[0], r[2]))]
    found = {}
    for name in set(names):
        for ordinal, ttl, regex in ordered:
            if name is not None and regex.search(name):
                found[name] = (ordinal, ttl)
                break
    return found


@pytest.mark.parametrize(("pattern", "pieces"), [
    (r"^db\.load\..*", (["db.load."], True)), (r".*\.max$", ([".max"], False)), ("^os", (["os"], True)), ("a|b", ([], False)), ("(?i)cpu", ([], False)),
    ("ab?c", (["a", "c"], False)), ("ab*", (["a"], False)), ("ab+c", (["ab", "c"], False)), ("ab{0,2}c", (["a", "c"], False)), ("ab{2}c", (["ab", "c"], False)),
    ("(abc)?def", (["def"], False)), ("^(abc)def", (["def"], False)), ("^[ab]cd", (["cd"], False)), ("^a?bc", (["bc"], False)), ("x(?:y|z)w", (["x", "w"], False)),
    (r"a\.b\d+c", (["a.b", "c"], False)), (r"[]x]ab", (["ab"], False)), (".*", ([], False)), ("", ([], False)), (r"\x41b", ([], False)), ("a(b", ([], False)), ("^ab*?c", (["a", "c"], True)),
])
def test_pieces(pattern, pieces):
    assert required_pieces(pattern) == pieces


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"\^?([ab.]|\\\.|[ab][*+?]|\(ab?\)[*?]?|\[ab\]|a\{[0-2],?3?\}){0,7}\$?", fullmatch=True), st.text("ab.", max_size=9))
def test_a_match_has_all_pieces(pattern, name):
    pieces, anchored = required_pieces(pattern)
    if re.search(pattern, name):
        assert all(p in name for p in pieces) and (not anchored or name.startswith(pieces[0]))


def test_twenty_thousand_rules(spark):
    rng = random.Random(3)
    names = [".".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) + rng.choice(["", f"{rng.randrange(300)}"]) for _ in range(700)] + ["", "x", "db", "^db."]
    rules = []
    for i in range(20_000):
        a, b, n = rng.choice(WORDS), rng.choice(WORDS), rng.randrange(100_000)
        shape = rng.randrange(8)
        rules.append((rng.randrange(15_000), [
            f"^{a}\\.{b}{n}", f"{a}.*{b}{n}$", f"{b}\\.{a}{n % 400}", f"[.]{a}[.]{b}{n}$", f"^{a}[.]{b}[.]{a}[.]{b}{n % 300}$", f"({a}|{b}){n}", f"{a}{n}?x", f"^{a}{n}|{b}{n}$",
        ][shape] if i % 40 or shape in (5, 7) else f"^{a}.*{b}$", rng.randrange(1000)))
    rules += [(14_990, "^(?:io|cpu)$", 5), (14_991, "^.$", 6), (14_992, "^$", 7), (14_993, "total[0-9]*$", 8)]
    table = spark.createDataFrame(rules + [(None, "a", 1), (1, None, 1)], "ordinal long, pattern string, ttl_us long").repartition(4)
    rows = spark.createDataFrame([(n, k) for k, n in enumerate(names + names[:50] + [None])], "metric string, k int")
    want = plain(names, rules)
    assert {r.name: (r.ordinal, r.ttl_us) for r in first_matches(rows.select("metric"), table).collect()} == want
    got = indexed_ttl(rows, table)
    assert got.columns == ["metric", "k", "pattern_ttl_us"] and got.count() == len(names) + 51
    assert all(r.pattern_ttl_us == want.get(r.metric, (0, 0))[1] for r in got.collect())


def test_the_data_is_aggregated_once_for_its_names(spark):
    rows = spark.range(1000).select(F.concat(F.lit("db.c"), F.col("id") % 7).alias("metric"))
    rules = spark.createDataFrame([(1, "^db", 5), (2, ".", 6)], "ordinal long, pattern string, ttl_us long")
    plan = indexed_ttl(rows, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and plan.count("Join LeftOuter") == 1 and "Cartesian" not in plan
    assert [r.pattern_ttl_us for r in indexed_ttl(rows, rules.limit(0)).distinct().select("pattern_ttl_us").distinct().collect()] == [0]


def test_rules_of_one_pattern_are_one_and_names_meet_whole_pieces(spark):
    rules = spark.createDataFrame([(9, "^db[.]c[0-9]+7[.]", 4), (3, "^db[.]c[0-9]+7[.]", 6), (3, "^db[.]c[0-9]+7[.]", 5), (1, "c123456", 8)], "ordinal long, pattern string, ttl_us long")
    ready = prepared_rules(rules)
    assert {(r.pattern, r.ordinal, r.ttl_us, tuple(r.pieces)) for r in ready.collect()} == {("^db[.]c[0-9]+7[.]", 3, 5, ("7", "^db", "c")), ("c123456", 1, 8, ("c123456",))}
    names = spark.createDataFrame([(f"db.c{n}.x",) for n in (123456, 123457, 234567)] + [("",), ("ü",)], "name string")
    pieces = ready.select(F.explode("pieces").alias("piece"))
    # Stretches that begin as a piece and are as long; every name with the first four characters does not meet the rule.
    assert {r.name for r in name_pieces(names, pieces).where("piece = 'c123456'").collect()} == {"db.c123456.x"}
    got = {r.name: (r.ordinal, r.ttl_us) for r in first_matches(names, rules).collect()}
    assert got == {"db.c123456.x": (1, 8), "db.c123457.x": (3, 5), "db.c234567.x": (3, 5)}


@pytest.mark.parametrize("length", [1, 3, 4, 5, 31, 32, 33, 64, 90])
def test_pieces_of_any_length(spark, length):
    text = "".join(chr(ord("a") + k % 23) for k in range(length))
    names = spark.createDataFrame([(f"x{text}y",), (text,), (text[:-1],), ("x" + text[1:],)], "name string")
    rules = spark.createDataFrame([(1, text, 5), (0, "^" + text, 6)], "ordinal long, pattern string, ttl_us long")
    assert {r.name: r.ttl_us for r in first_matches(names, rules).collect()} == {f"x{text}y": 5, text: 6}
