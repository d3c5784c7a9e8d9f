import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.functions.text import java_regex
from fleetlens.operators import rules
from fleetlens.operators.predicates import clean_identifiers, identifier_in, label_matches

NAMES = ["db.load", "db.SQL.queries", "os.cpu.idle", "os.mem", "net.rx"]


def chosen(column, names=NAMES, **kwargs):
    return dict(zip(names, column(lambda c: rules.select_statistics(c, **kwargs), names)))


def test_default_statistic_alone(column):
    assert chosen(column) == {n: ["avg"] for n in NAMES}
    assert chosen(column, default="max")["os.mem"] == ["max"]
    with pytest.raises(ValueError):
        rules.select_statistics(None, default="p99")


def test_explicit_statistics_are_added_after_the_default(column):
    got = chosen(column, include={"name": ["db.load.max", "db.load.sum", "db.load.avg", r"^os\..*.min"]})
    assert got["db.load"] == ["avg", "max", "sum"]
    assert got["os.mem"] == ["avg", "min"]
    assert got["net.rx"] == ["avg"]  # including never removes


def test_a_statistic_behind_an_anchor_is_not_explicit(column):
    assert chosen(column, include={"name": [r"load\.max$"]})["db.load"] == ["avg"]


def test_upper_case_suffix_is_recognised_but_stays_on_the_pattern(column):
    assert chosen(column, include={"name": ["db.load.MAX"]})["db.load"] == ["avg"]
    assert chosen(column, ["db.load.MAX"], include={"name": ["db.load.MAX"]})["db.load.MAX"] == ["avg", "max"]


def test_exclude_by_equality_unless_a_metacharacter_makes_it_a_pattern(column):
    got = chosen(column, exclude={"name": ["db.load", "os", "idle$"]})
    assert got["db.load"] == [] and got["os.cpu.idle"] == [] and got["os.mem"] == ["avg"]
    # the dot is no metacharacter: this is compared, not searched
    assert chosen(column, exclude={"name": ["db.l"]})["db.load"] == ["avg"]
    assert chosen(column, exclude={"category": ["os"]})["os.mem"] == []


def test_first_ttl_rule_wins_even_with_zero(column):
    ordered = [(2, "load", 7), (1, "^db", 0), (3, ".*", 9)]
    assert column(lambda c: rules.pattern_ttl(c, ordered), ["db.load", "x.load", "os"]) == [0, 7, 9]
    assert column(lambda c: rules.pattern_ttl(c, []), ["db.load"]) == [0]


def test_rule_tables(spark):
    ttl = spark.createDataFrame([(2, "b", 20), (1, "a", 10)], "ordinal int, pattern string, ttl_us bigint")
    assert rules.ttl_rules_from_table(ttl) == [(1, "a", 10), (2, "b", 20)]
    rows = [("include", "name", 2, "y"), ("include", "name", 1, "x"), ("exclude", "tag.T", 1, "z")]
    table = spark.createDataFrame(rows, "list string, field string, ordinal int, pattern string")
    assert rules.filter_rules_from_table(table) == ({"name": ["x", "y"]}, {"tag.T": ["z"]})


def keeps(fields, tags, include, exclude):
    def value(key):
        if key in fields:
            return fields[key]
        return tags.get(key[4:]) if key.startswith("tag.") else None

    def hit(key, patterns):
        return value(key) is not None and any(re.search(p, value(key)) for p in patterns)

    if any(hit(k, p) for k, p in exclude.items()):
        return False
    return all(hit(k, p) for k, p in include.items())


RULES = st.dictionaries(
    st.sampled_from(["identifier", "engine", "tag.Team", "tag.Env", "tag", "other"]),
    st.lists(st.sampled_from(["a", "^b", "c.?", "^$", "x|y"]), max_size=3), max_size=3,
)
WORD = st.sampled_from(["a", "b", "cab", "xyz", ""])


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(WORD, WORD, st.dictionaries(st.sampled_from(["Team", "Env"]), WORD)), min_size=1, max_size=6), RULES, RULES)
def test_pattern_filter_against_plain_python(spark, rows, include, exclude):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, identifier string, engine string, tags map<string,string>")
    fields = {"identifier": F.col("identifier"), "engine": F.col("engine")}
    column = rules.pattern_filter(fields, F.col("tags"), include, exclude)
    got = [r.k for r in frame.select("i", column.alias("k")).orderBy("i").collect()]
    assert got == [keeps({"identifier": a, "engine": b}, t, include, exclude) for a, b, t in rows]


def test_identifier_list(column, spark):
    assert clean_identifiers([" a ", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        clean_identifiers(list("abcdef"))
    frame = spark.createDataFrame([("a",), ("b",)], "identifier string")
    assert frame.filter(identifier_in([" a", "zzz"])).count() == 1
    assert frame.filter(identifier_in([])).count() == 0


def test_label_matcher_is_anchored(column):
    assert column(lambda c: label_matches(c, "db-1|db-2"), ["db-1", "db-12", "xdb-2", None]) == [True, False, False, False]


@pytest.mark.parametrize("pattern, yes, no", [
    ("^[[:word:]]+$", ["a_1"], ["a-1", "a\n"]), ("^[[:xdigit:]]+$", ["0aF"], ["g"]), ("^[[:^alpha:]]+$", ["12-"], ["a"]),
    (r"^\Qa$\E$", ["a$"], ["a"]), (r"\Qa.b", ["xa.by"], ["axb"]), ("^[]$]+$", ["]$"], ["x"]), ("^[a&&b]+$", ["a&b"], ["c"]),
    ("^[[a]+$", ["[a"], ["b"]), ("^[^]]$", ["x"], ["]"]), ("(?P<n_1>a)b$", ["ab"], ["ab\n"]), ("(?m)^b$", ["a\nb\nc"], ["ab"]),
    ("(?m:^b$)|z$", ["a\nb\nc", "z"], ["z\n"]), (r"^\pL\p{Greek}$", ["a\u03b1"], ["ab"]), (r"^\s$", ["\t"], ["\x0b"]), ("a{,2}", ["a{,2}"], ["aa"]),
    ("(?i)^ABC$", ["abc"], ["abd"]), (r"^\x41\x{42}\103$", ["ABC"], ["abc"]), ("a.c", ["a\rc"], ["a\nc"]), (r"^[\Qa-\E]+$", ["a-"], ["b"]),
])
def test_patterns_mean_what_they_mean_in_re2(column, pattern, yes, no):
    values = [*yes, *no]
    assert column(lambda c: c.rlike(java_regex(pattern)), values) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("pattern", [
    "(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a*+", "(?>a)", "[[:nope:]]", "[a", "(a", "a)", "a\\", r"\h", "a{1001}", "(?U)a", "a**",
])
def test_what_re2_has_not_is_an_error(pattern):
    with pytest.raises(ValueError):
        java_regex(pattern)


def test_as_many_rules_as_allowed(spark):
    table = [(i, f"^metric{i}x$", i + 1) for i in range(rules.MAX_RULES)]
    names = spark.createDataFrame([("metric0x",), (f"metric{rules.MAX_RULES - 1}x",), ("none",)], "m string")
    assert [r.t for r in names.select(rules.pattern_ttl(F.col("m"), table).alias("t")).collect()] == [1, rules.MAX_RULES, 0]
    kept = rules.pattern_filter({"name": F.col("m")}, None, {"name": [p for _, p, _ in table]})
    assert [r.k for r in names.select(kept.alias("k")).collect()] == [True, True, False]
