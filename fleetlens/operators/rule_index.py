"""Rules as data: the first of many thousands of ordered patterns that is found in a name.

Rules of one pattern are one rule, the first of them. Every pattern is searched for pieces of text that each match must contain.
Of each distinct name only the stretches count that begin as a piece does and are as long (a table of fixed size tells these); a rule
with a piece that no name has cannot match and goes; the others meet the names at the whole piece that fewest names
have, an equi-join. Only what meets is tested by the regular expression. Rules without such a
piece (``.*``, ``[a-z]+``, alternatives) are tested against every distinct name. The names with their rule, one row each,
join the data at the end, so the data is read once for its names and once for the result, however many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.text import java_regex
from fleetlens.session import ship_library

PIECE = 32  # characters of a piece that are compared; a longer one is cut into several
LEAD = 4  # first characters of a piece by which a name's stretches are picked
SLOTS = 65_536  # rows of the table of leads, at most; decides cost only
START = "^"  # in front of a piece that a name must begin with; stands for itself elsewhere, which only adds candidates
_REPEAT = re.compile(r"\{(\d+)(?:,\d*)?\}")
_PLAIN_ESCAPES = frozenset("dDwWsSbBAzntfrva")


def _end_of_class(pattern: str, at: int) -> int:
    """Behind the bracket that closes the class opened at ``at``, or -1."""
    at += 2 if pattern.startswith("[^", at) else 1
    first = True
    while at < len(pattern):
        if pattern[at] == "]" and not first:
            return at + 1
        if pattern.startswith("[:", at):
            close = pattern.find(":]", at)
            if close < 0:
                return -1
            at = close + 2
        else:
            at += 2 if pattern[at] == "\\" else 1
        first = False
    return -1


def _end_of_group(pattern: str, at: int) -> int:
    depth = 0
    while at < len(pattern):
        char = pattern[at]
        if char == "[":
            at = _end_of_class(pattern, at)
            if at < 0:
                return -1
            continue
        depth += (char == "(") - (char == ")")
        at += 2 if char == "\\" else 1
        if depth == 0:
            return at
    return -1


def required_pieces(pattern: str) -> tuple[list[str], bool]:
    """Pieces of text that every match contains, and whether the first is at the name's start. In doubt there are none."""
    none: tuple[list[str], bool] = ([], False)
    if re.search(r"\(\?[a-zA-Z]*[imU]", pattern):
        return none
    pieces, run, at, anchored, first = [], "", 0, pattern.startswith("^"), None

    def close(piece: str) -> None:
        if piece:
            pieces.append(piece)

    at = 1 if anchored else 0
    while at < len(pattern):
        char = pattern[at]
        if char == "|":
            return none
        if char in "*?+{":
            repeat = _REPEAT.match(pattern, at) if char == "{" else None
            if char == "{" and repeat is None:
                return none
            optional = char in "*?" or (repeat is not None and int(repeat[1]) == 0)
            close(run[:-1] if optional else run)
            first = len(pieces) > 0 if first is None else first
            run, at = "", repeat.end() if repeat else at + 1
            at += pattern.startswith("?", at)
            continue
        if char in "([.^$" or (char == "\\" and pattern[at + 1 : at + 2].isalnum()):
            close(run)
            first = len(pieces) > 0 if first is None else first
            run = ""
            if char == "\\" and pattern[at + 1] not in _PLAIN_ESCAPES:
                return none
            at = {"(": _end_of_group, "[": _end_of_class}.get(char, lambda p, i: i + 2 if char == "\\" else i + 1)(pattern, at)
            if at < 0:
                return none
            # What was in the group may repeat or be absent: nothing of it counts.
            continue
        if char == "\\":
            at += 1
            if at == len(pattern):
                return none
        run += pattern[at]
        at += 1
    close(run)
    first = len(pieces) > 0 if first is None else first
    return pieces, anchored and first


def _cut(piece: str) -> list[str]:
    """A piece in parts of ``PIECE`` characters, the last of which overlaps the one before."""
    return [piece[i : i + PIECE] for i in range(0, len(piece) - PIECE + 1, PIECE)] + [piece[-PIECE:]]


def _prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [required_pieces(p) for p in batch["pattern"]]
        keys = [sorted({k for i, piece in enumerate(pieces) for k in _cut((START if anchored and i == 0 else "") + piece)}) for pieces, anchored in found]
        yield pd.DataFrame({**{c: batch[c] for c in ("ordinal", "ttl_us", "pattern")}, "regex": [java_regex(p) for p in batch["pattern"]], "pieces": keys})


def first_of_pattern(rules: DataFrame) -> DataFrame:
    """Of the rules with one pattern the smallest ordinal and its smallest TTL: no other of them can be the first match."""
    whole = rules.where("pattern is not null and ordinal is not null").select("ordinal", "pattern", F.coalesce("ttl_us", F.lit(0)).alias("ttl_us"))
    one_each = whole.groupBy("pattern", "ordinal").agg(F.min("ttl_us").alias("ttl_us"))
    return one_each.groupBy("pattern").agg(F.min_by("ttl_us", "ordinal").alias("ttl_us"), F.min("ordinal").alias("ordinal")).select("ordinal", "pattern", "ttl_us")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(ordinal, ttl_us, pattern) with the regular expression for Spark and the pieces a match must have, one row a pattern."""
    ship_library(rules.sparkSession)
    kind = rules.schema["ordinal"].dataType.simpleString()
    return first_of_pattern(rules).mapInPandas(_prepared, f"ordinal {kind}, ttl_us long, pattern string, regex string, pieces array<string>")


def _slot(lead: Column) -> Column:
    return F.pmod(F.xxhash64(lead), F.lit(SLOTS))


def name_pieces(distinct: DataFrame, pieces: DataFrame) -> DataFrame:
    """(name, piece): the stretches of the distinct names that may be one of ``pieces``: begin like one and are as long."""
    size = F.length("piece")
    leads = pieces.select(_slot(F.left("piece", F.lit(LEAD))).alias("slot"), size.alias("size")).groupBy("slot").agg(F.collect_set("size").alias("sizes"))
    text, n = F.concat(F.lit(START), "name"), F.length("name") + 1
    at = distinct.select("name", text.alias("text"), F.explode(F.sequence(F.lit(1), n)).alias("at"))
    begun = at.select("*", F.explode(F.array(*[F.lit(k) for k in range(1, LEAD + 1)])).alias("lead")).where(F.col("at") + F.col("lead") <= F.length("text") + 1)
    held = begun.withColumn("slot", _slot(F.substring("text", F.col("at"), F.col("lead")))).join(F.broadcast(leads), "slot")
    longer = F.filter("sizes", lambda k: ((k == F.col("lead")) | ((F.col("lead") == LEAD) & (k > LEAD))) & (F.col("at") + k <= F.length("text") + 1))
    return held.select("name", "text", "at", F.explode(longer).alias("size")).select("name", F.substring("text", F.col("at"), F.col("size")).alias("piece"))


def first_matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, ordinal, ttl_us): for each distinct name of one column the matching rule with the smallest ordinal.

    Of rules with one ordinal the smaller TTL counts. Names without a match, and null names, have no row.
    """
    name = F.col("name")
    distinct = names.toDF("name").where("name is not null").distinct()
    ready = prepared_rules(rules)
    wanted = ready.where(F.size("pieces") > 0).select("ordinal", "ttl_us", "pattern", "regex", F.size("pieces").alias("needed"), F.explode("pieces").alias("piece"))
    common = name_pieces(distinct, wanted).groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    rare = (
        wanted.join(common, "piece").groupBy("ordinal", "ttl_us", "pattern", "regex")
        .agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed"), F.min(F.struct("names", "piece")).alias("key"))
        .where("met = needed").select("ordinal", "ttl_us", "regex", F.col("key.piece").alias("piece"))
    )
    met = rare.join(name_pieces(distinct, rare), "piece").where(F.rlike(name, F.col("regex"))).select("name", F.struct("ordinal", "ttl_us").alias("rule"))
    # Rules that name nothing: one row with all of them in order.
    rest = ready.where(F.size("pieces") == 0).agg(F.sort_array(F.collect_list(F.struct("ordinal", "ttl_us", "regex"))).alias("rules")).withColumn("one", F.lit(1))
    tested = distinct.withColumn("one", F.lit(1)).join(rest, "one").select("name", F.try_element_at(F.filter("rules", lambda r: F.rlike(name, r["regex"])), F.lit(1)).alias("rule"))
    plain = tested.where("rule is not null").select("name", F.struct(F.col("rule.ordinal").alias("ordinal"), F.col("rule.ttl_us").alias("ttl_us")).alias("rule"))
    return met.unionByName(plain).groupBy("name").agg(F.min("rule").alias("rule")).select("name", "rule.ordinal", "rule.ttl_us")


def indexed_ttl(rows: DataFrame, rules: DataFrame, metric: str = "metric") -> DataFrame:
    """``rows`` with ``pattern_ttl_us`` of the first rule found in the metric name; 0 without one."""
    found = first_matches(rows.select(metric), rules).select(F.col("name").alias("_name"), F.col("ttl_us").alias("_ttl_us"))
    joined = rows.join(found, F.col(metric) == F.col("_name"), "left")
    return joined.withColumn("pattern_ttl_us", F.coalesce("_ttl_us", F.lit(0).cast("bigint"))).drop("_name", "_ttl_us")
