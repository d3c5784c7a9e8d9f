"""Rules turned into columns when the plan is built: no rule table is ever joined to the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.metrics import STATISTICS, metric_category
from fleetlens.functions.text import java_regex

Rules = Mapping[str, Sequence[str]]
TAG_PREFIX = "tag."
MAX_RULES = 1_000  # chained conditions of one expression; tested up to here
# Fixed value: characters that make a metric rule a regular expression ("." does not).
REGEX_CHARACTERS = "*+?^${}()|[\\]"


def _any(conditions: Sequence[Column]) -> Column:
    """One of the conditions, as a tree of small depth: a chain of many would be too deep to plan."""
    level = list(conditions) or [F.lit(False)]
    while len(level) > 1:
        level = [reduce(lambda a, b: a | b, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def _rule_field(fields: Mapping[str, Column], tags: Column | None, key: str) -> Column | None:
    if key in fields:
        return fields[key]
    if key.startswith(TAG_PREFIX) and tags is not None:
        return F.try_element_at(tags, F.lit(key.removeprefix(TAG_PREFIX)))
    return None


def _matches(field: Column | None, patterns: Sequence[str]) -> Column:
    if field is None:
        return F.lit(False)
    return F.coalesce(_any([field.rlike(java_regex(p)) for p in patterns]), F.lit(False))


def pattern_filter(
    fields: Mapping[str, Column], tags: Column | None = None,
    include: Rules | None = None, exclude: Rules | None = None,
) -> Column:
    """True for rows to keep.

    One matching exclude rule drops a row. Each field named by the include rules must match one of its
    patterns. Patterns are searched for anywhere; a field or tag that is absent matches nothing.
    """
    dropped = _any([_matches(_rule_field(fields, tags, k), ps) for k, ps in (exclude or {}).items()])
    wanted = [_matches(_rule_field(fields, tags, k), ps) for k, ps in (include or {}).items()]
    return reduce(lambda a, b: a & b, wanted, ~dropped)


def metric_fields(metric: Column, unit: Column) -> dict[str, Column]:
    return {"name": metric, "category": metric_category(metric), "unit": unit}


def _equals_or_matches(text: Column, pattern: str) -> Column:
    same = text == F.lit(pattern)
    if any(char in REGEX_CHARACTERS for char in pattern):
        return same | text.rlike(java_regex(pattern))
    return same


def _explicit_statistic(pattern: str) -> tuple[str, str] | None:
    """Base pattern and statistic of a rule that ends in a statistic.

    The suffix is recognised in any case, but only its lower-case form is taken off the pattern.
    """
    for statistic in STATISTICS:
        if pattern.lower().endswith("." + statistic):
            return pattern.removesuffix("." + statistic), statistic
    return None


def select_statistics(
    metric: Column, default: str = "avg", include: Rules | None = None, exclude: Rules | None = None,
) -> Column:
    """Statistics to request for a metric, the default first; an empty array drops the metric.

    Excluding looks at name and category only. Including never removes: it adds the statistics spelled
    out at the end of name rules whose remaining text equals or matches the metric.
    """
    if default not in STATISTICS:
        raise ValueError(f"unknown statistic: {default}")
    include, exclude = include or {}, exclude or {}
    category = metric_category(metric)
    excluded = _any(
        [_equals_or_matches(metric, p) for p in exclude.get("name", ())]
        + [_equals_or_matches(category, p) for p in exclude.get("category", ())]
    )
    chosen = [F.lit(default)]
    for pattern in include.get("name", ()):
        found = _explicit_statistic(pattern)
        if found and found[0]:
            chosen.append(F.when(_equals_or_matches(metric, found[0]), F.lit(found[1])))
    selected = F.array_distinct(F.array_compact(F.array(*chosen)))
    return F.when(excluded, F.array().cast("array<string>")).otherwise(selected)


TtlRules = Sequence[tuple[int, str, int]]


def pattern_ttl(metric: Column, rules: TtlRules) -> Column:
    """TTL (microseconds) of the first rule, by ordinal, found in the metric name; 0 without one."""
    found = [F.when(metric.rlike(java_regex(p)), F.lit(ttl)) for _, p, ttl in sorted(rules, key=lambda r: r[0])]
    return F.coalesce(*found, F.lit(0)).cast("bigint")


def ttl_rules_from_table(table: DataFrame) -> list[tuple[int, str, int]]:
    """Read a rule table (ordinal, pattern, ttl_us). It is configuration: more than MAX_RULES is an error."""
    rows = table.select("ordinal", "pattern", "ttl_us").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} TTL rules")
    return sorted((r.ordinal, r.pattern, r.ttl_us) for r in rows)


def filter_rules_from_table(table: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Read a rule table (list, field, ordinal, pattern) into include and exclude rules."""
    rows = table.select("list", "field", "ordinal", "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} filter rules")
    include: dict[str, list[str]] = {}
    exclude: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: r.ordinal):
        side = {"include": include, "exclude": exclude}[row.list]
        side.setdefault(row.field, []).append(row.pattern)
    return include, exclude
