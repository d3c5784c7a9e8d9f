"""Labels: tag maps, dimension lookups, truncation, label sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from fleetlens.functions.engines import engine_short_name

# Supported dimension groups, the dimension each label is read from, the name suffix.
SQL_GROUP = "db.sql_tokenized"
WAIT_GROUP = "db.wait_event"
DIMENSION_LABELS = {
    SQL_GROUP: {"digest": "db.sql_tokenized.id", "statement": "db.sql_tokenized.statement"},
    WAIT_GROUP: {"wait_event": "db.wait_event.name", "wait_type": "db.wait_event.type"},
}
DIMENSION_SUFFIX = {SQL_GROUP: "top_sql_load_avg", WAIT_GROUP: "wait_event_load_avg"}
DIMENSION_HELP = "Top database load by "
LABEL_LIMIT = 200


def tag_map(tags: Column) -> Column:
    """List of ``{Key, Value}`` to a map: incomplete tags are skipped, the last duplicate wins."""
    kept = F.filter(tags, lambda t: t["Key"].isNotNull() & t["Value"].isNotNull())
    keys = F.transform(kept, lambda t: t["Key"])
    distinct = F.array_distinct(keys)
    last = F.transform(
        distinct, lambda k: F.element_at(F.filter(kept, lambda t: t["Key"] == k), -1)["Value"]
    )
    return F.coalesce(F.map_from_arrays(distinct, last), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))


def dimension_value(dims: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(dims, F.lit(key)), F.lit(""))


def dimension_sample_name(prefix: str, engine: Column, group: Column) -> Column:
    """Published name of a dimension sample; null for a group that is not supported."""
    suffix = F.lit(None).cast("string")
    for name, text in DIMENSION_SUFFIX.items():
        suffix = F.when(group == name, F.lit(text)).otherwise(suffix)
    return F.concat(F.lit(prefix + "_"), engine_short_name(engine), F.lit("_"), suffix)


def truncate_label(text: Column, limit: int = LABEL_LIMIT, by_bytes: bool = False) -> Column:
    """Cut to ``limit`` characters (or UTF-8 bytes, never inside a character) and mark the cut."""
    if not by_bytes:
        return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
    raw = F.encode(text, "UTF-8")

    def continues(position: int) -> Column:  # is this byte (1-based) inside a character?
        byte = F.hex(F.substring(raw, position, 1))
        return (byte >= "80") & (byte < "C0")

    cut = F.lit(limit - 3)
    for back in (2, 1, 0):
        cut = F.when(~continues(limit + 1 - back), F.lit(limit - back)).otherwise(cut)
    head = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def label_map(names: Sequence[str]) -> Column:
    """Label set of a sample as a map, from its label columns; absent (null) labels are left out."""
    full = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return F.map_filter(full, lambda _, value: value.isNotNull())
