"""Database engines: recognised names, short names, families."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Recognised engines and the short names used in emitted metric names.
ENGINE_SHORT_NAMES = {
    "aurora-postgresql": "apg",
    "aurora-mysql": "ams",
    "postgres": "pg",
    "mysql": "mysql",
    "mariadb": "mariadb",
    "oracle": "oracle",
    "sqlserver": "sqlserver",
}
EXACT_ENGINES = ("aurora-postgresql", "aurora-mysql", "postgres", "mysql", "mariadb")
EDITION_ENGINES = ("oracle", "sqlserver")
MYSQL_FAMILY = ("mysql", "aurora-mysql", "mariadb")
POSTGRES_FAMILY = ("postgres", "aurora-postgresql")


def normalize_engine(raw: Column) -> Column:
    """Engine name as used everywhere else; ``""`` when it is not recognised.

    Engines without editions must match exactly; the ones sold in editions are found by substring,
    whatever the case.
    """
    result = F.when(raw.isin(*EXACT_ENGINES), raw)
    for engine in EDITION_ENGINES:
        result = result.when(F.lower(raw).contains(engine), F.lit(engine))
    return result.otherwise(F.lit(""))


def is_valid_engine(engine: Column) -> Column:
    return F.coalesce(engine.isin(*ENGINE_SHORT_NAMES), F.lit(False))


def engine_short_name(engine: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ENGINE_SHORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, engine), F.lit(""))


def statement_family(engine: Column) -> Column:
    """``mysql`` or ``postgres`` for engines with statement statistics, else null."""
    return F.when(engine.isin(*MYSQL_FAMILY), F.lit("mysql")).when(
        engine.isin(*POSTGRES_FAMILY), F.lit("postgres")
    )
