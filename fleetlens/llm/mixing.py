"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document first gets its certain whole copies; of what remains, a further copy goes
to the documents of smallest rank, the random odds u / (1 - u) over the inclusion odds p / (1 - p), until the source's
target is met. u is a hash of seed, id and text, so reruns agree. Inclusion odds are those of the source's remaining share,
times the document's own ``odds``: ``sized`` sets these by the length of the text, so long documents are likelier.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a null id is hashed as
the word ``null``; rows of one rank (the same id and text) are taken together or not at all; documents without words
take nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.scratch import Scratch, text_or_empty

MOST_COPIES = 3
CELLS = 1024  # rank intervals a source's documents are summed in
ODDS_BYTES = 2048  # the length at which a document's odds are those of its source


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(seed: int, *identity: Column) -> Column:
    """A number strictly between 0 and 1, the same for the same identity."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(part.cast("string"), F.lit("null")) for part in identity]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle repeated over the sources by code point, null last.

    One row per source comes in; sources, unlike documents, are few enough to be put in order by one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight) with ``target``: shares by weight of all words, none above ``most_copies`` sizes.

    The excess of capped sources goes to the others by weight until none is above. That ends at one level: sources in
    order of cap over weight are capped as long as the level of the rest, (total - caps so far) / weights left, is above.
    """
    cap = F.col("source_size") * F.lit(float(most_copies))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    caps_before, weights_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    leveled = sources.withColumn("cap", cap).withColumn("level", (total - caps_before) / (weights - weights_before))
    capped = F.col("cap") / F.col("weight") <= F.col("level")
    # Once one source is below its cap all after it are: the level stands from there on.
    level = F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("weight") * level)).drop("cap", "level")


def _ranked(docs: DataFrame, sources: DataFrame, seed: int, odds: Column | None) -> DataFrame:
    """``docs`` with the columns of their source and ``rank``: null where no uncertain copy is to be had."""
    plan = F.broadcast(sources) if _few(sources) else sources
    joined = docs.alias("d").join(plan.withColumnRenamed("source", "_source").alias("s"), F.col("d.source").eqNullSafe(F.col("s._source")), "left").drop("_source")
    u = uniform(seed, *[F.col(name) for name in ("doc_id", "text_md5") if name in docs.columns])
    if odds is None:
        odds = F.col("odds") if "odds" in docs.columns else F.lit(1.0)
    wanted = F.col("_rest") / (1 - F.col("_rest")) * odds
    rank = F.when(F.col("_rest") > 0, u / (1 - u) / wanted)
    return joined.withColumn("_rank", rank).withColumn("_cell", F.floor(F.col("_rank") / (1 + F.col("_rank")) * CELLS).cast("int"))


def plan(sizes: DataFrame, sources: DataFrame, scratch: Scratch, seed: int = 17, odds: Column | None = None) -> DataFrame:
    """One row per source: _certain copies, _rest (the chance of one more), and where the ranks are cut.

    ``sizes``: doc_id, source, size and, where documents have them, text_md5 and odds, as ``sized`` gives them; ``sources``:
    source, source_size, target. Ranks are summed in cells first; only the
    one cell of a source in which its target falls is gone through row by row. Rows of one rank are taken together.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = sources.select("source", "source_size", "target", F.floor(ratio).cast("long").alias("_certain"), (ratio - F.floor(ratio)).alias("_rest"))
    ranked = scratch.table(_ranked(sizes, shares, seed, odds).where("_rank is not null").select("source", "size", "_rank", "_cell"), "ranked")
    cells = ranked.groupBy("source", "_cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", F.col("_cell").alias("cell"), "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    room = F.col("_rest") * F.col("source_size")
    a, b = starts.alias("a"), shares.alias("b")
    edges = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).where((F.col("start") <= room) & (F.col("start") + F.col("words") > room))
    # Cells without words may begin where the target falls: the first that passes it is the edge.
    edges = edges.groupBy("a.source").agg(F.min(F.struct("cell", "start", room.alias("room"))).alias("e")).select("source", "e.*")
    c, d = ranked.alias("c"), edges.alias("d")
    inside = c.join(d, F.col("c.source").eqNullSafe(F.col("d.source")) & (F.col("c._cell") == F.col("d.cell"))).select("d.source", "_rank", "size", "cell", "start", "room")
    ranks = inside.groupBy("source", "_rank").agg(F.sum("size").alias("words"), F.min("start").alias("start"), F.min("room").alias("room"))
    upto = Window.partitionBy("source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranks.withColumn("sum", F.col("start") + F.sum("words").over(upto))
    # The rank that crosses the target is taken if that ends nearer to it.
    cut = sums.where(2 * F.col("sum") - F.col("words") <= 2 * F.col("room")).groupBy("source").agg(F.max("_rank").alias("_cut"))
    out = shares.alias("s").join(edges.select("source", "cell").alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    out = out.join(cut.alias("k"), F.col("s.source").eqNullSafe(F.col("k.source")), "left")
    planned = scratch.table(out.select("s.*", F.col("e.cell").alias("_edge"), F.col("k._cut").alias("_cut")), "plan")
    scratch.drop("ranked")
    return planned


def copies(docs: DataFrame, planned: DataFrame, seed: int = 17, odds: Column | None = None) -> DataFrame:
    """``docs`` with ``copies``, source_size and target; documents are not exchanged.

    doc_id, source, text_md5 and odds must be those the plan was made with; other columns are kept.
    """
    rows = _ranked(docs, planned, seed, odds)
    picked = F.col("_rank").isNotNull() & (
        F.col("_edge").isNull() | (F.col("_cell") < F.col("_edge")) | ((F.col("_cell") == F.col("_edge")) & F.coalesce(F.col("_rank") <= F.col("_cut"), F.lit(False)))
    )
    return rows.withColumn("copies", F.coalesce(F.col("_certain"), F.lit(0)) + F.coalesce(picked, F.lit(False)).cast("long")).drop(
        "_certain", "_rest", "_rank", "_cell", "_edge", "_cut"
    )


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    """Whether the sources are few enough to send to every task; beyond that the join shuffles."""
    return sources.limit(most + 1).count() <= most


def drawn(text: Column) -> tuple[Column, Column]:
    """``text_md5`` and ``odds`` of a text."""
    return F.md5(text).alias("text_md5"), (F.greatest(F.octet_length(text), F.lit(1)) / F.lit(float(ODDS_BYTES))).alias("odds")


def sized(docs: DataFrame, text_column: str = "text") -> DataFrame:
    text = text_or_empty(text_column)
    return docs.select("doc_id", "source", word_count(text).alias("size"), *drawn(text))


def plan_by_cycle(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """The plan for documents of (doc_id, source, text) whose sources weigh as the cycle says; and what ``sized`` gives."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.table(sized(docs), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = scratch.table(targets(cyclic_weights(totals, cycle)), "targets")
    return plan(sizes, goals, scratch, seed), sizes


def repeated(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as its copies, with the columns of ``docs``."""
    planned, _ = plan_by_cycle(docs, seed)
    many = copies(docs.select(F.struct("*").alias("_row"), "doc_id", "source", *drawn(text_or_empty())), planned, seed).where("copies > 0")
    once_each = many.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return once_each.select("_row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
