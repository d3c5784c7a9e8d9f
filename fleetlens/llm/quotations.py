r"""Linking quoting messages to the messages they quote, with built-in column functions only.

A message's lines carry nested quote marks (``>``, ``> >``, ``>>``). Runs of lines of one level are passages. Passages are
normalised (marks, white space and case) and hashed; hashes of quoted passages are joined to hashes of what messages
themselves wrote, whole or by line, within one scope (a mailbox, a list, a conversation). The message quoted most at the
lowest level, counted in characters, is the parent; ties go to the latest earlier one. Parents make trees; each tree is a
conversation in reply order, parents before replies, with the quotes and their announcements taken out.

Defined cases: a null or empty text has no passages, writes nothing and can be nobody's parent; quotes that match
nothing leave the message the root of a conversation; if several messages of a scope wrote the same, the earliest counts,
never one of the same or a later position; null scopes are one scope; a null position comes first; different texts of
one (scope, position) are messages of their own, told apart and ordered by the md5 of the text (``copy``); rows with the
same scope, position and text are one message, ``n_rows`` counts them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.scratch import Scratch, text_or_empty

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
# The line that announces a quotation, in the languages mail programs use most.
ANNOUNCEMENT = r"(?i)^\s*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió|-{2,}\s*original message\s*-{2,})\s*:?\s*$"
CELL_BITS = 8  # replies of one depth are numbered in cells of 2**8 positions, depths in blocks of 2**8
LOWEST = -(2**63)  # the position of messages without one


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D>]+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``own`` (the text without quotes and announcements), ``own_parts`` and ``quoted``.

    own_parts: hashes of the whole own text and of its lines; quoted: hash, level and length of quoted passages and lines.
    """
    lines = F.split(F.col("_text"), "\r?\n")
    leveled = F.transform(
        lines,
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("line"),
        ),
    )
    rows = messages.withColumn("_text", text_or_empty("text")).withColumn("_lines", leveled)
    all_lines = F.col("_lines")
    # An announcement is an own line right before a quoted one.
    own = F.filter(
        all_lines,
        lambda x, i: (x["level"] == 0) & ~(F.coalesce(F.get(all_lines, i + 1)["level"] > 0, F.lit(False)) & x["line"].rlike(ANNOUNCEMENT)),
    )
    rows = rows.withColumn("own", F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", ""))
    # Passages begin where the level changes.
    numbers = F.sequence(F.lit(0), F.size(all_lines) - 1)
    begins = F.filter(numbers, lambda i: ~F.coalesce(F.get(all_lines, i - 1)["level"] == F.get(all_lines, i)["level"], F.lit(False)))
    has_quote = F.exists(all_lines, lambda x: x["level"] > 0)
    rows = rows.withColumn("_begins", F.when(has_quote, begins).otherwise(F.array().cast("array<int>")))
    starts = F.col("_begins")
    runs = F.transform(
        starts,
        lambda at, j: F.struct(
            F.get(all_lines, at)["level"].alias("level"),
            F.array_join(F.transform(F.slice(all_lines, at + 1, F.coalesce(F.get(starts, j + 1), F.size(all_lines)) - at), lambda x: x["line"]), " ").alias("line"),
        ),
    )
    return rows.withColumn("_runs", F.filter(runs, lambda run: run["level"] > 0))


def passages(rows: DataFrame) -> DataFrame:
    """(scope, at, level, hash, chars) of quoted passages and of their single lines."""
    quoted = F.concat(F.col("_runs"), F.filter("_lines", lambda x: x["level"] > 0))
    flat = rows.select("scope", "at", F.explode(F.when(F.size("_runs") > 0, quoted)).alias("q"))
    found = flat.select("scope", "at", F.col("q.level").alias("level"), normalised(F.col("q.line")).alias("said"))
    return found.where("said <> ''").groupBy("scope", "at", "level", F.md5("said").alias("hash")).agg(F.max(F.length("said")).alias("chars"))


def written(rows: DataFrame) -> DataFrame:
    """(scope, hash, origin): the earliest message of a scope that wrote a passage, whole or as a line."""
    parts = F.array_distinct(F.concat(F.array("own"), F.split("own", "\n")))
    said = rows.select("scope", "at", F.explode(parts).alias("part")).select("scope", "at", normalised(F.col("part")).alias("said"))
    return said.where("said <> ''").groupBy("scope", F.md5("said").alias("hash")).agg(F.min("at").alias("origin"))


def parents(rows: DataFrame) -> DataFrame:
    """(scope, at, parent): for messages with a match, the one they answer."""
    q, w = passages(rows).alias("q"), written(rows).alias("w")
    earlier = F.col("w.origin.position") < F.col("q.at.position")
    met = q.join(w, F.col("q.scope").eqNullSafe(F.col("w.scope")) & (F.col("q.hash") == F.col("w.hash")) & earlier)
    votes = met.groupBy("q.scope", "q.at", F.col("w.origin").alias("parent")).agg(F.min("q.level").alias("level"), F.sum("q.chars").alias("chars"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "chars", "parent"))
    return votes.groupBy("scope", "at").agg(best.alias("best")).select("scope", "at", F.col("best.parent").alias("parent"))


def roots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(scope, at, root, depth) from (scope, at, parent), by doubling the pointers that are still open.

    A chain of n replies takes log2(n) rounds; a message whose pointer has reached a root takes no further part. A
    parent is earlier than its replies, so there are no circles.
    """
    has_parent = F.col("parent").isNotNull()
    first = rows.select("scope", "at", F.coalesce("parent", "at").alias("root"), has_parent.cast("long").alias("depth"), has_parent.alias("open"))
    state, step = scratch.table(first, "roots-0"), 0
    while not state.where("open").isEmpty():
        a, b = state.where("open").alias("a"), state.alias("b")
        same = F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.root") == F.col("b.at"))
        onward = a.join(b, same).select("a.scope", "a.at", "b.root", (F.col("a.depth") + F.col("b.depth")).alias("depth"), "b.open")
        step += 1
        state = scratch.table(state.where("NOT open").unionByName(onward), f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
    return state.drop("open")


def _matching(a: str, b: str, *names: str) -> Column:
    same = F.col(f"{a}.scope").eqNullSafe(F.col(f"{b}.scope"))
    for name in names:
        same = same & (F.col(f"{a}.{name}") == F.col(f"{b}.{name}"))
    return same


def _places(full: DataFrame) -> DataFrame:
    """``full`` with ``place``: the number in the conversation by depth, then position.

    Blocks of depths are counted first, then cells in a block, then rows in a cell, so neither a long chain nor a message
    with many answers is put in order as a whole.
    """
    cells = full.groupBy("scope", "root", "block", "depth", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = cells.groupBy("scope", "root", "block").agg(F.sum("n").alias("n"))
    earlier_blocks = Window.partitionBy("scope", "root").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(earlier_blocks), F.lit(0))).alias("b")
    earlier_cells = Window.partitionBy("scope", "root", "block").orderBy("depth", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(earlier_cells), F.lit(0))).alias("c")
    starts = cells.join(blocks, _matching("c", "b", "root", "block")).select(
        "c.scope", "c.root", "c.depth", "c.cell", (F.col("c.start") + F.col("b.base")).alias("start")
    ).alias("s")
    within = Window.partitionBy("scope", "root", "depth", "cell").orderBy("at")
    ranked = full.withColumn("row", F.row_number().over(within) - 1).alias("r")
    return ranked.join(starts, _matching("r", "s", "root", "depth", "cell")).select("r.*", (F.col("s.start") + F.col("r.row")).cast("long").alias("place"))


def conversations(messages: DataFrame, scope: str | None, position: str, text: str = "text") -> DataFrame:
    """Per message: scope, position, copy, n_rows, parent and parent_copy, root and root_copy, depth, place and own text.

    ``place`` is its number in the conversation, from 0; a position that is null stays null.
    """
    scratch = Scratch(messages.sparkSession, "quotations")
    named = messages.select(
        (F.lit(None).cast("string") if scope is None else F.col(scope)).alias("scope"),
        F.coalesce(F.col(position).cast("long"), F.lit(LOWEST)).alias("position"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    single = named.groupBy("scope", "position", F.md5("text").alias("copy")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n_rows"))
    keyed = single.select("scope", F.struct("position", "copy").alias("at"), "text", "n_rows")
    rows = scratch.table(parsed(keyed).select("scope", "at", "n_rows", "own", "_runs", "_lines"), "parsed")
    answers = parents(rows).alias("p")
    linked = rows.alias("r").join(answers, _matching("r", "p", "at"), "left")
    linked = scratch.table(linked.select("r.scope", "r.at", "r.n_rows", "p.parent", "r.own"), "linked")
    found = roots(linked.select("scope", "at", "parent"), scratch).alias("f")
    full = linked.alias("l").join(found, _matching("l", "f", "at"))
    full = full.select(
        "l.scope", "l.at", "l.n_rows", "l.parent", "f.root", "f.depth", F.col("l.own").alias("text"),
        F.shiftright("l.at.position", CELL_BITS).alias("cell"), F.shiftright("f.depth", CELL_BITS).alias("block"),
    )
    full = scratch.table(full, "full")
    scratch.drop("parsed", "linked")

    def shown(column: str) -> Column:
        return F.when(F.col(f"{column}.position") != LOWEST, F.col(f"{column}.position"))

    return _places(full).select(
        "scope", shown("at").alias("position"), "at.copy", "n_rows", shown("parent").alias("parent"), F.col("parent.copy").alias("parent_copy"),
        shown("root").alias("root"), F.col("root.copy").alias("root_copy"), "depth", "place", "text",
    )


def as_mail(turns: DataFrame) -> DataFrame:
    """Turns of conversations as mails: each quotes the turn before it, and that one's quote of the turn before, in full.

    (conv_id, turn, text), for tables whose turns do not quote. Every row gives a mail; of several texts of one
    (conv_id, turn) the smallest is quoted; turns without a number quote nothing and are not quoted.
    """
    rows = turns.select("conv_id", "turn", text_or_empty().alias("text"))
    single = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def before(frame: DataFrame, steps: int, name: str) -> DataFrame:
        earlier = single.select(F.col("conv_id").alias("c"), (F.col("turn") + steps).alias("t"), F.col("text").alias(name))
        return frame.join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")

    rows = before(before(rows, 1, "last"), 2, "last_but_one")

    def quote(column: Column, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(column, "\n", "\n" + mark))

    nested = F.when(F.col("last_but_one").isNotNull(), F.concat(quote(F.col("last_but_one"), ">> "), F.lit("\n"))).otherwise(F.lit(""))
    quoted = F.concat(F.lit("On Monday the sender wrote:\n"), nested, quote(F.col("last"), "> "), F.lit("\n\n"))
    return rows.select("conv_id", "turn", F.concat(F.when(F.col("last").isNotNull(), quoted).otherwise(F.lit("")), "text").alias("text"))
