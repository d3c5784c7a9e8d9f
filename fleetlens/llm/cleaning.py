r"""Line-first cleaning with built-in column functions only.

Every ``\n``-split line is judged by itself: symbols, shouting, navigation, repetition, boilerplate and missing sentence
punctuation. Lines that fail are removed; a document that loses too much of its text is rejected.

Defined cases: a null or empty text has no words, all its counts are 0 and it is rejected; lines without a word are
neither judged nor counted as text; a document stands for itself, so nulls in other columns, repeated rows and ties
change nothing; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.scratch import text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
# Sentence ends of Latin and other scripts.
SENTENCE_END = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{0964}]"
# Lines that sites and licences repeat, by how they begin or what they ask for.
BOILERPLATE = (
    r"(?i)(^[\x20\x09]*(all rights reserved|copyright|©|licensed under|released under|this work is licensed)"
    r"|cookie (policy|settings)|accept (all )?cookies|privacy policy|terms of (use|service)|enable javascript"
    r"|subscribe to our|sign up for|click here|share (this|on)|lorem ipsum)"
)
BOILERPLATE_WORDS = 40  # such lines are short
SEPARATOR = r"[\x20\x09][|>»·•/][\x20\x09]"
SYMBOLS_A_WORD = (3, 10)  # a line fails with more symbols than 3 for 10 words
MANY_WORDS = 12
DISTINCT_SHARE = (1, 4)  # of many words a quarter at least must differ
MOST_LOST = (1, 2)  # a document may lose half of its characters


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda word: word != F.lit(""))


def symbols_in(text: Column) -> Column:
    # Most texts have none: a look for the first is cheaper than a copy without them.
    return F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line that has a word fails a rule; cheap rules come first."""
    n_words = F.size(words)
    long = n_words >= MANY_WORDS
    shouting = (n_words > 2) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}")
    endless = long & ~F.endswith(line, F.lit(".")) & ~line.rlike(SENTENCE_END)
    boilerplate = (n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    symbols = symbols_in(line) * SYMBOLS_A_WORD[1] > n_words * SYMBOLS_A_WORD[0]
    navigation = line.rlike(SEPARATOR) & (F.regexp_count(line, F.lit(SEPARATOR)) * 5 > n_words)
    repeated = long & (F.size(F.array_distinct(words)) * DISTINCT_SHARE[1] < n_words * DISTINCT_SHARE[0])
    return shouting | endless | boilerplate | symbols | navigation | repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept")


def _counted(docs: DataFrame, text_column: str) -> DataFrame:
    """(_document, the row as it came; and ``COUNTS``)."""
    text = F.col("_text")
    rows = docs.select(F.struct("*").alias("_document"), text_or_empty(text_column).alias("_text")).withColumn("_words", words_in(text))
    # Hashes of words, then of windows of three words.
    rows = rows.withColumn("_word_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    hashes = F.col("_word_hashes")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 3),
        lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )
    rows = rows.withColumn("_windows", F.when(F.size(hashes) >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_distinct", F.size(F.array_distinct("_windows")))
    # Only texts with a repeated window pay for the sort that finds where.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(
        "_sorted", F.when(F.col("_distinct") < F.size("_windows"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )
    ordered = F.col("_sorted")
    found_twice = F.filter(
        ordered,
        lambda x, j: F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)),
    )
    rows = rows.withColumn("_starts", F.array_sort(F.transform(found_twice, lambda x: x["i"])))
    starts = F.col("_starts")
    covered = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3))))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(A_WORD)))
    judged = F.transform("_lines", lambda line: F.struct(line.alias("line"), words_in(line).alias("words")))
    passed = F.filter(judged, lambda x: ~line_fails(x["line"], x["words"]))
    rows = rows.withColumn("_kept_lines", F.transform(passed, lambda x: x["line"]))
    lines, kept_lines = F.col("_lines"), F.col("_kept_lines")
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": symbols_in(text).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda total, n: total + n).cast("long"),
        "clean_text": F.array_join(kept_lines, "\n"),
        "_kept_chars": F.length(F.array_join(kept_lines, "")),
        "_chars": F.length(F.array_join(lines, "")),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    lost = F.col("_chars") - F.col("_kept_chars")
    kept = ~F.col("base_failed") & (lost * MOST_LOST[1] <= F.col("_chars") * MOST_LOST[0])
    return rows.withColumn("kept", kept).select("_document", *COUNTS)


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text and kept.

    Columns of the input with these names are replaced.
    """
    others = [F.col(f"_document.`{c}`") for c in docs.columns if c.lower() not in COUNTS]
    return _counted(docs, text_column).select(*others, *COUNTS)


def cleaned(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that are kept, with their columns; the text is without the lines that failed.

    The choice is an exploded array of none or one: a filter would be pushed below the counts and repeat them all.
    """
    chosen = F.explode(F.when(F.col("kept"), F.array(F.struct("_document", "clean_text"))))
    rows = _counted(docs, text_column).select(chosen.alias("r")).select("r._document", "r.clean_text")
    return rows.select(*[F.col("clean_text").alias(c) if c == text_column else F.col(f"_document.`{c}`") for c in docs.columns])
