"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

import pytest

PROSE = "the river runs past old stone houses and under seven bridges before it meets the sea near a quiet harbour town".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randrange(40)) for _ in range(n)) + "."


CLASHING = "score double, predicted int, kept boolean, copies string, _row int, _n int, n_words string, size string, rank int, digest string, shard string, ids string, tail string"


def nasty_rows():
    long_text = "\n".join(prose(i, 30) for i in range(1500))  # a few hundred kilobytes
    texts = [
        (1, prose(1, 80)), (2, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 120)), (4, prose(2, 118) + " the end."), (5, None), (6, ""), (7, " \n\t\n "),
        (8, "one two"), (9, "ONE two"), (None, prose(3, 90)), (None, None), (10, long_text), (11, "Ünïcode Ωmega  text 漢字 emoji 🙂 " * 30),
        (12, "\n".join(["Same line again, and again."] * 60)), (13, "WORD!! " * 70), (14, "x | y | z | " * 40), (15, prose(4, 60)), (15, prose(5, 60)),
    ]
    rows = []
    for k, (doc_id, text) in enumerate(texts):
        source = (None, "a", "b", "é")[k % 4]
        rows.append((doc_id, text, "en" if k % 3 else None, source, len(text) if text and k % 2 else None, 0.1, 1, True, "c", k, 7, "w", "s", None, "d", "h", "i", "t"))
    return rows


SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def shuffle_files(spark):
    """Run a function: the shuffle files that it leaves on disk, and what it returns."""
    import time

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    def run(function):
        before, made, until = files(), function(), time.time() + 10
        while files() - before and time.time() < until:  # files are removed in the background
            time.sleep(0.2)
        return files() - before, made

    return run
