import random

import pytest

WORDS = "amber birch cedar delta ember frost grove haven islet jetty knoll larch mossy north ocean".split()


def prose(seed: int, n: int) -> str:
    """``n`` words in sentences and lines, the same for the same seed."""
    r = random.Random(seed)
    words = ["".join(r.choices(WORDS, k=2)) if r.random() < 0.5 else r.choice(WORDS) for _ in range(n)]
    return "".join(w + ("\n" if i % 17 == 16 else ". " if i % 7 == 6 else " ") for i, w in enumerate(words)).strip()


# Columns that operators use themselves, on every row.
CLASHES = "kept long, shard string, fp long, rank long, line string, n_words string, score string, slot long, item_id long, __text long"
CLASHES += ", vid long, __spans string, __row string, __c1 string, __left long"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, blanks, ties, copies, repeats and a very long text."""
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "!!! ... 123", "fr", "b", 11),
        (5, prose(5, 200), "en", "a", 1), (6, prose(5, 200), "en", "b", 1), (7, prose(5, 200) + " tail", None, None, 1),
        (8, prose(8, 60), None, "c", 1), (8, prose(8, 60), None, "c", 1), (None, prose(9, 70), "en", "a", 1),
        (None, None, None, None, None), (10, prose(10, 40_000), "en", "a", 1), (11, "one two", "xx", "b", 7),
        (12, "É è 日本語 " * 30, "ja", "c", 1), (13, prose(13, 300), "en", "d", 1), (14, prose(13, 300), "en", "e", 1),
    ]
    return rows + [(100 + i, prose(100 + i % 40, 120), "en", f"s{i % 7}", 1) for i in range(80)]


def frame(spark, rows):
    clash = tuple([0, "x", 1, 2, "x", "x", "x", 3, 4, 5, 1000, "x", "y", "z", 6])
    return spark.createDataFrame(
        [(*r, *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    )


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
