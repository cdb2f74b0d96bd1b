import itertools

import pytest

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "Licensed under CC BY-NC 4.0. All Rights Reserved. cc by cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "the quick brown fox jumps over the lazy dog " * 8,
    "the quick brown fox jumps over the lazy dog " * 8,
    "naïve café — 日本語 😀   x y",
    "line one\nline one\n\n# * | <b>\nline two\nline one",
    "Released under the MIT License. " + " ".join(f"w{i}" for i in range(400)),
    " ".join(f"w{i}" for i in range(30, 90)) + " tail",
    "word " * 30_000,
]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, ties, repeated rows, long and empty texts, and columns with clashing names."""
    ids = [None, 5, 5, 7, *range(10, 10 + len(TEXTS) - 4)]
    sources = itertools.cycle(["src1", None, "src0", "ä"])
    rows = [(i, t, l, s, len(t or ""), "x", 1, "k") for i, t, l, s in zip(ids, TEXTS, itertools.cycle(["en", None, "fr"]), sources)]
    rows.append(rows[4])  # a row twice
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, rid int, keep string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing") / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)
