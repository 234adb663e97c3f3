"""Small tables with the edge cases every operator must define."""

import pandas as pd
import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
CLASH = ["row", "slot", "block", "key", "number", "_part", "n", "root", "score", "digest", "part", "nth", "ids"]


def _rows():
    """(doc_id, text, lang, source): nulls anywhere, empty and long texts, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    return [
        (0, base, "en", "a"),
        (1, base + " now", "en", "a"),
        (2, base, "en", None),
        (3, None, None, "b"),
        (4, "", "en", "b"),
        (5, " \n\t ", "fr", None),
        (6, "one two", None, "a"),
        (7, "One TWO", "en", "a"),
        (8, LONG, "de", "c"),
        (8, LONG, "de", "c"),
        (None, base, "en", "a"),
        (-5, "mail bob@example.com or +1 (555) 123-4567 from 10.0.0.1, password=a8f5f167f44f4964e6", "en", "b"),
        (10, "é\x85\xa0 b  \x1c ###hi### don't <|endoftext|>", "fr", "b"),
        (11, "x" * 5000, "en", "c"),
        (12, "Zürich größer naïve " * 20, "de", "c"),
        (12, "another text under the same id", "de", "c"),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    return [(*r, None if r[1] is None else len(r[1])) for r in _rows()]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    """The edge cases as a written table with further columns whose names the operators use themselves."""
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASH)
    rows = [(*r, *["own"] * len(CLASH)) for r in odd_rows]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    odd_docs.where("false").write.parquet(path)
    return spark.read.schema(odd_docs.schema).parquet(path)


@pytest.fixture(scope="session")
def small_docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
