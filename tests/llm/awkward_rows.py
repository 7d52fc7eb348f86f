"""Fixtures of the operator tests: a table of awkward rows, and small helpers."""
import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all", "b"),
    (3, None, "a"), (4, "", None), (5, "   \n\t ", "b"), (None, "no id here at all", "a"),
    (6, LONG, "c"), (7, LONG, "c"), (8, "one", "a"), (8, "one", "a"), (9, "two words", None),
    (10, "Ünïcödé wörds ÀÉ \U0001f600 here 漢字 too", "d"), (11, "the quick brown fox", "a"),
] + [(100 + i, "copied text of a hot group that holds a third of the rows", "hot") for i in range(40)] + [
    (200 + i, f"row {i} says something of its own number {i * i} and little else {i % 7}", f"s{i % 5}") for i in range(70)]

SCHEMA = ("doc_id bigint, text string, source string, id string, row int, size double, spans string, h string, "
          "`a.b` string, __copy int, __row int, __gone int, c0 string, doc string")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a hot group
    and extra columns whose names the operators use themselves."""
    rows = [(i, t, s, "x", None, 0.5, None, "h", "dot", 1, 2, 3, "c", "d") for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
