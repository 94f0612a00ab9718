"""A small table of documents with every odd case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, v int, found string, at int, label int"


def _documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéßñAB") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base, long = text(60), text(120), text(6000)
    near = base.split()
    near[50] = "changed"
    out = [None, "", " \t\n", "one", "One", "two words", text(40), base, base, " ".join(near), passage + " " + text(30), text(25) + "\n" + passage, passage]
    out += ["same line here\n" * 6 + text(20), "a b c d e f g h i j " * 12, "x" * 3000, long, long[: len(long) // 2] + " " + text(10), "日本語 текст 👍🏽 " * 10, "e\u0301 ﬁ ½ \u00a0 <|endoftext|> 's 'T"]
    out += ['password = "abcdefgh12" secret: token: abcdefghij AKIAABCDEFGHIJKL', "é token=short Passwd:longenough1 " + "0a" * 20, "key Zx9Qw8Er7Ty6Ui5Op4As3D only here", "key Ab1Cd2Ef3Gh4Ij5Kl6Mn7O shared", "again Ab1Cd2Ef3Gh4Ij5Kl6Mn7O shared", "\u017fecret=abcdefghijk"]
    out += ["###$$$ " * 30, text(200), text(300)]
    return [(k, t, "en" if k % 3 else None, f"s{k % 4}", len(t or ""), "x", 1, "y", 2, 3) for k, t in enumerate(out)]


@pytest.fixture(scope="session")
def doc_rows():
    rows = _documents()
    return [*rows, rows[7], rows[10], (None, rows[7][1], "en", "s1", 5, "x", 1, "y", 2, 3), (5, "an id twice", "en", "s2", 1, "x", 1, "y", 2, 3)]


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)
