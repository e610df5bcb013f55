import pytest

LONG = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu " * 3000).strip()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that a table may hold: nulls, empty and blank
    texts, ties, repeated rows, repeated ids, a very long text, special marks,
    unusual characters, and columns whose names the operators use themselves."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "Hello world, this is a plain text of some words.", "en", "a"),
        (2, "Hello  world,\tthis is a plain\ntext of some words.", "en", "a"),
        (3, None, "en", "b"),
        (4, "", "de", "b"),
        (5, " \n\t ", None, None),
        (6, LONG, "en", "c"),
        (7, LONG + " end", "en", "c"),
        (8, passage + " tail one", "fr", "c"),
        (9, "head " + passage + " tail two", "fr", "c"),
        (10, "<|endoftext|> a<|endoftext|>", "en", None),
        (11, "日本語のテキスト ՘ ʰ\U0001f600 é́  x y\x1cz\x85", "ja", "a"),
        (12, "a" * 5000 + "bc" * 3000 + " " * 3000 + "x", "en", "a"),
        (13, "one two three", "en", "a"),
        (13, "one two three", "en", "a"),
        (14, "ONE two THREE", "en", "d"),
        (15, "x", "en", "d"),
        (15, "y y y", "en", "d"),
        (None, "no id here at all today", "en", "d"),
        (-7, "12345 67890 !!!", "en", "d"),
        (16, "one two three four five six", "en", "d"),
        (17, " ".join(["same"] * 80), "en", "d"),
    ]
    full = [(*r, 1, "k", 2.0, 3, "p", 4, True, 5, 6, 7, 8, 9) for r in rows]
    names = "doc_id long, text string, lang string, source string, size int, h string, weight double, n int, rep string, row int, kept boolean, bucket int, stretch int, pos int, th int, _id int"
    return spark.createDataFrame(full, names).repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
