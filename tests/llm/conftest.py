import pytest


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


#: Values of the columns whose names are those of helpers.
CLASHES = ("toxic", "later", 5, "rate", 77, "cut", "row")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties and columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, h string, first int, key string, rank int, at int, gone int, __toxic string, __later string, __gone long, __op5_rate string, __op5_count long, __op2_gone string, __row string"
    word = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n\t ", "one", word, word, word + " tail", "x " * 20_000, "line a b c d e\nline f g h i j\n" * 3, "日本語 😀 é ​"]
    rows = [(i, t, None, None if i % 2 else "s", None, "9", "z", "q", 1, "k", 2, 3, 4, *CLASHES) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, word, "en", "s", 1, None, None, None, None, None, None, None, None, *CLASHES)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
