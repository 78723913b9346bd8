import itertools

import pytest

LONG = "lange Wörter und mehr " * 6000
TEXTS = [
    None, "", "   \n\t ", "One two", "one  TWO", "short line.\nshort line.\nanother one\n\nshort line.",
    "mail a.b@c.org or x@y, ip 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111, +1 (456) 555-2186 \U0001f600 b@d.e",
    LONG, "x" * 5000, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i}" for i in range(1, 60)), " ".join(f"w{i}" for i in range(61)), "### *** $$$ | | <b> & % ### *** $$$ | | <b> & %",
]


@pytest.fixture(scope="session")
def store(spark, tmp_path_factory):
    """Writes rows as a Parquet table in several files and reads it back."""
    number = itertools.count()

    def write(rows, schema, parts=3):
        path = str(tmp_path_factory.mktemp("t") / str(next(number)))
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def odd(store):
    """Nulls, empty and long texts, copies, a repeated row, and columns named like the operators' own."""
    rows = [(i, t, "en", f"src{i % 2}", len(t or ""), i, "k", i * 2, "s") for i, t in enumerate(TEXTS)]
    rows += [(None, "text without an id and ten words in it to stay here", None, None, None, None, None, None, None), rows[9]]
    return store(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key string, n_words long, spans string")


@pytest.fixture(scope="session")
def nothing(store):
    return store([], "doc_id long, text string, lang string, source string, n_chars long")
