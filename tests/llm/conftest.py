import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def build(rows, schema=DOCS, partitions=2):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build


#: Null, empty, white space, ties, repeated rows, a null id, long words in several scripts, shared ids.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four"), (5, "ONE two three four"), (5, "ONE two three four"), (None, "one two"), (6, "x" * 5000), (7, "É é"), (8, "é é"), (11, "😀" * 3000), (12, "中文字" * 2000), (13, "0123456789" * 500), (14, "qz" * 2000)]
