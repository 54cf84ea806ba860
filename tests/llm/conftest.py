import pytest

EDGE_TEXTS = [None, "", " ", "\n\t ", "one", "one two three", "a b c d e", "A B C D E", "x" * 500, "word " * 3000, "é" * 300, "日本語 テキスト " * 20, "\0 \x1c <|endoftext|>   z", "  lead and  trail \n"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "src0", i, "own") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[9], rows[4], (None, "one two three", None, None, None, None), (None, None, None, None, None, None), (4, "another text of that id", "fr", "src1", 3, "x")]
    rows += [(100, "word " * 3000, "en", "src0", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gid string").cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
