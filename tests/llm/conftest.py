import pytest

from churnscope.llm.shared import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, slot int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    long_text = "\n".join(f"Line {i} of a very long text. It goes on and on, number {i * i}." for i in range(4000))
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "one", "en", None), (3, "!!! ???", None, "a"),
            (4, long_text, "en", "a"), (5, "α β γ é ü\nzwei Wörter hier", "de", "b"), (5, "the same id again", "en", "b"),
            (6, "twice the same row here", "en", "b"), (6, "twice the same row here", "en", "b"), (None, "no id at all", "en", "c"),
            (7, "twice the same row here", "en", "c"), (8, "a\nb\n\na\n  A ", "en", "c")]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "clash", 3) for i, t, l, s in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, "/root/testdata/sf0.001", "documents").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
