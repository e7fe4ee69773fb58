import pytest

from sparkroster.llm.common import ship_package


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship_package(spark)


DOCS = "doc_id long, text string, lang string, n_tokens long, score double, _found string, print long, y int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns named like the operators' own."""
    long_text = "Ein langer Text, etwas. " * 20_000
    rows = [
        (1, None), (2, ""), (3, "   \n"), (4, "Hello, World! don't stop"), (4, "Hello, World! don't stop"), (5, long_text), (6, "x" * 30_000),
        (None, "Hello, World! don't stop"), (None, None), (7, "日本語 テキスト 😀 ▁ a\u0301  b"), (8, "<|endoftext|>a<|endoftext|><s>"),
    ]
    return spark.createDataFrame([(i, t, "en", 1, 0.5, "x", 3, 1) for i, t in rows], DOCS)
