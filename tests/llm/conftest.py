import pytest

#: What every operator must take: nulls, empty and very long texts, ties and repeated rows, and columns that clash.
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, score double, fp long, key string, size long, labels string"


def rows():
    texts = [None, "", "   \n\t ", "one", "Hello there, you are here.\nA second line of words.", LONG, "x" * 200_000, "éè 中文 \U0001f600 mit license", "### $$$ %%%", "1 2 3 4"]
    every = [(i, t, "en", f"s{i % 2}", 1, 5, 0.5, 7, "k", 3, "l") for i, t in enumerate(texts)]
    return [*every, every[4], (4, "another text under the same id", None, None, None, None, None, None, None, None, None), (None, "no id here", "fr", "s1", 1, 5, 0.5, 7, "k", 3, "l"), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
