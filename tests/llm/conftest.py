import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# names that the operators use themselves, as columns of the input
CLASHES = "row key h1 h2 place line lines places n_lines n_dropped fp component_id words item n q token_ids decoded_text host rule lang_pred quality_score toxic_score signature label".split()

LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
ODD_TEXTS = [
    None, "", " \t\n ", "one", "two words", "\n\n\n", "é" * 50, LONG, LONG, "a" * 20_000, "🙂 中文 ÀÉ   x",
    "a line that is long enough to be a key of its own\nshort", "A Line that is long enough to be a KEY of its own \n",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns of every clashing name."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", None, None, None), (3, "other text of the same id", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCUMENT)
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")
