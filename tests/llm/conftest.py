import pytest
from pyspark.sql import types as T

#: Column names that the operators use themselves, as extra columns of the documents.
CLASHES = ("_id", "_key", "_drop", "_row", "_h", "_src", "_text", "fp", "component_id", "severity", "taken", "n_lines", "length")
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)]
)


@pytest.fixture(scope="session")
def documents(spark):
    """documents((doc_id, text, source), ...) as a table with clashing extra columns; source may be left out."""

    def make(*rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *("x" for _ in CLASHES)) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
