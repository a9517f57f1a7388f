import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as a documents-like table with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("chunk", "key", "hash", "match", "fp", "row", "language", "bin", "guest", "component_id", "copies"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
