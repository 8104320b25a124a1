import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) rows with columns whose names the operators use inside."""

    def make(rows):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        clash = ["row", "id", "norm", "fp", "salt", "head", "ids", "piece", "key", "label", "n"]
        return d.withColumns({c: F.lit("x") for c in clash})

    return make
