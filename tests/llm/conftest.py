import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with other columns whose names clash with results."""

    def run(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' AS kept", "1 AS fingerprint", "'s' AS score", "CAST(NULL AS STRING) AS spans", "0 AS chunk")

    return run
