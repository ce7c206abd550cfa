import pytest
from pyspark.sql import functions as F

from promptlens.sources import sinks


def test_latex_table_is_whole_or_an_error(spark):
    counts = lambda n: spark.range(n).select(F.col("id").cast("string").alias("d"), F.lit(2).alias("n"))
    assert "Totale & 2\\,000 " in sinks.latex_table(counts(1000), "d", "n", "T")
    with pytest.raises(ValueError):
        sinks.latex_table(counts(1001), "d", "n", "T")
