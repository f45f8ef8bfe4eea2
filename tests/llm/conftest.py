import pytest


@pytest.fixture
def written(spark, tmp_path):
    """Write rows as documents and read them as a scan of files, with extra columns of clashing names."""

    def make(rows, schema="doc_id long, text string", files=3, name="documents"):
        df = spark.createDataFrame(rows, schema)
        path = str(tmp_path / f"{name}.parquet")
        df.repartition(files).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make
