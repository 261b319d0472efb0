"""Inputs for these tests."""

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
