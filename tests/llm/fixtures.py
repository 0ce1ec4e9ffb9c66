"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(None, "a null id keeps its row"), (9001, None), (9002, ""), (9003, "   \n\t"), (9004, "one"), (9005, "w " * 30_000), (9006, "Ünï çødé \u00a0 <|endoftext|> 's 12 Σίσυφος\u0301"), (9007, "same same"), (9007, "same same")]


def docs(spark):
    more = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").union(more)


def clashing(df):
    """Extra columns with the names that operators use for their own."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("score", "piece", "part", "digest", "key", "kind", "stack", "id", "component", "held_out", "n", "length") if c not in df.columns])


def empty(df):
    return df.where("false")
