import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["hub", "slice", "kind", "part", "before", "place", "chunk", "range", "bits", "bucket", "shard", "slot", "key", "first", "size", "winner", "score", "_lost", "kept", "component", "id", "n", "lo", "hi", "bands", "a", "b"]


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, blanks, ties, case twins, a very long text, odd letters."""
    long = " ".join(f"word{i * 7919 % 3001}" for i in range(30_000))
    return [
        None, "", " \t\n", "one", "One", "ONE", "two words", "a b c d e", "a b c d e f", "Ä ä É", "ä Ä é", long, long, long.upper(),
        "x" * 20_000, "ſ K\u2028line\x1csep\x85next", "it's 12 o'clock \U0001f642\U0001f642 <|endoftext|> end", "password: hunter2hunter2", "=" * 300,
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts with null ids and columns, repeated rows, and extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    docs = documents(spark, odd_texts)
    docs = docs.unionByName(docs.limit(4)).unionByName(docs.where("doc_id in (3, 6, 7)").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    return docs.select("*", *[F.lit(7).alias(c) for c in EXTRA]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
