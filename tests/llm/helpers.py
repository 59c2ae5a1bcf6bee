import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, ids=None, sources=None):
    """documents with the given texts; also usable for an empty list."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def odd_texts():
    """Null, empty, blank, one word, repeated rows, a long text, and code points beyond the BMP."""
    r = random.Random(5)
    long = " ".join(r.choice(("alpha", "beta", "Gamma", "delta.", "été", "x\ny")) + str(r.randrange(50)) for _ in range(6000))
    return [None, "", "   ", "word", "word", "A b\U0001f600 c.\nNext line, here: done", long]


def with_clashes(df, *names):
    """Extra columns with the names that an operator uses for itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})
