import pytest

SF = "/root/testdata/sf0.001"
CLASH = ["key", "id", "a", "b", "root", "hub", "bucket", "copies", "mass", "row", "rank", "n", "other", "start", "pos", "exact", "sig", "rate", "of", "meta.url", "a`b", "c0_", "exact.sig"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


LONG = " ".join(f"word{k % 7919}" for k in range(150_000))
SHARED = " ".join(f"shared{k}" for k in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, SHARED, "en", "a", 5), (4, SHARED + " tail", "en", "b", 5), (5, "head " + SHARED, None, "b", None), (6, LONG, "en", "a", len(LONG)),
    (7, SHARED, "en", "a", 1), (7, SHARED, "en", "a", 1), (8, "x", "en", None, 1), (8, "y", "en", "a", 1), (9, "mail me at jo@example.org or +1 555 123 4567", "en", "a", 1), (10, "Æ" * 3000 + " \U0001f600 ß ﬁ İ", "tr", "c", 1), (None, None, None, None, None), (2**62, "..,,!!", "en", "a", 6),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if "." not in c and "`" not in c}).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH if "." in c or "`" in c])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
