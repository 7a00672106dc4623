"""A corpus pipeline: documents in, a deduplicated, clean and mixed training set out.

Each stage takes all that its predecessor kept, as a table of documents; the last one adds the
number of copies.  No stage can be expressed in SQL as a whole (a trained classifier, random
rounding), so ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` holds every stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumitide.llm import decontaminate, mil, minhash, pii, pivotal
from lumitide.llm.store import columns, save, small

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this input's documents, doesn't reject.

    A text without words (null, empty, punctuation) is rejected, a very long one is read whole; rows with a null id are
    judged like others and repeated rows alike; where both labels have one value only, nothing but wordless texts is
    rejected; an empty table stays empty; all columns are kept, whatever they are called.
    """
    return mil.kept(docs, mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Of rows that share an id the smallest stays (:func:`lumitide.llm.minhash.keep_one`); rows with a null id, and texts
    without words, which are near to none, stay; texts of any length are compared whole; an empty table stays
    empty; all columns are kept, whatever they are called.
    """
    return minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark.

    Rows with a null id, and null or empty texts, are kept; of rows that share an id all go if one holds an item; texts and items
    of any length are searched whole; with an empty benchmark, or an empty table, the rows are as before; all columns are
    kept, whatever they are called.
    """
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(small(save(found.select("doc_id").distinct())), "doc_id", "left_anti").select(*columns(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and ``n_chars`` to match.

    Null and empty texts, rows with a null id and repeated rows stay as they are or are redacted like others; texts of any length are
    scanned whole; an empty table stays empty; all columns are kept, whatever they are called.
    """
    return pii.clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that get copies under equal shares of all sources, with ``copies``.

    The null source is a source; a null text has length 0; rows that share id and source are copied together; ties are
    drawn by hashes of the ids; an empty table stays empty; all columns are kept, whatever they are called, but for an own ``copies``.
    """
    return pivotal.mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("private", private), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs)
    return docs
