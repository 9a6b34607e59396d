"""Corpus pipeline over `documents`: language ID, quality rules, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of `docs`. SQL cannot express the stages; tests compare them with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import stored, table
from stavelake.llm.components import components
from stavelake.llm.language import UNKNOWN, language_model, predict_languages
from stavelake.llm.packing import pack_documents
from stavelake.llm.quality import judge_quality
from stavelake.llm.secrets import redact_secrets, train_secrets
from stavelake.llm.simhash import fingerprints, links
from stavelake.llm.url_filter import bloom_words, may_contain

ORACLE_SQL = None
#: A text of which a smaller share of n-grams is known to its best language is in none of them.
LEAST_SHARE = 0.3


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` with names that no operator makes for all columns but the text, and the columns that undo this."""
    safe = ["text" if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*safe), [F.col(x).alias(c) for x, c in zip(safe, docs.columns)]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language; texts without a letter (null and empty ones too), and texts that no language knows, go.

    Ties go to the first language by name. Rows without a `lang` are judged and teach nothing; without any labelled row
    no language is known and every row goes. Long texts are read whole, repeated rows are judged each, and columns of
    any other name stay as they are. Empty tables give none.
    """
    safe, back = apart(docs)
    out = predict_languages(safe, language_model(docs))
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*back)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the cascade, so no null, empty or blank text.

    Long texts are read whole, repeated rows are judged each, and columns of any other name stay as they are. The order
    of the rules changes cost only, so ties in it don't matter. Empty tables give none.
    """
    safe, back = apart(docs)
    return judge_quality(safe).where("kept").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least doc_id, a row without an id only where no row of it has one.

    Rows get a number of their own when they are stored with their fingerprints, as ids may repeat or be missing; of rows
    with the least id of a group the one with the least fingerprint, text hash and number stays. Null, empty and blank
    texts are copies of each other. Long texts are read whole; columns of any other name stay. Empty tables give none.

    Few rows go, so a Bloom filter of bounded size with the numbers of those lets most texts pass where they are. Only
    its possible hits are held against the exact list, which grows with the corpus and is merge-joined at every size.
    """
    safe, back = apart(docs)
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("fp"), F.xxhash64("text").alias("key"), F.col("row"))
    numbered = safe.withColumn("id", F.col(f"own_{docs.columns.index('doc_id')}")).withColumn("row", F.monotonically_increasing_id())
    marked = stored(fingerprints(numbered, out="fp"), "fingerprinted")
    classes = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    found = stored(components(links(classes.select("fp"))), "components")
    rooted = classes.join(found.hint("merge"), classes.fp == found.node, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    keep = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "keep")
    gone = stored(marked.select("row").join(keep.hint("merge"), "row", "left_anti").withColumn("h", F.xxhash64("row")), "gone")
    may_go = may_contain(spark, bloom_words(gone, gone.count()))
    tested = marked.withColumn("may_go", may_go(F.xxhash64("row")))
    return tested.where("not may_go").unionByName(tested.where("may_go").join(gone.select("row").hint("merge"), "row", "left_anti")).select(*back)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in the text and `n_chars`, where there is one, counted again.

    Null texts stay null, and empty ones empty. Long texts are read whole, repeated rows are masked each, and columns of
    any other name stay as they are. Empty tables give none.
    """
    safe, back = apart(docs)
    out = redact_secrets(safe, train_secrets(docs)).select(*back)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; a null or empty text is one end id. Other columns are dropped."""
    import public_tokenizers as P

    return pack_documents(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", filter_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", remove_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
