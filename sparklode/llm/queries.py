"""The queries of this subpackage: opN_<name> over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ._common import fold, table
from .oracles import LINE_DEDUP, NGRAM_JOIN, SUBSTRING_DEDUP


#: Weights that the mixing query aims at.
MIX_TARGETS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}


def op1_soft_mixing(spark, sf_dir):
    from .mixing import domains_of, rates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rates(docs, domains_of(table(spark, sf_dir, "labels")), MIX_TARGETS)


def op3_language_id(spark, sf_dir):
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark, sf_dir):
    """The host of a document is its source; the path is its source and language. Rows of fold 0 of 5 are not learned from."""
    from .quality import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    found = quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return found.withColumn("held_out", fold("doc_id", 5) == 0)


def op8_weighted_fingerprints(spark, sf_dir):
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark, sf_dir):
    from .substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    """One row per document: lines before, lines removed, and the digest of the text that is left."""
    from .line_dedup import dedup

    left = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_chroma_fingerprints(spark, sf_dir):
    """Vectors of ``embeddings`` played as recordings; queries are those whose id is divisible by 20, against all."""
    from .media import align, rendered

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return align(rendered(vectors), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op5_chroma_fingerprints": op5_chroma_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op1_soft_mixing": op1_soft_mixing,
    "op8_weighted_fingerprints": op8_weighted_fingerprints,
    "op3_language_id": op3_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
}
#: Of the others, models, packings and signatures can't be put in SQL; tests/llm hold them against brute force or held-out rows.
ORACLES: dict[str, str] = {"op2_line_dedup": LINE_DEDUP, "op4_ngram_jaccard_join": NGRAM_JOIN, "op6_suffix_array_dedup": SUBSTRING_DEDUP}
