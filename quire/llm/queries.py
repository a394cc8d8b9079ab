"""Registered queries of the subpackage, by problem, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, consensus, neardup, packing, residue, sentences
from quire.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.agree(table(spark, sf_dir, "flag"), table(spark, sf_dir, "claim_form"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).values.select("item_id", "field_name", "field_value")


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).values


def p1_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators


#: Likeness from which declarations are near-duplicates, as a fraction.
LIKE = neardup.Threshold(7, 10)


def _declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a declaration: those of its statement and its proof; none without ``whole``."""
    decls = table(spark, sf_dir, "clone_decl").filter("whole IS NOT NULL")
    return decls.select(F.col("decl_id").alias("id"), F.concat_ws(" ", "whole.stmt", "whole.proof").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.all_pairs(neardup.similar(_declarations(spark, sf_dir), LIKE))
    return found.select(F.col("id_a").alias("decl_id_a"), F.col("id_b").alias("decl_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(neardup.similar(_declarations(spark, sf_dir), LIKE))
    return found.withColumnRenamed("id", "decl_id")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each sentence. A block id must name one text."""
    texts = table(spark, sf_dir, "block").select("block_id", "text")
    size = (F.col("end_at") - F.col("begin_at")).cast("int")
    found = p5_found(spark, sf_dir).join(texts.hint("merge"), "block_id")  # texts are many times larger than their file
    return found.select("block_id", "begin_at", F.substring("text", (F.col("begin_at") + 1).cast("int"), size).alias("sentence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "block"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.count_corpus(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residual(residue.score(table(spark, sf_dir, "documents")))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.score(table(spark, sf_dir, "documents"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(residue.residual(residue.score(documents)), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_agreement": p1_agreement, "p1_reviewers": p1_reviewers, "p2_found": p2_found, "p2_groups": p2_groups, "p5_found": p5_found, "p5_sentences": p5_sentences, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_scores": p8_scores, "p8_kept": p8_kept}
SQL: dict[str, str] = {
    "p2_found": """WITH c AS (SELECT decl_id, word, count(*) AS n FROM (SELECT decl_id, unnest(string_split(concat_ws(' ', whole.stmt, whole.proof), ' ')) AS word FROM clone_decl WHERE whole IS NOT NULL) WHERE word <> '' GROUP BY 1, 2),
      s AS (SELECT decl_id, sum(n) AS z FROM c GROUP BY 1),
      p AS (SELECT a.decl_id AS a, b.decl_id AS b, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.word = b.word AND a.decl_id < b.decl_id GROUP BY 1, 2)
      SELECT a AS decl_id_a, b AS decl_id_b FROM p JOIN s sa ON sa.decl_id = a JOIN s sb ON sb.decl_id = b WHERE 17 * k >= 7 * (sa.z + sb.z)""",
}
