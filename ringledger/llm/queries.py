"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringledger.llm import bpe, collocations, licenses, packing, pii, quality, shards, simhash, spotsigs, tokencounts, topk, toxicity, variants
from ringledger.llm.rows import documents, table


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_twentieth(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op11_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; see :func:`tokencounts.counted` for nulls, repeats and extra columns."""
    return tokencounts.counted(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases; see :func:`collocations.collocations` for nulls, ties and repeats."""
    return collocations.collocations(documents(spark, sf_dir))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words with their forms and roots; see :func:`variants.grouped` for nulls, ties and repeats."""
    return variants.grouped(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {x.__name__: x for x in (op1_shards, op2_licenses, op3_toxicity, op4_packing, op5_pii, op6_topk, op7_quality, op8_spotsigs, op9_simhash, op10_bpe, op11_tokencounts, op12_collocations, op13_variants)}


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.digest_sql(), "op6_topk": TOPK_SQL, "op12_collocations": collocations.SQL}
