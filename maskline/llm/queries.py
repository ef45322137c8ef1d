"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import sql
from maskline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_kneser_ney_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.quality import quality

    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality(table(spark, sf_dir, "documents"), trusted)


@query("op2_token_group_jaccard", sql.near_documents(3, 90, 100))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.jaccard import near_documents

    near = near_documents(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return near.select("doc_id", "n_shingles", "component_id")


@query("op3_rank_queue_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from maskline.llm.bpe import round_trip

    return round_trip(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query(
    "op4_proportional_interleaving",
    f"""
with {sql.CRC_TABLE},
d as (select doc_id, source, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, cast({sql.crc32("coalesce(text, '')")} as bigint) as text_crc32,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':7'), 1, 15) as bigint) as key from documents, crc),
r as (select *, row_number() over (partition by source order by key, doc_id nulls first, text_crc32, size) as rank, count(*) over (partition by source) as rows_ from d),
p as (select *, row_number() over (order by cast(2 * rank - 1 as double) / cast(2 * rows_ as double), source nulls first, key, doc_id nulls first, text_crc32, size) as place,
  count(*) over () as total from r),
s as (select *, ((place - 1) * 8) // total as shard_ from p)
select doc_id, size, text_crc32, 'rows' as law, cast(shard_ as int) as shard, cast(place - 1 - (shard_ * total + 7) // 8 as bigint) as slot, cast(null as int) as grown_shard from s""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.interleave import interleaved_shards

    return interleaved_shards(table(spark, sf_dir, "documents"))


@query("op5_sum_of_squares_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op6_phrase_automata", sql.repeated_phrases(20))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.phrases import without_repeated_phrases

    return without_repeated_phrases(table(spark, sf_dir, "documents"))


@query("op7_license_alignment")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.licenses import license_spans

    return license_spans(table(spark, sf_dir, "documents"))


@query("op8_metric_range_join", sql.near_vectors(0.95))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.metric import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op9_extendible_hash_dedup",
    r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op10_radix_suffix_dedup", sql.repeated_bytes(400))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.suffixes import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


@query("op11_kronecker_hard_negatives", sql.hard_negatives())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.negatives import hard_negatives

    # Some labels are wrong on purpose, so that a hard negative may be a near copy.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


@query("op12_permuterm_variants", sql.spelling_variants())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), wear=97)


@query("op13_factorization_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
