"""The queries of the operators, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_bucket


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs, held_out = documents(spark, sf_dir), F.coalesce(id_bucket(4) == 2, F.lit(False))  # a null id isn't held out
    out = identify(docs, learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .tokens import read, write

    return read(spark, write(documents(spark, sf_dir), tokenizer or default_tokenizer()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, scored

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_bucket(3) != 1)
    out = scored(docs, learn(docs, labels), "doc_id")
    held_out = F.coalesce(id_bucket(3) == 1, F.lit(False))  # a null id isn't held out, and has no label
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4, num=80, den=100)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_members

    return line_members(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(documents(spark, sf_dir), id_bucket(5) == 1)


#: A-Z only, as the contracts lower-case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op6_decontamination": f"""
        with item as (select item_id, {_WORDS} as words from (select distinct item_id, text from benchmark)),
        q as (select item_id, least(5, len(words)) as n, words from item where len(words) > 0),
        qs as (select distinct item_id, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) as shingle from q),
        d as (select doc_id, {_WORDS} as words from documents),
        ds as (select distinct doc_id, l.n, unnest(list_transform(range(1, len(words) - l.n + 2), lambda i: array_to_string(words[i:i + l.n - 1], ' '))) as shingle
               from d, (select distinct n from q) l where len(words) >= l.n),
        size as (select item_id, count(*) as item_shingles from qs group by item_id),
        hit as (select doc_id, qs.item_id, count(*) as found from ds join qs on ds.n = qs.n and ds.shingle = qs.shingle group by 1, 2)
        select doc_id, hit.item_id, cast(item_shingles as integer) as item_shingles, cast(found as integer) as found
        from hit join size on hit.item_id = size.item_id where 100 * found >= 80 * item_shingles
    """,
    "op7_minhash_dedup": f"""
        with recursive w as (select doc_id, {_WORDS} as words from documents),
        s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
              else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as shingle from w),
        n as (select w.doc_id, count(s.shingle) as n_shingles from w left join s on w.doc_id = s.doc_id group by w.doc_id),
        i as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
        link as (select a, b from i join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * both_n >= 80 * (na.n_shingles + nb.n_shingles - both_n)),
        reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, l.b from reach r join link l on r.other = l.a),
        low as (select doc_id, min(other) as component_id from reach group by doc_id)
        select n.doc_id, n.n_shingles, component_id, n.doc_id = component_id as kept from n join low on n.doc_id = low.doc_id
    """,
    "op8_exact_dedup": f"""
        with t as (select doc_id, {_LOWER} as body from documents),
        g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
        from t join g on t.body = g.body
    """,
}

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_token_ids": op4_token_ids,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
}
