"""The registered queries of the numbered operators: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import ann, bpe, conversation, hnsw, langid, lm_scoring, packing, pii, quality, spelling, toxicity, url_filter
from furlong.llm.ngram_join import near_duplicate_classes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the text of conversations, the background all documents."""
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


#: The contract's rules.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP2_SQL = """
with rules(rule, action) as (values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
parts as (select rule, action, split_part(rule, '/', 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from rules),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parsed as (
  select row_number() over () as k, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rest),
best as (
  select k, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from parsed join parts on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by k)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from parsed left join best using (k)
"""


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "offending")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The key of the registered query's surrogates; production passes its own secret.
SURROGATE_KEY = b"surrogates of the registered queries"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "n_entities", "text")


def language_model(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    return langid.fit(table(spark, sf_dir, "documents").filter(fold("doc_id", 3) != 1))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_languages(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "spans")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    turns = conversation.damaged(rows, F.crc32(key.cast("binary")) % 20)
    return conversation.repaired_digests(turns, conversation.audits(turns, rows))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(table(spark, sf_dir, "documents"), spelling.misspelt()))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    return quality.fit(table(spark, sf_dir, "documents"), labels)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "bad_lines")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filter": op2_url_filter,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL}
