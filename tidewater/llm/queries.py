"""One query an operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import articles, fingerprints, hosts, leaks, lines, mixing, near, pseudonyms, quality, search, substrings, tokens, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        fingerprints.resemblance(own, after).alias("near_next"),
    )


#: Where the session names the key of the pseudonyms, and the one for the public test tables, which hide nothing.
PSEUDONYM_KEY, TEST_KEY = "spark.tidewater.pseudonyms.key", "of the test tables"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(PSEUDONYM_KEY, TEST_KEY))


def op8_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_shared(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


QUERIES = {
    "op1_url_trust": op1_url_trust,
    "op2_source_mix": op2_source_mix,
    "op3_token_records": op3_token_records,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontamination": op5_decontamination,
    "op6_fingerprints": op6_fingerprints,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_article_text": op8_article_text,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL = {
    "op2_source_mix": mixing.mix_sql(),
    "op9_substring_dedup": substrings.SQL,
    "op12_ranked_search": search.SQL,
    "op13_line_dedup": lines.SQL,
}
