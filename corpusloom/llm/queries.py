"""The queries of this folder's operators over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, embed_dedup, html_extract, license_scan, line_dedup, merkle, packing, quality, simhash, spelling, toxicity, unigram_count, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file stands; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(spark, table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.ids_crc32(packing.pack(docs, tokenizer_file("word_bpe_49k.json")))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality.classify(docs, table(spark, sf_dir, "labels"))
    return rated.selectExpr("doc_id", "expected_grade", "p_ge_1", "p_ge_2", "p_ge_2 is null or p_ge_2 >= 0.5 as keep")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), slips=31)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and for each row the root that its proof gives for a table tampered with."""
    docs = table(spark, sf_dir, "documents")
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.col("n_chars") + F.coalesce(bad, F.lit(False)).cast("long")}
    now = merkle.leaf_digest([tampered.get(f, F.col(f)) for f in merkle.FIELDS])
    proof = (F.col("before"), F.col("after"))
    rows = merkle.manifest(docs, carry={"now": now}).withColumn("folded_root", merkle.fold(F.col("now"), *proof))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(*proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_toxicity(docs, model, keep={"held_out": held_out})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_license": op4_license,
    "op5_token_count": op5_token_count,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_merkle": op12_merkle,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.SQL, "op6_embedding_dedup": embed_dedup.SQL, "op10_line_dedup": line_dedup.SQL, "op11_spelling": spelling.SQL, "op12_merkle": merkle.SQL}
