"""Registered queries of the operators here, and the SQL that expresses them where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import align, codes, decontam, exact, langid, lines, mixing, near, parity, pii, quality, tokens, urls


def _table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def held_out() -> Column:
    """One document in five by the check sum of its id; null ids are in neither part."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_extendible_hash(spark: SparkSession, base: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact.exact_duplicates(_table(spark, base, "documents"))


def op2_line_chunks(spark: SparkSession, base: str) -> DataFrame:
    """All documents without the chunks of lines that stand elsewhere too; a digest of what is left."""
    found = lines.cut_repeated_lines(_table(spark, base, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_cut", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_support_vectors(spark: SparkSession, base: str) -> DataFrame:
    """The quality of every document, learned from the labels of those not held out."""
    docs = _table(spark, base, "documents")
    model = quality.train(docs, _table(spark, base, "labels").filter(~held_out()))
    found = quality.quality_scores(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_packed_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Where each document's ids stand in the packed store, and their check sums, read back from its files."""
    import public_tokenizers

    return tokens.encoded(_table(spark, base, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op5_minhash(spark: SparkSession, base: str) -> DataFrame:
    """Near-duplicate groups over two-word shingles at similarity 0.8."""
    return near.near_duplicates(_table(spark, base, "documents"), size=2, percent=80)


def op6_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    """Documents with runs of ten benchmark words, or all words of a shorter item."""
    found = decontam.benchmark_hits(_table(spark, base, "documents"), _table(spark, base, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def op7_fair_queue(spark: SparkSession, base: str) -> DataFrame:
    """What a mix of all sources, weighted 3, 1, 2 in turn, takes of each document."""
    return mixing.mix_shares(_table(spark, base, "documents"), weights=(3, 1, 2), share=1.5, repeats=2)


def op8_word_backoff(spark: SparkSession, base: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = _table(spark, base, "documents")
    model = langid.train(docs.filter(~held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_boosted_spans(spark: SparkSession, base: str) -> DataFrame:
    """Personal data in every document: certain spans, and those that boosted trees add."""
    found = pii.personal_data(_table(spark, base, "documents"))
    counts = [pii.of_kind(F.col("certain"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("certain")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.concat("certain", "added")).alias("spans"))


RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op10_character_ratio(spark: SparkSession, base: str) -> DataFrame:
    """A verdict on every page's URL: by rule, or else by character language models of the ruled ones."""
    return urls.url_verdicts(_table(spark, base, "pages"), RULES)


def op11_vector_codes(spark: SparkSession, base: str) -> DataFrame:
    """The code of every vector: 16 parts, 64 entries a codebook, two rounds."""
    return codes.code_table(_table(spark, base, "embeddings"))


def op12_parity_sketch(spark: SparkSession, base: str) -> DataFrame:
    """Groups of documents linked by five-word shingles at similarity 0.8."""
    return parity.similar_documents(_table(spark, base, "documents"), size=5, percent=80)


def op13_identity_map(spark: SparkSession, base: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document, and how common its links are in all of them."""
    import public_tokenizers

    return align.aligned_documents(
        _table(spark, base, "documents"), byte_level=public_tokenizers.path("byte_bpe_50k.json"),
        piecewise=public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_extendible_hash": op1_extendible_hash,
    "op2_line_chunks": op2_line_chunks,
    "op3_support_vectors": op3_support_vectors,
    "op4_packed_tokens": op4_packed_tokens,
    "op5_minhash": op5_minhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_fair_queue": op7_fair_queue,
    "op8_word_backoff": op8_word_backoff,
    "op9_boosted_spans": op9_boosted_spans,
    "op10_character_ratio": op10_character_ratio,
    "op11_vector_codes": op11_vector_codes,
    "op12_parity_sketch": op12_parity_sketch,
    "op13_identity_map": op13_identity_map,
}
ORACLES = {
    "op1_extendible_hash": exact.ORACLE,
    "op2_line_chunks": lines.ORACLE,
    "op7_fair_queue": mixing.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_parity_sketch": parity.ORACLE,
}
