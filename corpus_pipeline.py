"""From raw documents to packed token blocks: each stage is one operator, written as Parquet before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontam, langid, mixing, near, queries, tokens
from marginalia.session import materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; without any letter there is none."""
    model = langid.train(docs.filter(~queries.held_out()))
    found = langid.identify(docs, model, keep=tuple(docs.columns))
    numbered = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    kept = numbered.filter(f"c{len(docs.columns)} <> 'und'")
    return kept.select(*[kept[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 over five-word shingles stays."""
    dropped = near.near_duplicates(docs, size=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten benchmark words."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted mix takes it."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, repeats=2)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed store, as an index with the check sum of each document's ids read back from it."""
    return tokens.encoded(docs, tokenizer=TOKENIZER, end_id=0)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", pack_tokens),
]
#: SQL has neither the language model, the shingle components nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
