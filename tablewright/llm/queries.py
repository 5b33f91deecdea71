"""The queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontamination, exact_dedup, html_template, language_model, mixing, pii, rule_ensemble, simhash, spelling_variants, substring_dedup, token_alignment, toxicity, warc
from tablewright.storage import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(run):
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op2_class_ngrams")
def op2(spark, folder):
    return language_model.class_ngrams(table(spark, folder, "documents"))


@query("op5_warc_transactions")
def op5(spark, folder):
    pages, path = table(spark, folder, "pages"), scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    # Only what the digest columns come from goes through the joins: the bodies of responses stay behind.
    narrow = records.withColumn("payload", F.when(F.col("kind") == "metadata", F.col("payload"))).withColumn("http", F.lit(None).cast("string"))
    # Requests, responses and metadata are three uses of the records: the archives are parsed once for all.
    found = warc.resolved(warc.assemble(cut_lineage(narrow, "records")))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


@query("op6_simhash_multi_index")
def op6(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_toxicity_subwords")
def op7(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op10_exact_quotient_filter",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op10(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@query("op1_template_extraction")
def op1(spark, folder):
    return html_template.extract(table(spark, folder, "pages"))


@query("op3_weakly_supervised_pii")
def op3(spark, folder):
    return pii.personal_data(table(spark, folder, "documents"))


#: Weights of language and labelled quality that the mix is to have.
TARGETS = {"en:1": 0.5, "en:0": 0.04, "de:1": 0.15, "de:0": 0.02, "fr:1": 0.15, "fr:0": 0.02, "es:1": 0.1, "es:0": 0.02}


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    domain = F.concat_ws(":", "lang", F.col("quality").cast("string"))
    return mixing.mix(docs, mixing.labelled_sample(docs, labels, "doc_id", "text", domain, mixing.MAX_ROWS), TARGETS)


@query("op4_soft_mixing")
def op4(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return mixed(documents, table(spark, folder, "labels")).select("doc_id", "tokens", "domain", "posterior", "rate")


@query("op8_benchmark_alignment")
def op8(spark, folder):
    return decontamination.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_anchored_substrings")
def op9(spark, folder):
    return substring_dedup.substring_dedup(table(spark, folder, "documents")).drop("kept_text")


@query("op13_sparse_rules")
def op13(spark, folder):
    return rule_ensemble.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_gram_variants")
def op11(spark, folder):
    return spelling_variants.spelling_variants(table(spark, folder, "documents"))


@query("op12_distinct_alignment")
def op12(spark, folder):
    measures, _ = token_alignment.token_alignment(table(spark, folder, "documents"))
    return measures
