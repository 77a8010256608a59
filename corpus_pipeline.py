"""The corpus pipeline: documents to token ids, five stages, each written as Parquet and read again.

Toxic documents go; of each group of near copies one document stays; documents that are contaminated by the benchmark
go, and shorter passages of it are cut out of the others; personal data get pseudonyms; the texts are encoded.
All stages but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenfold.llm import byte_bpe, common, decontaminate, ngram_join, pii, toxicity


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): row holds the other columns, so that the operators' added columns can't clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*(rest or [F.lit(0).alias("_")])).alias("row"), "text")


def unpacked(found: DataFrame, columns: list[str], changed: Column | None = None) -> DataFrame:
    """The rows with found's text; n_chars follows where the text is changed."""
    row = {c: F.col("text") if c == "text" else F.col("row")[c] for c in columns}
    if "n_chars" in row and changed is not None:
        row["n_chars"] = F.when(changed, F.length("text").cast(found.schema["row"].dataType["n_chars"].dataType)).otherwise(row["n_chars"])
    return found.select(*(v.alias(c) for c, v in row.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = toxicity.learn(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), learned).where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with `_vertex`: the doc_id where it is one row's alone, else (null or repeated) a number over 2**62 from a hash of
    id and text, so that only equal rows share one; and the repeated ids."""
    repeated = common.spool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1"), "repeated-ids")
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    vertex = F.when(F.col("_k").isNotNull() | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").cast("long"))
    return docs.join(repeated, "doc_id", "left").withColumn("_vertex", vertex).drop("_k"), repeated


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: word 5-grams, similarity 0.8.

    Every row takes part, also one whose doc_id is null or another row's too; of a group of such rows alone, that with
    the smallest hash stays. Equal rows (id and text) are one.
    """
    columns = docs.columns
    with_vertex, repeated = numbered(docs)
    found = ngram_join.components(with_vertex, id_col="_vertex", shingle=5, per_cent=80)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_vertex")).distinct()
    kept = with_vertex.join(stay, "_vertex", "left_semi")
    doubtful = F.col("_vertex") >= 1 << 62
    return kept.where(~doubtful).select(*columns).union(kept.where(doubtful).dropDuplicates(["_vertex"]).select(*columns))


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(packed(docs), common.table(spark, sf_dir, "benchmark")).where(~decontaminate.contaminated())
    return unpacked(found.withColumn("text", decontaminate.strip_spans(F.col("text"), F.col("spans"))), docs.columns, F.size("spans") > 0)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpacked(pii.pseudonymise(packed(docs), key=pii.key_of(spark, pii.DEMONSTRATION_KEY), report="replaced"), docs.columns, F.size("replaced") > 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the bytes decoded from the ids."""
    path = common.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return byte_bpe.encode_column(docs, path, keep).select(*keep, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", decontaminate_texts),
    ("pii", pseudonymise),
    ("byte_bpe", encode),
]

#: SQL can't express the toxicity model or the Feistel network: test_run_equals_brute_force holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has read and its working tables are deleted once its own table is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.scope(spark):
            docs = common.keep(common.spool(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            common.drop_spool(before)
        before = docs
    return docs
