"""A training corpus from `documents`: judge, identify, deduplicate, mix, pack."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peeratlas.llm import fm_quality, kernel_lid, mixture, near_copies, packing
from peeratlas.llm.batches import small_batches
from peeratlas.llm.storage import checked, cut, drop

#: A document is rejected below these scores.
LEAST_QUALITY, LEAST_LANGUAGE = 0.3, 0.3
TOKENIZER = "word_bpe_49k.json"
#: Names of columns that stages add and take away again; documents have no such columns.
QUALITY, LANGUAGE, SURE, ROW, KEY, PRINT = (f"__stage_{n}" for n in ("quality", "language", "sure", "row", "key", "print"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    model = fm_quality.fitted(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return fm_quality.scored(docs, model, score_col=QUALITY).where(F.col(QUALITY) >= LEAST_QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernel can tell: not those without letters."""
    small_batches(spark)
    learn = F.coalesce(fm_quality.fold("doc_id", 4) != 2, F.lit(True))
    found = kernel_lid.identified(docs, kernel_lid.learned(docs.where(learn)), lang_col=LANGUAGE, score_col=SURE)
    return found.where((F.col(LANGUAGE) != "und") & (F.col(SURE) >= LEAST_LANGUAGE)).select(*docs.columns)


def one_row(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows with one key the first by all columns as JSON."""
    first = F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns)))
    return rows.groupBy(F.col(key).alias("__key")).agg(first.alias("__row")).select("__row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, and one
    row of it (the first by its columns); where an id stands on different texts, each
    counts for itself. Rows without an id go if they are linked with a document that has
    one; of the others one per fingerprint stays.

    Only ids and fingerprints are shuffled; texts are filtered where they are read by the
    ids that go, while these are few enough to broadcast (else by a join).
    """
    small_batches(spark)
    found = cut(near_copies.near_copies(docs), "found")
    named = found.where("id is not null")
    gone = checked(named.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct())
    clash = cut(named.groupBy(F.col("id").alias("doc_id")).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id"), "clash")
    stay = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    if not clash.isEmpty():
        stay = stay.join(checked(clash), "doc_id", "left_anti")
    again = cut(named.where("id = component_id").groupBy(F.col("id").alias("doc_id")).count().where("count > 1").select("doc_id"), "repeated")
    if not again.isEmpty():
        twice = stay.join(checked(again), "doc_id", "left_semi").select(*docs.columns)
        twice = one_row(twice, "doc_id").select(*docs.columns)
        stay = stay.join(checked(again), "doc_id", "left_anti").select(*docs.columns).union(twice)
    if not clash.isEmpty():
        odd = docs.join(checked(clash), "doc_id", "left_semi").withColumn(ROW, F.struct("doc_id", F.coalesce("text", F.lit("")).alias("key")))
        keep = named.where("id = component_id").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k")).select("k.*")
        first = near_copies.fingerprints(odd, id_col=ROW).select(F.col("id.doc_id").alias("id"), "id.key", "fp").join(keep, ["id", "fp"]).groupBy("id", "fp").agg(F.min("key").alias("key"))
        own = odd.join(first.select(F.struct(F.col("id").alias("doc_id"), "key").alias(ROW)), ROW, "left_semi")
        own = one_row(own, ROW)
        stay = stay.select(*docs.columns).union(own.select(*docs.columns))
    bare = docs.where("doc_id is null")
    if not bare.isEmpty():
        free = found.where("id is null and component_id is null").select("fp").distinct()
        prints = near_copies.fingerprints(bare, id_col="text").toDF(KEY, PRINT).join(free.withColumnRenamed("fp", PRINT), PRINT).groupBy(PRINT).agg(F.min(F.coalesce(KEY, F.lit(""))).alias(KEY))
        texts = bare.withColumn(KEY, F.coalesce("text", F.lit(""))).join(prints.select(KEY), KEY, "left_semi")
        stay = stay.select(*docs.columns).union(one_row(texts, KEY).select(*docs.columns))
    return stay.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: copies, and parts of single documents."""
    small_batches(spark)
    return mixture.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2,048."""
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", dedup),
    ("mixing to target weights", mix),
    ("packing", pack),
]
#: The stages learn models; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
