"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``, whatever other columns there are. ``run`` writes each stage's result to the shared folder and reads it for the
next, so a lost executor repeats one stage at most, and removes what a stage wrote on its way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.llm import decontaminate, line_dedup, packing, simhash_dedup, toxicity
from lumentrace.llm.common import field, forget, parted, row_key, scratch, whole, written


def _without(docs: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """``docs`` less the rows whose doc_id and ``row_key`` of ``key`` are those of ``gone`` (id, rk); only rows that may go are shuffled."""
    rows = docs.select(whole(docs), F.col("doc_id").alias("i"), row_key(*key).alias("k"))
    some, others = parted(rows, F.xxhash64("i", "k"), gone.select(F.xxhash64("id", "rk").alias("k")))
    kept = some.join(gone.hint("shuffle_hash"), F.expr("i <=> id and k = rk"), "left_anti").unionByName(others)
    return kept.select(*[field(docs, c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; the model learns from a bounded sample of labelled toxic documents and of all text (``toxicity.MAX_POSITIVE``, ``MAX_UNLABELLED``)."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs.select("text", whole(docs)), model, "text", "row").where("score < 0.5")
    return kept.select(*[field(docs, c) for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; passages of 50 words or more that an earlier one has leave its text, and n_chars, if there is one, follows."""
    rows = docs.select("doc_id", "text", whole(docs))
    got = line_dedup.remove_repeated(rows, "doc_id", "text", min_words=50)
    cut = F.col("removed_lines") > 0
    new = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text")).otherwise(field(docs, "n_chars")).cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in docs.columns else None}
    return got.select(*[(new[c] if c in new else field(docs, c)).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (5-word shingles, similarity 0.8) exactly one document stays.

    It is the one with the least id, where ids are shared the least row key; null ids come last.
    """
    classes = written(simhash_dedup.similar_classes(docs, "doc_id", "text", shingle=5, similarity=0.8), "pipeline-classes")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rk"))
    least = classes.groupBy("component").agg(F.min(order).alias("r"), F.count("*").alias("n")).where("n > 1")
    least = written(least.select("component", F.struct("r.id", "r.rk").alias("first")), "pipeline-least")
    member = classes.join(least, "component")
    gone = written(member.where("not (id <=> first.id and rk = first.rk)").select("id", "rk").distinct(), "pipeline-near-copies")
    kept = _without(docs, gone, *docs.columns)
    repeated = member.where("id <=> first.id and rk = first.rk").groupBy("id", "rk").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    rows = kept.select(whole(docs), F.xxhash64("doc_id").alias("i"), row_key(*docs.columns).alias("k"))
    return rows.dropDuplicates(["i", "k"]).select(*[field(docs, c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words inside benchmark windows go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = written(decontaminate.judged(*decontaminate.contamination(docs, benchmark), share=20).where("contaminated").select("id", "rk").distinct(), "pipeline-contaminated")
    return _without(docs, bad, "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence of 4096 tokens and the offset that each has."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pieces(docs, tokenizer_path, capacity=4096, end_id=1, keep_ids=False).withColumnRenamed("id", "doc_id")
    return packing.pack(written(pieces, "pipeline-pieces"), 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Learned scores, hashed fingerprints and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark) as outside:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", outside)
        if before is not None:
            forget(before)
        before = docs
    return docs
