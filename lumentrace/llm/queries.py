"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, written
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: 3-word shingles, links at two or fewer bits."""
    from .simhash_dedup import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_bits=2)

def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside occurrences of 13-word windows of benchmark items."""
    from .decontaminate import contamination, judged

    rows = judged(*contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")), share=20)
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_grouping_ga_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents, tokenized, in as few sequences of 4096 tokens as the islands find."""
    from .packing import pack

    return pack(written(_document_pieces(_table(spark, sf_dir, "documents"), tokenizer_path), "pack-pieces"), 4096)


def _document_pieces(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    from .packing import pieces

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pieces(docs, tokenizer_path, capacity=4096, end_id=1, keep_ids=False).withColumnRenamed("id", "doc_id")


def op9_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written and read back."""
    from .chat_format import examples, format_turns, read_back

    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = written(format_turns(turns), "chat-formatted")
    return read_back(formatted, written(examples(formatted), "chat-examples"))


def op3_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written to a content-addressed archive and read back from it."""
    from .warc_store import read_archive, write_archive

    got = read_archive(*write_archive(_table(spark, sf_dir, "pages"), min_revisit=1000))
    return got.select(
        F.col("id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to")
    )


def op10_rotated_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every embedding whose id is divisible by 20."""
    from .rotated_codes import build_index, nearest

    index, cells = build_index(_table(spark, sf_dir, "embeddings"))
    return nearest(index, index.where("id % 20 = 0"), cells, k=20)


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from toxic and unlabelled texts of four of five folds."""
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    model = train(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    got = score(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model, "text", "doc_id", "held_out")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the languages of three of four folds."""
    from .language_id import predict, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    tables = train(docs.where(~held_out))
    return predict(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), tables, "text", "doc_id", "held_out")


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document has."""
    from .line_dedup import remove_repeated

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs, "doc_id", "text", min_words=50)


def op2_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url: the longest fitting rule's, else its path template's."""
    from .url_templates import judged

    return judged(_table(spark, sf_dir, "pages"))


def op11_offset_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The piece ids of every document and what they decode to, as digests."""
    from .piece_encoding import decode, encode

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    got = decode(encode(_table(spark, sf_dir, "documents"), model_path), model_path)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among all words of the documents, one in 97 of a document's words less a letter."""
    from .spelling_variants import variants, vocabulary

    return variants(vocabulary(_table(spark, sf_dir, "documents"), min_length=5, min_count=3, typo_every=97))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 50; every seventh label is moved on by one first."""
    from .hard_negatives import mine

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_template_tree": op2_template_tree,
    "op3_content_addressed_warc": op3_content_addressed_warc,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_grouping_ga_packing": op6_grouping_ga_packing,
    "op7_line_chunks": op7_line_chunks,
    "op8_winnowing": op8_winnowing,
    "op9_prefix_target": op9_prefix_target,
    "op10_rotated_one_bit": op10_rotated_one_bit,
    "op11_offset_pieces": op11_offset_pieces,
    "op12_errata_trie": op12_errata_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
