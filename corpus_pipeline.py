"""From documents to packed training sequences, stage by stage.

Each stage takes the session, the documents that the stage before it kept, and the folder of the
shared tables. All but the last give back documents with all their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import importance, near_dedup, packing, scratch, substring_dedup, toxicity
from wardline.llm.registry import tokenizer_file

#: Near copies are texts whose sets of five words are alike by this many percent (``op9`` has 85), and the equal signature coordinates, of 64, that a pair needs to be tested: one of similarity 0.80 has fewer with probability 4.2e-6.
NEAR_PERCENT, NEAR_MATCHES = 80, 36
#: Passages of over 50 words that repeat across documents are cut: strings of so many bytes are looked for (51 words are shorter only where words have under three letters on average), and runs of so many words go.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51
#: Rows in an Arrow batch at most: a batch of texts is a few MB then, and it stands in the JVM, on its way and in the worker, with each text twice (in its row too).
ARROW_ROWS = 512
#: Tables that the latest stage wrote for itself; the next one deletes those that it does not read.
_own: list[str] = []


def _begin(spark: SparkSession, docs: DataFrame) -> list[str]:
    scratch.release(spark, _own, needed_by=docs)
    _own.clear()
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    return scratch.written()


def _end(before: list[str]) -> None:
    _own.extend(p for p in scratch.written() if p not in before)


def _whole(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row as one column, so that no name of a document's columns can clash with an operator's."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. Null and empty texts stay."""
    before = _begin(spark, docs)
    scored = toxicity.toxicity(_whole(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry="_row")
    _end(before)
    return scored.where("predicted = 0").select("_row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps. Null and empty texts have weight 0 and are judged as such."""
    before = _begin(spark, docs)
    drawn = importance.resample(_whole(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry="_row")
    _end(before)
    return drawn.where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id. Rows repeated with id and text stay once; texts without words all stay, but for such repeats."""
    before = _begin(spark, docs)
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT, matches=NEAR_MATCHES, with_group=True).where("kept")
    # Rows of one id may be of one group: the least text hash of the smallest id stands for it. A text without a group is one by itself.
    alone = [F.when(F.col("group").isNull(), F.col(c)).alias(f"_{c}") for c in ("doc_id", "text_hash")]
    kept = found.groupBy("group", *alone).agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select(F.col("one.doc_id").alias("_kept"), F.col("one.text_hash").alias("_kept_text"))
    _end(before)
    whole = _whole(docs).select("_row", F.col("_row.doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    return whole.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_kept_text")), "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that stand anywhere else too (a character cut in two goes whole); ``n_chars``, if there, is counted anew."""
    before = _begin(spark, docs)
    cut = substring_dedup.remove_repeats(_whole(docs), PASSAGE_BYTES, carry="_row", least_words=PASSAGE_WORDS, joint=" ")
    _end(before)
    text = F.col("_text")
    columns = {"text": text.alias("text")} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {})
    cut = cut.withColumn("_text", F.when(F.col("n_removed") == 0, F.col("_row.text")).otherwise(substring_dedup.whole_characters("kept")))
    return cut.select(*[columns.get(c, F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces with their ids (little-endian unsigned 32-bit) and places in sequences of 2048 tokens; ``packing.sequences`` joins them up."""
    before = _begin(spark, docs)
    packed = packing.pack(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    _end(before)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage{k}")
            _own.append(scratch.written()[-1])
    return docs
