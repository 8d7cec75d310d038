"""From raw documents to token ids: the stages of a training corpus, each on all the last one kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Each
result is written before the next stage reads it, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvermart.llm import toxicity, word_bpe
from silvermart.llm.common import Scratch, labels, short_batches
from silvermart.llm.jaccard_join import link_documents
from silvermart.llm.mixing import by_length, mix
from silvermart.llm.queries import tokenizer_path
from silvermart.llm.substring_dedup import remove_repeats

# From this chance on a document is toxic and goes.
TOXIC = 0.5
# Near copies share this much of their word shingles; the query op8 has bounds of its own.
NEAR_GRAM, NEAR_PER_CENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold.

    NULL, empty and other texts without words stay, and all documents if the labels that can be
    learned from are not of both kinds.
    """
    model = toxicity.train(docs, labels(spark, sf_dir))
    if not model.both_labels:
        return docs
    scored = toxicity.score(docs, model, "__toxicity")
    goes = toxicity.is_toxic(F.col("__toxicity"), TOXIC) & toxicity.has_words(F.col("text"))
    return scored.where(~goes).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group, once.

    Of rows with that id the one whose text has the least hash stays. Rows without an id are in no
    group and stay.
    """
    linked = link_documents(docs, gram=NEAR_GRAM, per_cent=NEAR_PER_CENT)
    first = linked.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.where("doc_id is not null").join(first, F.col("doc_id") == F.col("__id"))
    one = Window.partitionBy("__id").orderBy(F.xxhash64("text"), "text")
    kept = rows.withColumn("__place", F.row_number().over(one)).where("__place = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns, and the whole row as one value, whose names cannot meet an operator's."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where word sequences repeat, the other words joined by one space."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    # The text goes once.
    rest = docs.select("doc_id", "text", F.struct("n_chars", *[f"`{c}`" for c in others]).alias("__row"))
    changed = F.col("n_removed") > 0
    new = {
        "text": F.when(changed, F.col("kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("__row.n_chars")),
    }
    return remove_repeats(rest).select(
        *[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all or several times."""
    packed = _packed(docs, "doc_id", "text", "source")
    mixed = mix(packed, "doc_id", "text", "source", lean=by_length).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.select("__row", times.alias("__copy")).select("__row.*")


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they stand for."""
    coded = word_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _stage(step):
    @wraps(step)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return step(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("near_duplicates", _stage(keep_one_of_each_group)),
    ("substring_dedup", _stage(cut_repeats)),
    ("mixing", _stage(mix_sources)),
    ("word_bpe", _stage(to_ids)),
]

# The trained scores, the draw and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark), None
    for name, stage in STAGES:
        docs = scratch.store(name, stage(spark, docs, sf_dir))
        if before:
            scratch.discard(before)
        before = name
    return docs
