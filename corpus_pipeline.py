"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents, the last one a row for each piece of a packed sequence. Extra columns go; empty tables give empty tables; texts
are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import linededup, mixing, packing, quality, simhash
from folio.llm.common import Scratch
from folio.llm.queries import domain_of, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that the mixture takes. No document is taken twice.
MIXED = 0.9
#: Words that the encoder remembers in a generation; workers that have done the stages before have less room than those of op1.
REMEMBERED = 150_000
#: Fingerprints of words that a document has in the near-dedup stage, and the bits in which two of them may differ.
PRINTS, RADIUS = 4, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have no words, so they go; every repeated row is judged for itself."""
    return quality.verdicts(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; n_chars follows where a text changed. Rows stay, even those left without text."""
    made = linededup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("removed_chars") > 0
    return made.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one with the smallest id, rows without an id last, ties by a hash of the row.

    Texts without words are copies of each other. Of repeated rows one stays.

    Every edited word changes five shingles of five words, and fingerprints of shingles that are 0.8 alike differ in five
    to fourteen bits, which no number of tables covers. Distinct words change less, and PRINTS fingerprints of RADIUS bits
    find what one would find only with more bits.
    """
    rows = docs.select(*COLUMNS).withColumn("__row", F.xxhash64(*COLUMNS))
    made = simhash.near_duplicates(rows, shingle=None, radius=RADIUS, count=PRINTS, tie="__row")
    stays = Scratch(spark, "stays").save(made.filter("stays").select(F.col("doc_id").alias("__id"), F.col("__row").alias("__r"), "n"), "rows")
    one = rows.join(stays, (F.col("__row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*COLUMNS)
    return one if stays.filter("n > 1").isEmpty() else one.dropDuplicates(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights for domains, languages and sources, within what each source has. Null languages and sources are of their own; rows of one id are told apart by their text."""
    chosen = mixing.mix(docs.select(*COLUMNS).withColumn("domain", domain_of(F.col("source"))), ["domain", "lang", "source"], fraction=MIXED, max_epochs=1)
    return chosen.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences of 4096 tokens. A null or empty text is its end token; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True, remembered=REMEMBERED)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mix_sources), ("best-fit packing", pack)]

#: Hashes, rolling chunk boundaries and a tokenizer aren't to be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
