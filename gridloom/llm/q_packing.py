"""op5: all documents packed into sequences of 1024 tokens."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import packing as P
from gridloom.llm.shared import Scratch, table


def packed(docs: DataFrame) -> DataFrame:
    """Where each piece of docs goes, with a digest of its ids."""
    import public_tokenizers as tokenizers

    made = P.pieces(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    made = made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    made = Scratch(docs.sparkSession, "packing").keep(made, "pieces")
    return P.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
