"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked inside their source. A row's
fractional rank (rank - 1/2) / (rows of its source) spreads every source evenly
over (0, 1); sorting all rows by it interleaves the sources in proportion, and
cutting that order into equal runs gives shards that each hold the corpus
mixture. Native functions only. Both numberings are range-partitioned, so a
source holding a third of all rows is spread over many tasks.

Defined results: null text counts as no bytes (size 1, crc32 0); null sources
form one source; repeated rows and ties each get their own place; an empty
table gives no rows; other columns are ignored. Rows of equal text are placed
independently (the law ``rows`` bounds counts, and a large group of equal texts
cannot stay in one shard under it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.operators.ranking import row_number_global, row_number_within


def stratified_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id",
                      text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): shard sizes differ by at most one row, slots are gapless."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    ).withColumn("shuffle_key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")) \
     .withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))  # null sources: one stratum
    order = ["shuffle_key", "doc_id", "text_crc32", "size"]
    ranked = row_number_within(rows, ["stratum"], order, col="rank")
    # the largest rank of a source is its row count
    sizes = ranked.groupBy("stratum").agg(F.max("rank").alias("of"))
    placed = ranked.join(sizes, "stratum").withColumn("fraction", (F.col("rank") - 0.5) / F.col("of")).drop("of")
    placed = row_number_global(placed, ["fraction", F.xxhash64("stratum"), "stratum", "rank"], col="place", start=0)
    total = ranked.count()
    shard = F.expr(f"place * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", (F.col("place") - first).cast("long"))
            .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"))


def sharding_query(docs: DataFrame) -> DataFrame:
    """Every document in shards 0 to 7 under the law ``rows``."""
    out = stratified_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")
