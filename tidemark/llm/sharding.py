"""Proportional stratified interleaving of documents over shards.

Within each source the rows are ranked in a seeded shuffle. Rank k of n becomes the fraction (2k - 1) / 2n, rows of all
sources are put in the order of their fractions, and that order is cut into runs of equal count: shard sizes differ by one
row at most, and each shard holds every source in its share of the corpus, to within about a row.

Both rankings are exact and global, yet no task sorts a whole source: rows are dealt by (source, leading bits of the
hash), respectively by leading part of the fraction, and each cell's first rank comes from a prefix sum over cell counts.
Cells are even because hashes and fractions are, but for rows that repeat id, size and checksum, which share one (as rows of six
numbers). The prefix sums run over cells alone, about one for 25,000 rows and 4,096 at least. Texts are reduced to their size
and checksum in the scan.

Defined cases: a null source is a source of its own; a null text has no bytes; a null id is dealt like any other. Rows equal in
everything are interchangeable. An empty table gives no rows. Carried columns keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of


def assign(docs: DataFrame, *, shards: int = 16, seed: int = 20240229, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size (bytes and one), text_crc32, shard, slot, then the carried columns in a struct `row`."""
    data = bytes_of(F.col(text_col))
    source = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("src"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else [])
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "crc", "size"))
    order = ["h", "doc_id", "crc", "size"]
    total = docs.count()
    bits = max(8, (total // 50_000).bit_length())  # cells of the hash; the result doesn't depend on them
    cells = 1 << max(12, bits)

    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
    counts = rows.groupBy("src", "cell").agg(F.count("*").alias("c"))
    by_source = Window.partitionBy("src")
    before = counts.select("src", "cell", (F.sum("c").over(by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("first"), F.sum("c").over(by_source).alias("n"))
    ranked = rows.join(before, ["src", "cell"]).withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("src", "cell").orderBy(*order)))
    placed = ranked.withColumn("at", (2 * F.col("rank") - 1) / (2 * F.col("n"))).drop("first", "n", "rank", "cell").withColumn("cell", F.floor(F.col("at") * cells).cast("int"))

    sums = placed.groupBy("cell").agg(F.count("*").alias("c"))
    sums = sums.select("cell", (F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("first"))
    place = F.col("first") + F.row_number().over(Window.partitionBy("cell").orderBy("at", *order, "src")) - 1
    out = placed.join(sums, "cell").withColumn("p", place.cast("long"))
    shard = F.floor(F.col("p") * shards / F.lit(max(total, 1))) if total * shards < 2**52 else F.expr(f"p * {shards} div {total}")
    out = out.withColumn("shard", shard.cast("int"))
    slot = F.col("p") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", slot.cast("long").alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, *, shards: int = 16, files_per_shard: int = 1, **options) -> None:
    """Writes the documents as Parquet, one folder per shard, rows in slot order within each file."""
    out = assign(docs, shards=shards, carry=tuple(docs.columns), **options)
    out = out.repartitionByRange(shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("shard", "slot", F.col("row").alias("document")).write.partitionBy("shard").mode("overwrite").parquet(path)
