"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step counts the rows of a key and passes on only rows whose key is shared; a row that is alone at any step is settled.
Texts are read once: the scan keeps their length and hashes, and no text is shuffled. A length, prefix or text may hold any
share of the rows: counts are summed before the shuffle, and their facts return through a join that broadcasts hot keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import apply_decisions, hot_join, row_id, store, text_or_empty

#: Code points that the second step hashes.
PREFIX = 256


def _shared(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows whose key another row has too."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return hot_join(rows, counts, keys, "_n", total).filter("_n IS NOT NULL").drop("_n")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, `_row` (unique) and `_text_hash`.

    Null text counts as empty. Of equal texts the row with the largest id stays; a null id is smaller than any other; of
    rows with the same text and id one stays. Other columns are not looked at. An empty table gives no rows.
    """
    text = text_or_empty() if text is None else text
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text")).select(
        "_id",
        row_id().alias("_row"),
        F.octet_length("_text").cast("long").alias("_length"),
        F.xxhash64(F.substring("_text", 1, PREFIX)).alias("_prefix"),
        F.unhex(F.sha2("_text", 256)).alias("_full"),
        F.xxhash64("_text").alias("_text_hash"),
    )
    rows = store(rows, "exact-rows")
    total = rows.count()
    same_length = _shared(rows, ["_length"], total)
    same_prefix = _shared(same_length, ["_length", "_prefix"], total)
    full = ["_length", "_prefix", "_full"]
    groups = same_prefix.groupBy(*full).agg(
        F.count("*").alias("_n"), F.max(F.struct(F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_keep")
    )
    out = hot_join(rows, store(groups.filter("_n > 1"), "exact-groups"), full, "_n", total)
    alone = F.col("_n").isNull()
    return out.select(
        F.col("_id").alias(id_column),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep.row"))).alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
        "_row",
        "_text_hash",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return apply_decisions(docs, exact_duplicates(docs), F.col("kept"))
