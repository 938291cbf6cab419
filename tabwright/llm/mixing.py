"""A mix of sources at target weights by weighted fair queueing.

Every source is a queue: its documents in shuffled order, once for each epoch. A document's virtual finish time is the
source's words up to and with it, divided by the source's target, so a source at time 1 has given exactly its target. The
copies of all sources are range-sorted by that time and cut where the total budget ends. No queue is one task: running sums
are added up within ranges, and one total per range carries them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import apply_decisions, hot_join, number_rows, row_id, running_total, store, text_or_empty

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The budget is BUDGET / 2 of all words; a source gives at most EPOCHS times its words.
BUDGET = 3
EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources (source, source_size, rows) with their `place`, `weight` and `target`.

    A budget of 1.5 times all words is shared by weight. A source whose share is over twice its words gets just that, and
    the rest is shared again; as shares only grow, each pass is one sum over the sources, until no further source is full.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = number_rows(sizes, order, "mix-sources", "place")
    by_place = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    placed = store(placed.withColumn("weight", by_place.cast("long")), "mix-weights")
    words = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * EPOCHS
    spent, shared = 0, placed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    while True:
        # weight * (budget - spent) / shared > cap, in whole numbers
        full = F.col("weight") * F.lit(BUDGET * words - 2 * spent) > F.lit(2) * cap * F.lit(shared)
        row = placed.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("shared"),
        ).first()
        if (row["spent"], row["shared"]) == (spent, shared):
            break
        spent, shared = row["spent"], row["shared"]
    rest = F.col("weight") * F.lit((BUDGET * words - 2 * spent) / 2) / F.lit(float(max(shared, 1)))
    return placed.withColumn("target", F.when(full, cap.cast("double")).otherwise(rest))


def mix(docs: DataFrame, seed: int = 42, id_column: str = "doc_id", size: Column | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, epochs (copies in the mix), `_row`, `_text_hash`.

    Null text has size 0; such rows are never taken for words, but stay in the result. A null source is a source of its own,
    the last. The shuffle is by a hash of the id; rows with the same id follow each other. Reruns give the same mix.
    """
    size = word_count(text_or_empty()) if size is None else size
    rows = docs.select(
        F.col(id_column),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
        row_id().alias("_row"),
        F.xxhash64(text_or_empty()).alias("_text_hash"),
    )
    rows = store(rows, "mix-rows")
    total = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = source_targets(sizes).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    facts = targets.select("_key", "source_size", "target", "place", "_n")
    queued = hot_join(keyed, facts, ["_key"], "_n", total).drop("_key", "_n")
    turn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    queued = queued.withColumn("_turn", turn)
    order = [F.col("place"), F.col("_turn"), F.col(id_column), F.col("size")]
    queued = running_total(queued, order, "size", "mix-queues", "_given", group="place")
    copies = queued.withColumn("_epoch", F.explode(F.array(*[F.lit(i) for i in range(EPOCHS)])))
    finish = F.when(F.col("target") > 0, (F.col("_epoch") * F.col("source_size") + F.col("_given")) / F.col("target"))
    copies = copies.withColumn("_finish", F.coalesce(finish, F.lit(0.0)))
    order = [F.col(c) for c in ("_finish", "place", "_epoch", "_turn", id_column, "size")]
    mixed = running_total(copies, order, "size", "mix-order", "_spent")
    inside = F.col("_spent") <= F.lit(budget)
    return mixed.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (id_column, "source", "size", "source_size", "target", "_text_hash")],
        F.sum(F.when(inside, F.col("size")).otherwise(F.lit(0))).alias("taken"),
        F.sum(inside.cast("int")).alias("epochs"),
    )


def mixed_rows(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns."""
    return apply_decisions(docs, mix(docs, seed), F.col("epochs"))
