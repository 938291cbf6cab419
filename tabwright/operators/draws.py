"""Weighted draws from tables of values of any length.

The rule is one for all lengths: values in descending order of their counts, ties by their text, nulls last; a uniform
number u takes the first value whose cumulative share exceeds it.  Short lists are literals of an expression.  Long ones are
tables of intervals, cut into as many buckets of u as there are values, so that a draw is an equi-join on (given, bucket)
that meets about two intervals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.indexing import with_running_sum
from tabwright.operators.joins import fact_join
from tabwright.operators.logs import weighted_draw
from tabwright.session import cut_lineage

#: Entries of a table, all its conditions together, that become literals.
SHORT = 200


class Drawer:
    """Values of one column, for each value ``given`` of another; a column on its own has the single condition ''."""

    def __init__(self, lists: dict[str, list[tuple[str | None, int]]] | None, intervals: DataFrame | None, givens: DataFrame | None):
        self.lists, self.intervals, self.givens = lists, intervals, givens

    def draw(self, rows: DataFrame, name: str, u: Column, given: Column | None = None) -> DataFrame:
        """``rows`` with the text column ``name``; null where the condition was never seen."""
        if self.lists is not None:
            if given is None:
                return rows.withColumn(name, weighted_draw(self.lists.get("", [(None, 1)]), u))
            chain = F.lit(None).cast("string")
            for value, entries in self.lists.items():
                chain = F.when(given == value, weighted_draw(entries, u)).otherwise(chain)
            return rows.withColumn(name, chain)
        columns = rows.columns
        asked = rows.withColumns({"_given": F.lit("") if given is None else given, "_u": u})
        if given is None:
            size = self.givens.first()["_buckets"]  # one row
            asked = asked.withColumn("_buckets", F.lit(size))
        else:
            asked = fact_join(asked, self.givens, ["_given"], "_n").drop("_n")
        asked = asked.withColumn("_bucket", F.floor(F.col("_u") * F.col("_buckets")).cast("bigint")).drop("_buckets")
        held = self.intervals.alias("v")
        hit = (F.col("r._bucket") == F.col("v._bucket")) & (F.col("r._u") >= F.col("v.lo")) & (F.col("r._u") < F.col("v.hi"))
        if given is not None:  # a constant key would only make the rows slower to sort
            hit = (F.col("r._given") == F.col("v._given")) & hit
        joined = asked.alias("r").join(held, hit, "left")
        return joined.select(*[F.col(f"r.{c}").alias(c) for c in columns], F.col("v.value").alias(name))


def drawers(counts: DataFrame, short: int = SHORT) -> dict[str, Drawer]:
    """Drawers of several columns from (child, given, value, n); one row per column reaches the driver, and short tables."""
    counts = cut_lineage(counts)
    entries = {r.child: r.entries for r in counts.groupBy("child").agg(F.count("*").alias("entries")).collect()}
    out: dict[str, Drawer] = {c: Drawer({}, None, None) for c, n in entries.items() if n <= short}
    if out:
        listed = counts.where(F.col("child").isin(list(out))).orderBy("child", "given", F.desc("n"), F.asc_nulls_last("value"))
        for r in listed.collect():
            out[r.child].lists.setdefault(r.given, []).append((r.value, r.n))
    long = [c for c in entries if c not in out]
    if not long:
        return out
    table = counts.where(F.col("child").isin(long)).withColumns({"_less": -F.col("n"), "_null": F.col("value").isNull()})
    running = with_running_sum(table, ["child", "given", "_less", "_null", "value"], "n", "_sum")
    groups = running.groupBy("child", "given").agg(F.min(F.col("_sum") - F.col("n")).alias("_before"), F.sum("n").alias("_n"), F.count("*").alias("_rows"))
    # buckets: the number of values, as a power of two
    groups = cut_lineage(groups.withColumn("_buckets", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_rows").cast("double")))).cast("bigint")))
    joined = fact_join(running, groups.select("child", "given", "_before", "_n", "_buckets", "_rows"), ["child", "given"], "_rows")
    lo = (F.col("_sum") - F.col("n") - F.col("_before")) / F.col("_n")
    hi = F.when(F.col("_sum") - F.col("_before") == F.col("_n"), F.lit(1.0)).otherwise((F.col("_sum") - F.col("_before")) / F.col("_n"))
    spans = joined.select("child", F.col("given").alias("_given"), "value", lo.alias("lo"), hi.alias("hi"), "_buckets")
    last = F.least(F.floor(F.col("hi") * F.col("_buckets")), F.col("_buckets") - 1).cast("bigint")
    first = F.least(F.floor(F.col("lo") * F.col("_buckets")), F.col("_buckets") - 1).cast("bigint")
    spans = cut_lineage(spans.withColumn("_bucket", F.explode(F.sequence(first, last))).drop("_buckets"))
    for c in long:
        own = groups.where(F.col("child") == c).select(F.col("given").alias("_given"), "_buckets", "_n")
        out[c] = Drawer(None, spans.where(F.col("child") == c).drop("child"), own)
    return out


def bic(information: float, n: int, first: int, second: int) -> float:
    """Mutual information less the price of the cells that a dependence on so many categories needs."""
    return information - (first - 1) * (second - 1) * math.log(max(2, n)) / (2 * max(1, n))
