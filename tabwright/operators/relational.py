"""Related tables: key and constraint checks, test data that breaks them, synthesis that keeps them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators.cdc import insert_statement
from tabwright.operators.indexing import expand_counts, with_hashed_index
from tabwright.operators.prep import fixed_sample
from tabwright.operators.scalars import attach
from tabwright.operators.synthesis import independent_rows
from tabwright.session import cut_lineage


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key no parent has; a null key is not an orphan.

    Distinct child keys are checked first, so a key shared by a third of the rows is looked up once, and only
    the missing keys (usually few) are joined back.
    """
    known = parent.select(F.col(parent_column).alias(child_column))
    missing = child.select(child_column).where(F.col(child_column).isNotNull()).distinct().join(known, child_column, "left_anti")
    return child.join(missing, child_column, "left_semi")


def foreign_key_report(tables: dict[str, DataFrame], relationships: list[dict]) -> DataFrame:
    """(relationship, rows, orphans) per {parent_table, parent_column, child_table, child_column}."""
    parts = []
    for r in relationships:
        child, column = tables[r["child_table"]], r["child_column"]
        keys = child.groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("_n"))
        known = tables[r["parent_table"]].select(F.col(r["parent_column"]).alias("_k"), F.lit(1).alias("_hit")).distinct()
        joined = keys.join(known, "_k", "left")
        lost = F.sum(F.when(F.col("_hit").isNull() & F.col("_k").isNotNull(), F.col("_n")).otherwise(0))
        name = f"{r['child_table']}.{column}->{r['parent_table']}.{r['parent_column']}"
        parts.append(joined.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(lost, F.lit(0)).alias("orphans")).select(F.lit(name).alias("relationship"), "rows", "orphans"))
    return reduce(DataFrame.unionByName, parts)


def _named(rows: DataFrame, row_id: list[str], constraint: str, kind: str) -> DataFrame:
    return rows.select(F.concat_ws("|", *[F.col(c).cast("string") for c in row_id]).alias("row_id"), F.lit(constraint).alias("constraint"), F.lit(kind).alias("kind"))


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n) of the non-null key values that occur more than once."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(filled).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, constraints: list[dict], row_id: list[str], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(row_id, constraint, kind), one row per broken constraint and data row.

    A constraint is {kind: not_null | unique | primary_key | foreign_key | check | data_type, ...}: ``columns`` for
    the key kinds, ``column`` and ``type`` for types, ``expression`` for checks, and the parent for foreign keys.
    All row-local rules run in one scan.
    """
    local, parts = [], []
    for c in constraints:
        kind = c["kind"]
        if kind == "not_null":
            local += [(f"not_null:{x}", kind, F.col(x).isNull()) for x in c["columns"]]
        elif kind == "check":
            local.append((f"check:{c['expression']}", kind, ~F.coalesce(F.expr(c["expression"]), F.lit(True))))
        elif kind == "data_type":
            x = F.col(c["column"])
            local.append((f"data_type:{c['column']}", kind, x.isNotNull() & x.try_cast(c["type"]).isNull()))
        elif kind in ("unique", "primary_key"):
            if kind == "primary_key":
                local += [(f"primary_key:{x}", kind, F.col(x).isNull()) for x in c["columns"]]
            repeated = duplicate_keys(df, c["columns"]).select(*c["columns"])
            parts.append(_named(df.join(repeated, c["columns"], "left_semi"), row_id, f"{kind}:{','.join(c['columns'])}", kind))
        elif kind == "foreign_key":
            lost = orphans(df, c["column"], tables[c["parent_table"]], c["parent_column"])
            parts.append(_named(lost, row_id, f"foreign_key:{c['column']}", kind))
        else:
            raise ValueError(f"unknown constraint kind: {kind}")
    if local:
        hits = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("constraint"), F.lit(k).alias("kind"))) for n, k, bad in local]))
        ids = F.concat_ws("|", *[F.col(c).cast("string") for c in row_id])
        parts.insert(0, df.select(ids.alias("row_id"), F.explode(hits).alias("h")).select("row_id", "h.constraint", "h.kind"))
    return reduce(DataFrame.unionByName, parts)


def validation_score(df: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows, bad rows, share of good rows to four decimals."""
    bad = found.agg(F.count_distinct("row_id").alias("bad_rows"), F.count("*").alias("violations"))
    total = df.agg(F.count("*").alias("rows"))
    both = attach(total, bad)
    score = F.coalesce(F.round((F.col("rows") - F.col("bad_rows")) / F.col("rows"), 4), F.lit(1.0))
    return both.withColumn("score", score)


def first_errors(found: DataFrame, n: int | None = None) -> DataFrame:
    """All errors, or the first n in order."""
    if n is None:
        return found
    return found.orderBy("constraint", "row_id").limit(n)


def break_rows(
    df: DataFrame, keys: list[str], not_null: str, foreign_key: str, number: str, typed_text: str, per_class: int = 5, seed: int = keyed.SEED
) -> DataFrame:
    """Labelled bad rows: a few rows per class, each a valid row with exactly one rule broken.

    ``violation`` names the class: not_null, duplicate_key, foreign_key, check (a negative number), data_type (a text
    where ``typed_text`` should hold a number).
    """
    classes = {
        "not_null": {not_null: F.lit(None).cast(df.schema[not_null].dataType)},
        "duplicate_key": {},
        "foreign_key": {foreign_key: (F.lit(-1) - F.abs(F.col(foreign_key))).cast(df.schema[foreign_key].dataType)},
        "check": {number: -F.abs(F.col(number)) - 1},
        "data_type": {typed_text: F.lit("not a number")},
    }
    parts = []
    for i, (name, change) in enumerate(classes.items()):
        picked = fixed_sample(df, per_class, keys, seed=seed + i)
        parts.append((picked.withColumns(change) if change else picked).withColumn("violation", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def insert_statements(tables: dict[str, DataFrame], order: list[str], keys: dict[str, list[str]]) -> DataFrame:
    """(layer, table_name, statement): INSERTs with parents before children, keys in order inside a table."""
    parts = []
    for layer, name in enumerate(order):
        df = tables[name]
        sort_key = F.concat_ws("|", *[F.lpad(F.col(k).cast("string"), 20, "0") for k in keys[name]])
        parts.append(df.select(F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), sort_key.alias("row_key"), insert_statement(df.schema, F.lit(name)).alias("statement")))
    return reduce(DataFrame.unionByName, parts).orderBy("layer", "table_name", "row_key")


def dependency_order(names: list[str], relationships: list[dict]) -> list[str]:
    """Parents before children; a few schema entries, not data.  A cycle keeps the given order of its members."""
    left, out = list(names), []
    while left:
        blocked = {r["child_table"] for r in relationships if r["parent_table"] in left and r["parent_table"] != r["child_table"]}
        ready = [n for n in left if n not in blocked] or left[:1]
        out += ready
        left = [n for n in left if n not in ready]
    return out


# --- synthesis --------------------------------------------------------------


def children_histogram(parent: DataFrame, parent_column: str, child: DataFrame, child_column: str) -> DataFrame:
    """(children, parents): how many parents have how many children, parents without any included."""
    counts = child.groupBy(F.col(child_column).alias("_k")).agg(F.count("*").alias("_n"))
    joined = parent.select(F.col(parent_column).alias("_k")).distinct().join(counts, "_k", "left")
    return joined.groupBy(F.coalesce("_n", F.lit(0)).alias("children")).agg(F.count("*").alias("parents"))


def synthesize_parents(parent: DataFrame, key: str, scale: int = 1, seed: int = keyed.SEED) -> DataFrame:
    """Parents with new keys 0..n*scale-1, their other columns drawn column by column from the observed rows."""
    total = parent.count()
    rows = parent.sparkSession.range(total * scale)
    drawn = independent_rows(parent, [c for c in parent.columns if c != key], rows, [key], seed)
    return drawn.withColumnRenamed("id", key).select(*parent.columns)


def synthesize_children(
    new_parents: DataFrame, parent_column: str, parent: DataFrame, child: DataFrame, child_column: str, child_key: list[str], seed: int = keyed.SEED
) -> DataFrame:
    """Children of the new parents: a drawn number each, attributes drawn from the observed child rows.

    The number of children is that of the observed parent at a hashed position.
    """
    ids = F.col(parent_column)
    counts = child.groupBy(F.col(child_column).alias("_k")).agg(F.count("*").alias("_n"))
    observed = parent.select(F.col(parent_column).alias("_k")).distinct().join(counts, "_k", "left").na.fill({"_n": 0})
    indexed = with_hashed_index(observed, ["_k"], "_at").select("_at", F.col("_n").cast("int").alias("_n"))
    total = indexed.count()
    counted = new_parents.select(parent_column, keyed.index_below(max(total, 1), "children", ids, seed=seed).alias("_at")).join(indexed, "_at").drop("_at")
    slots = expand_counts(counted, "_n", "_j").select(parent_column, (F.col("_j") + 1).alias("_j"))
    numbered = with_hashed_index(slots, [parent_column, "_j"], "id")
    free = [c for c in child.columns if c != child_column and c not in child_key]
    drawn = independent_rows(child, free, numbered.select("id", F.col(parent_column).alias(child_column), "_j"), child_key, seed)
    made = {k: F.col("id") for k in child_key if k != child_column and len(child_key) == 1}
    made.update({k: F.col("_j") for k in child_key if k != child_column and len(child_key) > 1})
    out = drawn.withColumns({k: v.cast(child.schema[k].dataType) for k, v in made.items()}) if made else drawn
    return out.select(*child.columns)


def moved_keys(rows: DataFrame, column: str, parent: DataFrame, new_parent: DataFrame, parent_column: str, keys: list[str], seed: int = keyed.SEED) -> DataFrame:
    """A drawn foreign key moved to the new parents: an observed parent's share of the children goes to a new one.

    Observed and new parents are numbered; new parents beyond the observed number take turns.  No key is left without a
    parent, and a null stays null.  Which new parent an observed one gives way to at each turn is worked out on the parents,
    so the rows are joined once.
    """
    old = with_hashed_index(parent.select(F.col(parent_column).alias("_k")).where("_k IS NOT NULL").distinct(), ["_k"], "_at")
    new = with_hashed_index(new_parent.select(F.col(parent_column).alias("_new")).distinct(), ["_new"], "_at")
    n_old, n_new = old.count(), new.count()
    turns = max(1, -(-n_new // max(n_old, 1)))
    at = (F.col("_at") + F.lit(n_old) * F.col("_turn")) % F.lit(max(n_new, 1))
    taken = old.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(turns - 1).cast("bigint"))))
    taken = taken.select(F.col("_k").alias(column), "_turn", at.alias("_at")).join(new, "_at", "left").drop("_at")
    if turns == 1:
        placed = rows.join(taken.drop("_turn"), column, "left")
    else:
        turn = keyed.index_below(turns, f"turn:{column}", *[F.col(k) for k in keys], seed=seed)
        placed = rows.withColumn("_turn", turn).join(taken, [column, "_turn"], "left").drop("_turn")
    return placed.drop(column).withColumnRenamed("_new", column).select(*rows.columns)


def synthesize_tables(
    tables: dict[str, DataFrame], relationships: list[dict], keys: dict[str, list[str]], num_rows: int = 0, seed: int = keyed.SEED
) -> dict[str, DataFrame]:
    """New rows for every table, parents before children, over a list of relationships.

    A relationship names parent_table, parent_column, child_table and child_column.  All tables grow by num_rows over the
    rows of the largest, in whole numbers.  A child's first relationship gives its number of rows per parent; the keys of
    its other parents are drawn with its attributes and moved to the new parents.
    """
    scale = max(1, num_rows // max(1, *[t.count() for t in tables.values()]))
    made: dict[str, DataFrame] = {}
    for name in dependency_order(list(tables), relationships):
        own = [r for r in relationships if r["child_table"] == name and r["parent_table"] in made]
        if not own:
            made[name] = cut_lineage(synthesize_parents(tables[name], keys[name][0], scale, seed))
            continue
        first, *others = own
        rows = synthesize_children(
            made[first["parent_table"]], first["parent_column"], tables[first["parent_table"]], tables[name], first["child_column"], keys[name], seed
        )
        for r in others:
            rows = moved_keys(rows, r["child_column"], tables[r["parent_table"]], made[r["parent_table"]], r["parent_column"], keys[name], seed)
        made[name] = cut_lineage(rows)
    return made
