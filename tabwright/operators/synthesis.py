"""Synthetic tables: independent marginals, Gaussian copula, dependency tree, noisy marginals, oversampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import keyed
from tabwright.functions.special import normal_cdf, normal_quantile
from tabwright.operators import compare
from tabwright.operators import distributions as dist
from tabwright.operators.draws import bic, drawers
from tabwright.operators.drift import bin_index, quantile_edges
from tabwright.operators.indexing import expand_counts, with_global_index
from tabwright.operators.joins import fact_join
from tabwright.operators.logs import weighted_draw
from tabwright.operators.nearest import nearest
from tabwright.operators.prep import apply_conditions, apply_roles
from tabwright.operators.privacy import noisy_categories, perturb
from tabwright.operators.profile import profile, series_score
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage

SHORT_LIST = 50


# --- independent marginals --------------------------------------------------


def short_lists(df: DataFrame, columns: list[str], most: int = SHORT_LIST) -> dict[str, list[tuple[str | None, int]]]:
    """Value counts of the columns with few distinct values; at most columns x ``most`` rows on the driver."""
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    likely = [c for c in columns if row[c] <= most * 1.2]
    if not likely:
        return {}
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in likely])
    counts = wide.unpivot([], likely, "column_name", "value").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("p", F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))))
    found: dict[str, list] = {c: [] for c in likely}
    # One row past the limit is enough to see that a list is too long.
    for r in ranked.where(F.col("p") <= most + 1).orderBy("column_name", "p").collect():
        found[r.column_name].append((r.value, r.n))
    return {c: v for c, v in found.items() if v and len(v) <= most}


def marginal_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(child, given, value, n): how often each column has each value, as text; ``given`` is empty."""
    cells = F.array(*[F.struct(F.lit(c).alias("child"), F.lit("").alias("given"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("child", "given", "value").agg(F.count("*").alias("n"))


def independent_rows(df: DataFrame, columns: list[str], rows: DataFrame, keys: list[str], seed: int = keyed.SEED) -> DataFrame:
    """Add the columns to ``rows`` (which has ``id``), each drawn on its own from the observed values by their frequency."""
    if not columns:
        return rows
    found = drawers(marginal_counts(df, columns))
    out = rows
    for c in columns:
        u = keyed.uniform(f"draw:{c}", F.col("id"), seed=seed)
        out = found[c].draw(out, f"_drawn__{c}", u) if c in found else out.withColumn(f"_drawn__{c}", F.lit(None).cast("string"))
    cells = {c: F.col(f"_drawn__{c}").cast(df.schema[c].dataType) for c in columns}
    return out.withColumns(cells).drop(*[f"_drawn__{c}" for c in columns])


# --- Gaussian copula --------------------------------------------------------


class CopulaModel:
    def __init__(self, columns, factor, grids, nulls, whole):
        self.columns, self.factor, self.grids, self.nulls, self.whole = columns, factor, grids, nulls, whole


def nearest_factor(matrix: np.ndarray) -> np.ndarray:
    """Cholesky factor of a d x d correlation matrix, lifted to positive definite where rounding broke it."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    fixed = vectors @ np.diag(np.clip(values, 1e-9, None)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return np.linalg.cholesky(fixed / np.outer(scale, scale))


def normal_scores(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Every value replaced by the normal quantile of its average rank over n + 1."""
    ranks = cut_lineage(dist.average_ranks(df, columns))
    scores = ranks.select("column_name", "value", "n", normal_quantile(F.col("rank") / (F.col("total_n") + 1)).alias("score"))
    out = df.select(*key, *[dist.numeric(c).alias(c) for c in columns])
    for c in columns:
        part = scores.where(F.col("column_name") == c).select(F.col("value").alias(c), F.col("n").alias(f"_n__{c}"), F.col("score").alias(f"_z__{c}"))
        out = fact_join(out, part, [c], f"_n__{c}")
    return out.select(*key, *[F.col(f"_z__{c}").alias(c) for c in columns])


def fit_copula(df: DataFrame, columns: list[str], grid: int = 200) -> CopulaModel:
    """Correlation of normal scores plus a quantile grid per column; only d x d and d x grid numbers are collected."""
    d = len(columns)
    matrix = np.eye(d)
    for r in compare.pair_matrix(normal_scores(df, columns, []), columns).collect():
        matrix[columns.index(r.a), columns.index(r.b)] = 1.0 if r.a == r.b else (r.value or 0.0)
    grids = dist.quantile_grid(df, columns, grid)
    nulls = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    whole = {c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)}
    return CopulaModel(columns, nearest_factor(matrix), grids, nulls.asDict(), whole)


def sample_copula(model: CopulaModel, rows: DataFrame, seed: int = keyed.SEED) -> DataFrame:
    """Add the modelled columns to ``rows`` (which has ``id``): a narrow projection, no shuffle."""
    key = F.col("id")
    out = rows.withColumns({f"_e{i}": keyed.normal(f"copula:{c}", key, seed=seed) for i, c in enumerate(model.columns)})
    cells = {}
    for i, c in enumerate(model.columns):
        z = sum((F.lit(float(model.factor[i, j])) * F.col(f"_e{j}") for j in range(i + 1)), F.lit(0.0))
        grid = F.array(*[F.lit(float(v)) for v in model.grids[c]])
        steps = len(model.grids[c]) - 1
        spot = F.least(F.lit(1.0), F.greatest(F.lit(0.0), normal_cdf(z))) * steps
        low = F.least(F.floor(spot), F.lit(steps - 1)).cast("int")
        value = F.get(grid, low) + (spot - low) * (F.get(grid, low + 1) - F.get(grid, low))
        if c in model.whole:
            value = F.round(value).cast("bigint")
        share = model.nulls[c] or 0.0
        cells[c] = F.when(keyed.uniform(f"null:{c}", key, seed=seed) >= share, value) if share > 0 else value
    return out.withColumns(cells).drop(*[f"_e{i}" for i in range(len(model.columns))])


# --- dependency tree (Chow and Liu 1968) ------------------------------------


class TreeModel:
    def __init__(self, order, parents, drawers, edges, kinds):
        self.order, self.parents, self.drawers, self.edges, self.kinds = order, parents, drawers, edges, kinds


NULL_MARK = "\u0000null"


def _as_categories(df: DataFrame, columns: list[str], edges: dict[str, list[float]]) -> DataFrame:
    cells = []
    for c in columns:
        value = bin_index(dist.numeric(c), edges[c]).cast("string") if c in edges else F.col(c).cast("string")
        cells.append(F.coalesce(value, F.lit(NULL_MARK)).alias(c))
    return df.select(*cells)


def pair_counts(categories: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value_a, value_b, n) for all column pairs from one pass with a map-side sum."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("value_a"), F.col(b).alias("value_b")) for a, b in pairs])
    return categories.select(F.inline(cells)).groupBy("a", "b", "value_a", "value_b").agg(F.count("*").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(a, b, information) in nats, one row per pair of columns."""
    rows = counts.groupBy("a", "b", "value_a").agg(F.sum("n").alias("n_a"))
    cols = counts.groupBy("a", "b", "value_b").agg(F.sum("n").alias("n_b"))
    total = counts.groupBy("a", "b").agg(F.sum("n").alias("total"))
    joined = counts.join(rows, ["a", "b", "value_a"]).join(cols, ["a", "b", "value_b"]).join(F.broadcast(total), ["a", "b"])
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))
    return joined.groupBy("a", "b").agg(F.sum(term).alias("information"))


def spanning_tree(columns: list[str], weights: dict[tuple[str, str], float]) -> dict[str, str | None]:
    """Parent of each column in the heaviest spanning forest; a pair without a positive weight is no edge, so a column may have
    no parent.  The first column of each tree is its root; d nodes, on the driver."""
    parents: dict[str, str | None] = {columns[0]: None}
    while len(parents) < len(columns):
        best = max(
            ((weights.get((a, b), weights.get((b, a), 0.0)), a, b) for a in parents for b in columns if b not in parents),
            key=lambda x: (x[0], x[1], x[2]),
        )
        if best[0] > 0:
            parents[best[2]] = best[1]
        else:
            parents[next(c for c in columns if c not in parents)] = None
    return parents


def fit_tree(df: DataFrame, columns: list[str], bins: int = 5) -> TreeModel:
    """Numeric columns become quantile bins; texts keep all their categories.

    The weight of a pair is its mutual information less what as many cells explain by chance, so that a column of nearly
    unique texts does not pass for everyone's cause.
    """
    numbers = [c for c in columns if c in dist.numeric_columns(df)]
    edges = {c: e for c, e in (quantile_edges(df, numbers, bins) if numbers else {}).items() if len(e) > 1}
    table = cut_lineage(_as_categories(df, columns, edges))
    rows = table.count()
    if rows == 0:
        return TreeModel(columns, {c: None for c in columns}, {}, edges, {c: df.schema[c].dataType for c in columns})
    weights = {}
    if len(columns) > 1:
        counts = cut_lineage(pair_counts(table, columns))
        sides = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])
        sizes = {r.c: r.n for r in table.select(F.inline(sides)).distinct().groupBy("c").agg(F.count("*").alias("n")).collect()}
        weights = {(r.a, r.b): bic(r.information, rows, sizes[r.a], sizes[r.b]) for r in mutual_information(counts).collect()}
    parents = spanning_tree(columns, weights)
    cells = [F.struct(F.lit(c).alias("child"), (F.col(p) if p else F.lit("")).alias("given"), F.col(c).alias("value")) for c, p in parents.items()]
    found = drawers(table.select(F.inline(F.array(*cells))).groupBy("child", "given", "value").agg(F.count("*").alias("n")))
    return TreeModel(list(parents), parents, found, edges, {c: df.schema[c].dataType for c in columns})


def sample_tree(model: TreeModel, rows: DataFrame, seed: int = keyed.SEED) -> DataFrame:
    """Draw from the roots down: short conditional tables are expressions, long ones joins on (parent value, bucket)."""
    key = F.col("id")
    out = rows
    for c in model.order:
        parent, u = model.parents[c], keyed.uniform(f"tree:{c}", key, seed=seed)
        given = F.col(f"_k__{parent}") if parent else None
        drawer = model.drawers.get(c)
        out = drawer.draw(out, f"_k__{c}", u, given) if drawer else out.withColumn(f"_k__{c}", F.lit(None).cast("string"))
    cells = {}
    for c in model.order:
        category = F.when(F.col(f"_k__{c}") != NULL_MARK, F.col(f"_k__{c}"))
        if c in model.edges:
            grid = F.array(*[F.lit(float(e)) for e in model.edges[c]])
            i = category.cast("int")
            value = F.get(grid, i) + keyed.uniform(f"inside:{c}", key, seed=seed) * (F.get(grid, i + 1) - F.get(grid, i))
            whole = isinstance(model.kinds[c], T.IntegralType)
            cells[c] = (F.round(value) if whole else value).cast(model.kinds[c])
        else:
            cells[c] = category.cast(model.kinds[c])
    return out.withColumns(cells).drop(*[f"_k__{c}" for c in model.order])


# --- noisy marginals --------------------------------------------------------


def noisy_rows(df: DataFrame, columns: list[str], rows: DataFrame, epsilon: float, bins: int = dist.HISTOGRAM_BINS, seed: int = keyed.SEED) -> DataFrame:
    """Differentially private draws: noisy category shares, noisy histograms for numbers, budget split evenly.

    Text columns must have few values: publishing rare texts verbatim would break the guarantee.
    """
    per_column = epsilon / max(1, len(columns))
    numbers = [c for c in columns if c in dist.numeric_columns(df)]
    texts = [c for c in columns if c not in numbers]
    short = short_lists(df, texts) if texts else {}
    if set(short) != set(texts):
        raise ValueError(f"too many distinct values for a private draw: {sorted(set(texts) - set(short))}")
    key = F.col("id")
    cells = {}
    if texts:
        shares: dict[str, list] = {c: [] for c in texts}
        for r in noisy_categories(df, texts, per_column, seed).orderBy("column_name", "value").collect():
            shares[r.column_name].append((r.value, r.share))
        for c in texts:
            cells[c] = weighted_draw(shares[c], keyed.uniform(f"dp:{c}", key, seed=seed)).cast(df.schema[c].dataType)
    if numbers:
        summary = {r.column_name: r for r in dist.summarise(df, numbers).collect()}
        histogram = dist.joint_histogram(df, df.limit(0), numbers, bins)
        binned = histogram.select("column_name", "bin", F.greatest(F.lit(0.0), F.col("n_first") + keyed.laplace(1.0 / per_column, "dp-bin", F.col("column_name"), F.col("bin"), seed=seed)).alias("noisy"))
        weights: dict[str, list] = {c: [] for c in numbers}
        for r in binned.orderBy("column_name", "bin").collect():
            weights[r.column_name].append((str(r.bin), r.noisy))
        for c in numbers:
            low, width = summary[c].min, (summary[c].max - summary[c].min) / bins
            values = weights[c] if sum(w for _, w in weights[c]) > 0 else [(b, 1.0) for b, _ in weights[c]]
            i = weighted_draw(values, keyed.uniform(f"dp:{c}", key, seed=seed)).cast("int")
            value = F.lit(low) + (i + keyed.uniform(f"dp-in:{c}", key, seed=seed)) * width
            whole = isinstance(df.schema[c].dataType, T.IntegralType)
            cells[c] = (F.round(value) if whole else value).cast(df.schema[c].dataType)
    return rows.withColumns(cells)


# --- SMOTE ------------------------------------------------------------------

def nearest_neighbours(points: DataFrame, columns: list[str], k: int, group: str | None = None) -> DataFrame:
    """(id, near, distance): the exact k nearest other rows of each row, by Euclidean distance, ties by id.

    With ``group``, a number, only rows of the same group are neighbours; one search serves all groups.
    """
    named = points.select("id", *([group] if group else []), *columns)
    return nearest(named, named, columns, k, group)


def smote_plan(df: DataFrame, target: str, strategy: str) -> dict[str, int]:
    """Rows to add per class.  There are as many entries as classes."""
    sizes = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
    if not sizes:
        return {}
    most, fewest = max(sizes.values()), min(sizes.values())
    chosen = {
        "minority": [min(c for c, n in sizes.items() if n == fewest)],
        "not minority": [c for c, n in sizes.items() if n != fewest],
        "not majority": [c for c, n in sizes.items() if n != most],
        "auto": [c for c, n in sizes.items() if n != most],
        "all": list(sizes),
    }
    if strategy not in chosen:
        raise ValueError(f"unknown strategy: {strategy}")
    return {c: most - sizes[c] for c in chosen[strategy] if most > sizes[c]}


def new_rows_between(df: DataFrame, target: str, keys: list[str], strategy: str = "auto", k: int = 5, seed: int = keyed.SEED) -> DataFrame | None:
    """(class, number, copy, numeric columns): rows interpolated for small classes; None if no class needs any.

    ``number`` counts the rows of a class in the order of their key digests; copy ``j`` of row ``number`` lies between that
    row and a neighbour drawn from its k nearest of the same class.  One search covers all classes.
    """
    plan = smote_plan(df, target, strategy)
    numbers = [c for c in dist.numeric_columns(df) if c not in keys and c != target]
    if not plan or not numbers:
        return None
    sizes = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
    k = min(k, min(sizes.values()) - 1)
    if k < 1:
        return None
    # as many rows as classes
    entries = [(str(c), i, sizes[c], extra) for i, (c, extra) in enumerate(sorted(plan.items(), key=lambda e: str(e[0])))]
    classes = df.sparkSession.createDataFrame(entries, "class string, _class bigint, _size bigint, _extra bigint")
    members = df.withColumn("class", F.col(target).cast("string")).join(F.broadcast(classes), "class")
    digest = F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), 256), 1, 3)
    values = [F.coalesce(dist.numeric(c), F.lit(0.0)).alias(f"_x__{c}") for c in numbers]
    base = members.select("class", "_class", "_size", "_extra", digest.alias("_digits"), *[F.col(c).alias(f"_k__{c}") for c in keys], *values)
    base = cut_lineage(with_global_index(cut_lineage(base), ["_class", "_digits", *[f"_k__{c}" for c in keys]], "id"))
    starts = base.groupBy("_class").agg(F.min("id").alias("_start"))
    base = cut_lineage(base.join(F.broadcast(starts), "_class").withColumn("number", F.col("id") - F.col("_start")))
    coordinates = [f"_x__{c}" for c in numbers]
    near = nearest_neighbours(base, coordinates, k, "_class").select("id", "near")
    per = F.expr("_extra div _size + CAST(number < _extra % _size AS int)")
    slots = expand_counts(base.select("id", "class", "number", *coordinates, per.alias("_m")), "_m", "copy").join(near, "id")
    row = [F.col("class"), F.col("number"), F.col("copy")]
    spot = keyed.index_below(F.size("near"), "smote", *row, seed=seed).cast("int")
    chosen = slots.withColumn("_n", F.get("near", spot)).withColumn("_u", keyed.uniform("smote-u", *row, seed=seed))
    made = chosen.join(base.select(F.col("id").alias("_n"), *[F.col(c).alias(f"_to{c}") for c in coordinates]), "_n")
    between = [(F.col(x) + F.col("_u") * (F.col(f"_to{x}") - F.col(x))).alias(c) for x, c in zip(coordinates, numbers)]
    return made.select("class", "number", "copy", *between)


def smote(df: DataFrame, target: str, keys: list[str], strategy: str = "auto", k: int = 5, seed: int = keyed.SEED) -> DataFrame:
    """The table plus interpolated rows for small classes; ``is_synthetic`` marks the new ones.

    A new row lies between a row and one of its k nearest neighbours of the same class; each of its non-numeric values is
    that of a row of its class at a drawn place, and the originals are left alone.
    """
    marked = df.withColumn("is_synthetic", F.lit(False))
    made = new_rows_between(df, target, keys, strategy, k, seed)
    if made is None:
        return marked
    numbers = [c for c in made.columns if c not in ("class", "number", "copy")]
    others = [c for c in df.columns if c not in numbers and c != target and c not in keys]
    made = cut_lineage(made.select("class", "number", "copy", *[F.col(c).alias(f"_v__{c}") for c in numbers]))
    if others:
        donors = df.where(F.col(target).isNotNull()).select(
            F.col(target).cast("string").alias("_class"), *[F.col(c).alias(f"_k__{c}") for c in keys], *[F.col(c).alias(f"_o__{c}") for c in others]
        )
        wanted = donors.join(F.broadcast(made.select(F.col("class").alias("_class")).distinct()), "_class")
        donors = cut_lineage(with_global_index(cut_lineage(wanted), ["_class", *[f"_k__{c}" for c in keys]], "_at"))
        spans = donors.groupBy("_class").agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
        made = made.join(F.broadcast(spans.withColumnRenamed("_class", "class")), "class")
        for c in others:  # an equi-join on evenly spread row numbers
            place = F.col("_start") + keyed.index_below(F.col("_rows"), f"smote:{c}", F.col("class"), F.col("number"), F.col("copy"), seed=seed)
            made = made.withColumn("_at", place).join(donors.select("_at", f"_o__{c}"), "_at").drop("_at")
    cells = {}
    for c in df.columns:
        kind = df.schema[c].dataType
        if c == target:
            value = F.col("class")
        elif c in keys:
            value = F.lit(None)
        elif c in numbers:
            value = F.round(f"_v__{c}") if isinstance(kind, T.IntegralType) else F.col(f"_v__{c}")
        else:
            value = F.col(f"_o__{c}")
        cells[c] = value.cast(kind).alias(c)
    return marked.unionByName(made.select(*cells.values(), F.lit(True).alias("is_synthetic")))


# --- the whole run ----------------------------------------------------------


def choose_model(profiled: list, series: float) -> str:
    """Which synthesiser suits a profiled table: the rules read one row per column."""
    rows = profiled[0]["rows"] if profiled else 0
    texts = sum(1 for p in profiled if p["tag"] == "categorical")
    numbers = len(profiled) - texts
    if series > 0.5:
        return "series"
    if texts > numbers:
        return "tree"
    return "copula" if numbers else ("tree" if rows else "marginals")


def synthesize_table(
    df: DataFrame,
    keys: list[str],
    n: int,
    model: str | None = None,
    roles: dict[str, str] | None = None,
    conditions: list[dict] | None = None,
    epsilon: float | None = None,
    target: str | None = None,
    order_column: str | None = None,
    seed: int = keyed.SEED,
) -> DataFrame:
    """Roles, noise, choice, fit, draw, oversampling, conditions: one lazy table with ``id`` and the kept columns."""
    source = apply_roles(df, roles or {})
    numbers = [c for c in dist.numeric_columns(source) if c not in keys]
    if epsilon is not None:
        source = perturb(source, numbers, keys, epsilon, seed=seed)
    columns = [c for c in source.columns if c not in keys]
    if model is None:
        rows = [r.asDict() for r in profile(source.select(*columns)).collect()]
        score = series_score(source, order_column, order_column).first()["score"] if order_column else 0.0
        model = choose_model(rows, score)
    rows = df.sparkSession.range(n)
    if model == "copula":
        made = sample_copula(fit_copula(source, numbers), rows, seed)
        rest = [c for c in columns if c not in numbers]
    elif model == "tree":
        fitted = fit_tree(source, columns)
        made = sample_tree(fitted, rows, seed)
        rest = [c for c in columns if c not in fitted.order]
    else:
        made, rest = rows, columns
    if rest:
        made = independent_rows(source, rest, made, keys, seed)
    made = made.select("id", *columns)
    if target is not None:
        made = smote(made, target, ["id"], seed=seed).drop("is_synthetic")
    return apply_conditions(made, conditions or [])

