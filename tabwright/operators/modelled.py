"""Model-based comparison and concept drift with pyspark.ml, plus rare-event and manifold measures."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import distributions as dist
from tabwright.operators import drift
from tabwright.operators.indexing import with_global_index
from tabwright.operators.joins import fact_join
from tabwright.operators.nearest import nearest
from tabwright.operators.prep import encode_labels, fixed_sample, label_codes, prepare_features
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage

SEED = 42


def _row(df: DataFrame, schema: str, *values) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values)], schema)


def _vectors(df: DataFrame, features: list[str], target: Column) -> DataFrame:
    """(label, features, is_train); incomplete rows are left out."""
    kept = df.select(target.cast("double").alias("label"), *[dist.numeric(c).alias(c) for c in features], *([F.col("is_train")] if "is_train" in df.columns else []))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(kept.where("label IS NOT NULL"))


def _accuracy(model, test: DataFrame) -> float | None:
    r = model.transform(test).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).first()
    return r.a


def _r2(model, test: DataFrame) -> float | None:
    e = F.col("label") - F.col("prediction")
    r = model.transform(test).agg((F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))).alias("r")).first()
    return r.r


#: A column with the split, where the caller has drawn it already.
SPLIT = "_split_drawn"


def _split(keys: list[str]) -> Column:
    return keyed.uniform("split", *[F.col(k) for k in keys]) < 0.7


def _with_split(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("is_train", F.col(SPLIT) if SPLIT in df.columns else _split(keys))


def _class_codes(real: DataFrame, synthetic: DataFrame, target: str) -> DataFrame:
    """Codes of the classes both tables have, numbered over those alone."""
    return label_codes(real.join(synthetic.select(target).distinct(), target, "left_semi"), target)


# --- efficacy ---------------------------------------------------------------


def classification_efficacy(real: DataFrame, synthetic: DataFrame, target: str, features: list[str], keys: list[str], trees: int = 50, depth: int = 5) -> DataFrame | None:
    """One row: accuracy on the real 30 % after training on real rows, and after training on synthetic rows.

    None where the test does not apply: not 2-10 shared classes, fewer than two features or fifty rows.
    """
    codes = cut_lineage(_class_codes(real, synthetic, target))
    classes = codes.count()
    features = [f for f in features if f != target]
    if not 2 <= classes <= 10 or len(features) < 2:
        return None
    code = F.col(f"{target}_code")
    a = encode_labels(_with_split(real, keys), target, codes).where(code >= 0)
    b = encode_labels(synthetic, target, codes).where(code >= 0)
    rows = _vectors(a, features, code).cache()
    test = rows.where("NOT is_train")
    if rows.count() < 50:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)
    on_real = _accuracy(forest.fit(rows.where("is_train")), test)
    on_synthetic = _accuracy(forest.fit(_vectors(b, features, code)), test)
    rows.unpersist()
    return _efficacy_row(real, target, "classification", on_real, on_synthetic)


def _efficacy_row(df, target, task, on_real, on_synthetic):
    score = max(0.0, 1.0 - abs(on_real - on_synthetic))
    verdict = "EXCELLENT" if score >= 0.9 else "GOOD" if score >= 0.8 else "MODERATE"
    return _row(
        df, "target string, task string, trained_on_real double, trained_on_synthetic double, efficacy_score double, verdict string",
        target, task, on_real, on_synthetic, score, verdict,
    )


def regression_efficacy(
    real: DataFrame, synthetic: DataFrame, target: str, features: list[str], keys: list[str], trees: int = 50, depth: int = 5, fits: dict | None = None
) -> DataFrame | None:
    """The same with R2.  ``fits`` takes the forest on the synthetic rows, for a caller that needs it again."""
    features = [f for f in features if f != target]
    if len(features) < 2:
        return None
    rows = _vectors(_with_split(real, keys), features, dist.numeric(target)).cache()
    if rows.count() < 50:
        return None
    test = rows.where("NOT is_train")
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED)
    on_real = _r2(forest.fit(rows.where("is_train")), test)
    fitted = forest.fit(_vectors(synthetic, features, dist.numeric(target)))
    on_synthetic = _r2(fitted, test)
    rows.unpersist()
    if fits is not None:
        fits[(target, *features, trees, depth)] = fitted
    return _efficacy_row(real, target, "regression", on_real, on_synthetic)


def model_efficacy(
    real: DataFrame, synthetic: DataFrame, keys: list[str], targets: dict[str, str] | None = None, trees: int = 50, fits: dict | None = None
) -> tuple[DataFrame | None, float]:
    """(one row per tested target, their mean score); 0.5 where nothing can be tested.

    Without targets every text and every numeric column is tried.  ``fits``: see :func:`regression_efficacy`.
    """
    numbers = [c for c in dist.numeric_columns(real) if c not in keys]
    texts = [c for c in dist.categorical_columns(real) if c not in keys]
    if targets is None:
        targets = {c: "classification" for c in texts} | {c: "regression" for c in numbers}
    test = {"classification": classification_efficacy, "regression": partial(regression_efficacy, fits=fits)}
    rows = [test[task](real, synthetic, c, numbers, keys, trees) for c, task in targets.items()]
    rows = [r for r in rows if r is not None]
    if not rows:
        return None, 0.5
    table = reduce(DataFrame.unionByName, rows)
    return table, table.agg(F.avg("efficacy_score")).first()[0]


# --- importances ------------------------------------------------------------


def _ranks(values: list[float]) -> list[float]:
    order = sorted(range(len(values)), key=lambda i: values[i])
    out = [0.0] * len(values)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and values[order[j + 1]] == values[order[i]]:
            j += 1
        for k in range(i, j + 1):
            out[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return out


def _correlation(x: list[float], y: list[float]) -> float:
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    sxx, syy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    return sxy / (sxx * syy) ** 0.5 if sxx > 0 and syy > 0 else 0.0


def compare_importances(df: DataFrame, features: list[str], first: list[float], second: list[float], top: int) -> DataFrame:
    """One row from two vectors with one number per feature: rank correlation, cosine, top features."""
    rank = _correlation(_ranks(first), _ranks(second)) if len(features) > 1 else 0.0
    norm = (sum(a * a for a in first) * sum(b * b for b in second)) ** 0.5
    cosine = sum(a * b for a, b in zip(first, second)) / norm if norm > 0 else 0.0

    def best(values):
        return [features[i] for i in sorted(range(len(features)), key=lambda i: (-values[i], features[i]))[:top]]

    return _row(
        df, "rank_correlation double, cosine_similarity double, top_first array<string>, top_second array<string>",
        rank, cosine, best(first), best(second),
    )


def importance_preservation(
    real: DataFrame, synthetic: DataFrame, target: str, features: list[str], trees: int = 50, depth: int = 5, fits: dict | None = None
) -> DataFrame | None:
    """Importances of a forest on either table; classification up to ten distinct values.  Needs three features.

    A regression forest on the synthetic rows that is in ``fits`` already is not trained again.
    """
    features = [f for f in features if f != target]
    if len(features) < 3:
        return None
    text = target in dist.categorical_columns(real)
    few = text or real.agg(F.count_distinct(target)).first()[0] <= 10
    vectors = []
    if few:
        codes = cut_lineage(_class_codes(real, synthetic, target))
        code = F.col(f"{target}_code")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)
        vectors = [_vectors(encode_labels(t, target, codes).where(code >= 0), features, code) for t in (real, synthetic)]
    else:
        forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED)
        vectors = [_vectors(t, features, dist.numeric(target)) for t in (real, synthetic)]
    known = None if few else (fits or {}).get((target, *features, trees, depth))
    a, b = [(model or forest.fit(v)).featureImportances.toArray().tolist() for v, model in zip(vectors, (None, known))]
    return compare_importances(real, features, a, b, 3).withColumn("score", F.greatest(F.lit(0.0), F.col("rank_correlation")))


# --- rare events ------------------------------------------------------------


def outlier_preservation(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, rate_first, rate_second, score): rows outside the first table's 1.5 IQR fences."""
    q = dist.quantile_map(first, columns, [0.25, 0.75])
    fences = {c: (q[c][0.25] - 1.5 * (q[c][0.75] - q[c][0.25]), q[c][0.75] + 1.5 * (q[c][0.75] - q[c][0.25])) for c in columns}

    def rates(df, suffix):
        # A missing value is inside: comparisons with it are false.
        outside = {c: F.coalesce((dist.numeric(c) < fences[c][0]) | (dist.numeric(c) > fences[c][1]), F.lit(False)) for c in columns}
        row = df.agg(*[F.avg(outside[c].cast("double")).alias(f"r__{c}") for c in columns])
        return dist.stack_row(row, columns, ["r"]).withColumnRenamed("r", f"rate_{suffix}")

    both = rates(first, "first").join(F.broadcast(rates(second, "second")), "column_name")
    a, b = F.col("rate_first"), F.col("rate_second")
    score = F.when(a > 0, F.lit(1.0) - F.abs(a - b) / (a + 1e-10)).otherwise(F.when(b == 0, 1.0).otherwise(0.5))
    return both.withColumn("score", F.greatest(F.lit(0.0), score))


def rare_category_preservation(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, rare_values, kept, score): values at or below the 20 % quantile of frequencies, found again."""
    counts = dist.paired_counts(first, second, columns, "categorical").where("n_first > 0")
    # The percentile works on distinct counts, of which there are few.
    cut = counts.groupBy("column_name").agg(F.percentile("n_first", 0.2).alias("_cut"))
    rare = counts.join(F.broadcast(cut), "column_name").where("n_first <= _cut")
    return rare.groupBy("column_name").agg(
        F.count("*").alias("rare_values"), F.count_if(F.col("n_second") > 0).alias("kept"),
        (F.count_if(F.col("n_second") > 0) / F.count("*")).alias("score"),
    )


def rare_event_score(first: DataFrame, second: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row: the mean over the columns of either kind."""
    parts = []
    if numbers:
        parts.append(outlier_preservation(first, second, numbers).select("score"))
    if texts:
        parts.append(rare_category_preservation(first, second, texts).select("score"))
    return reduce(DataFrame.union, parts).agg(F.coalesce(F.avg("score"), F.lit(0.5)).alias("rare_event_score"))


# --- interactions and manifold (fixed samples, sizes are parameters) --------


def _sample_pairs(df: DataFrame, columns: list[str], keys: list[str], n: int) -> DataFrame:
    """Distances between the rows of a sample of at most n rows: (a, b, value) with a <> b.

    The sample is a parameter of the measure, not a share of the data, so its pairs are bounded.
    """
    complete = df.select(*keys, *[dist.numeric(c).alias(c) for c in columns]).dropna(subset=columns)
    # stored, as its pairs are read several times: else each reading would draw it from the whole table again
    picked = cut_lineage(fixed_sample(complete, n, keys))
    numbered = picked.withColumn("i", F.row_number().over(W.orderBy(*keys)))
    left = numbered.select(F.col("i").alias("a"), *[F.col(c).alias(f"_a__{c}") for c in columns])
    right = numbered.select(F.col("i").alias("b"), *[F.col(c).alias(f"_b__{c}") for c in columns])
    gap = reduce(lambda x, y: x + y, [F.pow(F.col(f"_a__{c}") - F.col(f"_b__{c}"), F.lit(2)) for c in columns])
    return left.join(F.broadcast(right), F.col("a") != F.col("b")).select("a", "b", F.sqrt(gap).alias("value"))


def interaction_preservation(first: DataFrame, second: DataFrame, columns: list[str], keys: list[str], n: int) -> DataFrame:
    """One row: 1 - KS between the pairwise distances of a triplet of columns in both samples."""
    a = _sample_pairs(first, columns, keys, n).where("a < b").select("value")
    b = _sample_pairs(second, columns, keys, n).where("a < b").select("value")
    counts = dist.paired_counts(a, b, ["value"], "numeric").withColumn("bucket", F.lit(0))
    return dist.ks_distance(counts).select("ks", (F.lit(1.0) - F.col("ks")).alias("score"))


def manifold_similarity(first: DataFrame, second: DataFrame, columns: list[str], keys: list[str], k: int = 10) -> DataFrame:
    """One row: Spearman correlation of the two curves of mean distances to the k nearest rows, floored at 0.

    All rows without missing values take part, scaled with the first table's means and population deviations.  A curve
    is its table's distances in ascending order; the shorter table's places are compared with the other's at the same share.
    """
    complete = [t.select(*keys, *[dist.numeric(c).alias(c) for c in columns]).dropna(subset=columns) for t in (first, second)]
    stats = complete[0].agg(*[x for c in columns for x in (F.avg(c).alias(f"_m__{c}"), F.stddev_pop(c).alias(f"_s__{c}"))])
    curves = []
    for t in complete:
        scaled = attach(t, stats).select(
            *[((F.col(c) - F.col(f"_m__{c}")) / F.when(F.col(f"_s__{c}") > 0, F.col(f"_s__{c}")).otherwise(1.0)).alias(c) for c in columns]
        )
        points = cut_lineage(scaled.withColumn("id", F.monotonically_increasing_id()))
        near = nearest(points, points, columns, k).where(F.size("distance") > 0)
        mean = F.round(F.aggregate("distance", F.lit(0.0), lambda x, y: x + y) / F.size("distance"), 12)
        placed = cut_lineage(with_global_index(cut_lineage(near.select(mean.alias("d"), "id")), ["d", "id"], "i"))
        # equal distances share the mean of their places
        ties = placed.groupBy("d").agg(((F.min("i") + F.max("i")) / 2.0 + 1).alias("rank"), F.count("*").alias("_n"))
        curves.append(cut_lineage(fact_join(placed.select("d", "i"), ties, ["d"], "_n").select("i", "rank")))
    sizes = [c.count() for c in curves]
    fewest = min(sizes)
    if fewest == 0:
        return first.sparkSession.createDataFrame([(0.0,)], "manifold_score double")
    places = first.sparkSession.range(fewest)
    for name, curve, size in zip("xy", curves, sizes):
        at = places.select("id", F.expr(f"(id * CAST({size} AS bigint)) div {fewest}").alias("i"))
        curve = at.join(curve, "i").select("id", F.col("rank").alias(name))
        joined = curve if name == "x" else joined.join(curve, "id")
    # a curve of equal distances, as of rows that all come many times, has no deviation and no correlation
    correlation = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return joined.agg(F.greatest(F.lit(0.0), F.coalesce(correlation, F.lit(0.0))).alias("manifold_score"))


# --- detectability and boundaries -------------------------------------------


def detectability(real: DataFrame, synthetic: DataFrame, features: list[str], keys: list[str], n: int = 500, trees: int = 50) -> DataFrame:
    """One row: can a forest tell balanced samples of the two tables apart?"""
    if len(features) < 2:
        return _row(real, "classifier_accuracy double, detectability_score double, verdict string", None, 0.5, "MODERATE")
    parts = []
    for label, t in ((0.0, real), (1.0, synthetic)):
        complete = t.select(*keys, *[dist.numeric(c).alias(c) for c in features]).dropna(subset=features)
        parts.append(_with_split(fixed_sample(complete, n, keys), [*keys]).withColumn("_label", F.lit(label)))
    rows = _vectors(parts[0].unionByName(parts[1]), features, F.col("_label")).cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=5, seed=SEED).fit(rows.where("is_train"))
    accuracy = _accuracy(model, rows.where("NOT is_train"))
    rows.unpersist()
    score = 1.0 - abs(accuracy - 0.5) * 2
    verdict = "EXCELLENT" if score >= 0.8 else "GOOD" if score >= 0.6 else "MODERATE" if score >= 0.4 else "WEAK"
    return _row(real, "classifier_accuracy double, detectability_score double, verdict string", accuracy, score, verdict)


def boundary_preservation(real: DataFrame, synthetic: DataFrame, target: str, features: list[str]) -> DataFrame | None:
    """One row: accuracy of a shallow tree trained on real rows, on real and on synthetic rows; 2-5 classes."""
    classes = real.agg(F.count_distinct(target)).first()[0]
    features = [f for f in features if f != target]
    if not 2 <= classes <= 5 or len(features) < 2:
        return None
    codes = cut_lineage(_class_codes(real, synthetic, target))
    if codes.count() < 2:
        return None
    code = F.col(f"{target}_code")
    a, b = [_vectors(encode_labels(t, target, codes).where(code >= 0), features, code).cache() for t in (real, synthetic)]
    model = DecisionTreeClassifier(maxDepth=3, seed=SEED).fit(a)
    on_real, on_synthetic = _accuracy(model, a), _accuracy(model, b)
    a.unpersist(), b.unpersist()
    return _row(
        real, "target string, real_accuracy double, synthetic_accuracy double, boundary_score double",
        target, on_real, on_synthetic, 1.0 - abs(on_real - on_synthetic),
    )


def novel_score(parts: list[float | None], df: DataFrame) -> DataFrame:
    """One row: the mean of the available parts, each clipped to [0, 1]."""
    kept = [max(0.0, min(1.0, p)) for p in parts if p is not None]
    return _row(df, "novel_score double, parts int", sum(kept) / len(kept) if kept else 0.5, len(kept))


def covering_triples(columns: list[str]) -> list[list[str]]:
    """Columns three by three in their order; what is left over is joined by the columns before it, so every column is in one."""
    if len(columns) < 3:
        return []
    return [columns[min(i, len(columns) - 3) :][:3] for i in range(0, len(columns), 3)]


def novel_report(
    real: DataFrame, synthetic: DataFrame, keys: list[str], trees: int = 50, triples: list[list[str]] | None = None, pair_rows: int = 100
) -> DataFrame:
    """One row of novel_score over every measure that applies.

    Interactions are those of the given triples of numeric columns (by default `covering_triples`), between ``pair_rows``
    sampled rows of either table.
    """
    numbers = [c for c in dist.numeric_columns(real) if c not in keys]
    texts = [c for c in dist.categorical_columns(real) if c not in keys]
    # Read many times below; a forest on the synthetic rows serves both measures that ask for it, and so does a draw.
    real, synthetic = [t.select(*keys, *numbers, *texts) for t in (real, synthetic)]
    real, synthetic = real.withColumn(SPLIT, _split(keys)).persist(), synthetic.persist()
    fits: dict = {}
    scores = [model_efficacy(real, synthetic, keys, trees=trees, fits=fits)[1]]
    kept = [importance_preservation(real, synthetic, c, numbers, trees, fits=fits) for c in numbers]
    kept = [k.first()["score"] for k in kept if k is not None]
    scores.append(sum(kept) / len(kept) if kept else 0.5)
    scores.append(rare_event_score(real, synthetic, numbers, texts).first()[0])
    triples = covering_triples(numbers) if triples is None else triples
    found = [interaction_preservation(real, synthetic, t, keys, pair_rows).first()["score"] for t in triples]
    scores.append(sum(found) / len(found) if found else 0.5)
    scores.append(detectability(real, synthetic, numbers, keys, trees=trees).first()["detectability_score"])
    tests = [boundary_preservation(real, synthetic, c, numbers) for c in texts]
    tests = [t.first()["boundary_score"] for t in tests if t is not None]
    scores.append(sum(tests) / len(tests) if tests else 0.5)
    scores.append(manifold_similarity(real, synthetic, numbers, keys).first()[0] if len(numbers) > 1 else 0.5)
    real.unpersist(), synthetic.unpersist()
    return novel_score(scores, real)


# --- concept drift ----------------------------------------------------------


def _encoded(baseline: DataFrame, snapshot: DataFrame, target: str, features: list[str]):
    """Both tables with numeric features and label; encoders are fitted on the baseline only."""
    base, snap = prepare_features(baseline, target), prepare_features(snapshot, target)
    texts = [c for c in features if c in dist.categorical_columns(baseline)]
    few = baseline.agg(F.count_distinct(target)).first()[0] <= 20
    for c in [*texts, *([target] if few else [])]:
        codes = cut_lineage(label_codes(base, c))
        base, snap = encode_labels(base, c, codes), encode_labels(snap, c, codes)
    names = [f"{c}_code" if c in texts else c for c in features]
    label = F.col(f"{target}_code") if few else dist.numeric(target)
    return base, snap, names, label, few


def prediction_drift(
    baseline: DataFrame, snapshot: DataFrame, target: str, features: list[str], keys: list[str], trees: int = 100, folds: int = 5, depth: int = 5
) -> DataFrame:
    """One row: cross-validated baseline score minus the score on the snapshot, and its alert."""
    base, snap, names, label, few = _encoded(baseline, snapshot, target, features)
    forest = (RandomForestClassifier if few else RandomForestRegressor)(numTrees=trees, maxDepth=depth, seed=SEED)
    score = _accuracy if few else _r2
    folded = base.withColumn("_fold", keyed.index_below(folds, "fold", *[F.col(k) for k in keys]))
    cells = folded.select(label.cast("double").alias("label"), *[dist.numeric(c).alias(c) for c in names], "_fold")
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(cells).select("label", "features", "_fold").cache()
    scores = [score(forest.fit(rows.where(F.col("_fold") != i)), rows.where(F.col("_fold") == i)) for i in range(folds)]
    scores = [s for s in scores if s is not None]
    before = sum(scores) / len(scores)
    after = score(forest.fit(rows), _vectors(snap, names, label))
    rows.unpersist()
    drop = before - after
    alert = "red" if drop > 0.15 else "yellow" if drop > 0.05 else "green"
    return _row(
        baseline, "task string, baseline_score double, snapshot_score double, score_drop double, drift_detected boolean, alert_level string",
        "classification" if few else "regression", before, after, drop, drop > 0.05, alert,
    )


def importance_shift(baseline: DataFrame, snapshot: DataFrame, target: str, features: list[str], trees: int = 100) -> DataFrame:
    """One row: how far the feature importances of two forests lie apart."""
    base, snap, names, label, few = _encoded(baseline, snapshot, target, features)
    forest = (RandomForestClassifier if few else RandomForestRegressor)(numTrees=trees, seed=SEED)
    kept = snap.where(label >= 0) if few else snap
    a = forest.fit(_vectors(base, names, label)).featureImportances.toArray().tolist()
    b = forest.fit(_vectors(kept, names, label)).featureImportances.toArray().tolist()
    row = compare_importances(baseline, features, a, b, 5)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("rank_correlation")))
    alert = F.when(F.col("importance_drift_score") > 0.4, "red").when(F.col("importance_drift_score") > 0.2, "yellow").otherwise("green")
    return row.withColumn("importance_drift_score", score).withColumn("alert_level", alert)


def concept_drift(
    baseline: DataFrame, snapshot: DataFrame, target: str, keys: list[str], features: list[str] | None = None, trees: int = 100, folds: int = 5
) -> DataFrame:
    """One row: 0.4 x prediction drop (doubled, at most 1) + 0.3 x importance shift + 0.3 x conditional shift."""
    for name, t in (("baseline", baseline), ("snapshot", snapshot)):
        if target not in t.columns:
            raise ValueError(f"target column {target!r} is not in the {name}")
        r = t.agg(F.count("*").alias("n"), F.count(target).alias("filled")).first()
        if r.filled == 0:
            raise ValueError(f"target column {target!r} is entirely null in the {name}")
        if r.n < 10:
            raise ValueError(f"the {name} needs at least 10 rows")
    features = features or [c for c in dist.common_columns(baseline, snapshot) if c != target and c not in keys and c in [*dist.numeric_columns(baseline), *dist.categorical_columns(baseline)]]
    p = prediction_drift(baseline, snapshot, target, features, keys, trees, folds).first()
    i = importance_shift(baseline, snapshot, target, features, trees).first()
    c = drift.conditional_overall(drift.conditional_features(drift.conditional_bins(baseline, snapshot, target, features))).first()
    overall = min(1.0, 0.4 * min(2 * max(0.0, p.score_drop), 1.0) + 0.3 * i.importance_drift_score + 0.3 * c.overall_score)
    detected = overall > 0.1 or "red" in (p.alert_level, i.alert_level)
    return _row(
        baseline,
        "target string, task string, overall_score double, drift_detected boolean, score_drop double, importance_drift_score double, conditional_score double",
        target, p.task, round(overall, 4), detected, p.score_drop, i.importance_drift_score, c.overall_score,
    )
