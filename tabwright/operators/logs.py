"""Log lines: format detection, parsing, field distributions, and new lines with the same distributions."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import keyed
from tabwright.functions.log_formats import ACCESS, ACCESS_USER, APPLICATION, LEADING_TIMESTAMP, SYSLOG, TRIED
from tabwright.operators.distributions import bucket_count
from tabwright.operators.indexing import expand_counts, with_running_sum
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage

TOP_VALUES = 50


# --- detection and parsing --------------------------------------------------


def is_json(line: Column) -> Column:
    """Is the text a JSON object?  ``try_parse_json`` gives null where it does not parse; other values are no records."""
    return line.rlike(r"^\s*\{") & F.try_parse_json(line).isNotNull()


def detect_format(lines: DataFrame, order: list[str], first: int | None = None) -> DataFrame:
    """One row with the format that more than half of the non-blank lines have; of the first so many, if asked."""
    head = lines.where(F.col("line").rlike(r"\S"))
    head = head if first is None else head.orderBy(*order).limit(first)
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")) > 0.5, F.lit(False))
    stats = head.agg(
        F.count("*").alias("n"),
        share(is_json(F.col("line"))).alias("json"),
        share(F.size(F.split("line", ",")) >= 3).alias("csv"),
        *[F.avg(F.col("line").rlike(p).cast("double")).alias(name) for name, p in TRIED],
    )
    verdict = F.when(F.col("n") == 0, "unknown").when(F.col("json"), "json")
    for name, _ in TRIED:
        verdict = verdict.when(F.col(name) > 0.5, name)
    return stats.select(verdict.when(F.col("csv"), "csv").otherwise("unknown").alias("format"), F.col("n").alias("lines_read"))


def _group(pattern: str, i: int) -> Column:
    return F.regexp_extract("line", pattern, i)


def parse_access(lines: DataFrame) -> DataFrame:
    """ip, user, timestamp, method, path, status, size of lines in the common access format; others are dropped."""
    kept = [c for c in lines.columns if c != "line"]
    size = _group(ACCESS, 6)
    return lines.where(F.col("line").rlike(ACCESS)).select(
        *kept,
        _group(ACCESS, 1).alias("ip"),
        _group(ACCESS_USER, 2).alias("user"),
        _group(ACCESS, 2).alias("timestamp"),
        _group(ACCESS, 3).alias("method"),
        _group(ACCESS, 4).alias("path"),
        _group(ACCESS, 5).cast("int").alias("status"),
        F.when(size == "-", F.lit(0)).otherwise(size.try_cast("bigint")).cast("bigint").alias("size"),
    )


def parse_syslog(lines: DataFrame) -> DataFrame:
    kept = [c for c in lines.columns if c != "line"]
    names = ["timestamp", "hostname", "process", "pid", "message"]
    return lines.where(F.col("line").rlike(SYSLOG)).select(*kept, *[_group(SYSLOG, i + 1).alias(n) for i, n in enumerate(names)])


def parse_application(lines: DataFrame) -> DataFrame:
    kept = [c for c in lines.columns if c != "line"]
    names = ["timestamp", "level", "component", "message"]
    return lines.where(F.col("line").rlike(APPLICATION)).select(
        *kept, *[_group(APPLICATION, i + 1).alias(n) for i, n in enumerate(names)]
    )


def parse_json(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """JSON objects by schema; lines that do not parse are dropped."""
    kept = [c for c in lines.columns if c != "line"]
    record = F.from_json("line", schema)
    return lines.where(is_json(F.col("line"))).select(*kept, record.alias("_r")).select(*kept, "_r.*")


def parse_csv(lines: DataFrame, header: list[str], order: list[str]) -> DataFrame:
    """Comma-separated lines by a known header, quotes respected; the first line is dropped if it is that header."""
    kept = [c for c in lines.columns if c != "line"]
    schema = ", ".join(f"`{h}` string" for h in header)
    top = lines.agg(F.min(F.struct(*order)).alias("_top"))
    is_first = F.struct(*order) == F.col("_top")
    rows = attach(lines, top).where(~(F.coalesce(is_first, F.lit(False)) & (F.col("line") == ",".join(header))))
    return rows.select(*kept, F.from_csv("line", schema).alias("_r")).select(*kept, "_r.*")


def parse_any(lines: DataFrame) -> DataFrame:
    """Lines of no known format become messages."""
    return lines.withColumnRenamed("line", "message")


def parse_counts(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(pattern)).alias("parsed"))


# --- field distributions ----------------------------------------------------


def field_values(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value): every non-null field value as text."""
    wide = records.select(*[F.col(f).cast("string").alias(f) for f in fields])
    return wide.unpivot([], fields, "field", "value").where(F.col("value").isNotNull())


def field_kind(records: DataFrame, field: str) -> str:
    kind = records.schema[field].dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    return "float" if isinstance(kind, T.NumericType) else "string"


def value_counts(records: DataFrame, fields: list[str]) -> DataFrame:
    return field_values(records, fields).groupBy("field", "value").agg(F.count("*").alias("n"))


def top_values(records: DataFrame, fields: list[str], k: int = TOP_VALUES) -> DataFrame:
    """(field, position, value, n): the k commonest values of each field, ties in value order.

    Each task first keeps its own best k of a field's counted values by a hash slice, so the final ranking of a
    field sees at most k rows per slice, however many distinct values there are.
    """
    counts = value_counts(records, fields)
    order = [F.desc("n"), F.col("value")]
    slices = max(64, bucket_count(records))
    sliced = counts.withColumn("_slice", F.pmod(F.xxhash64("value"), F.lit(slices)))
    local = sliced.withColumn("_p", F.row_number().over(W.partitionBy("field", "_slice").orderBy(*order))).where(F.col("_p") <= k)
    ranked = local.withColumn("position", F.row_number().over(W.partitionBy("field").orderBy(*order)))
    return ranked.where(F.col("position") <= k).select("field", "position", "value", "n")


def field_summary(records: DataFrame, fields: list[str], counted: DataFrame | None = None) -> DataFrame:
    """(field, kind, total, distinct_values, low, high, mean); the range for numeric fields only."""
    kinds = {f: field_kind(records, f) for f in fields}
    counted = value_counts(records, fields) if counted is None else counted
    counts = counted.groupBy("field").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))
    numbers = [f for f in fields if kinds[f] in ("integer", "float")]
    lookup = records.sparkSession.createDataFrame(list(kinds.items()), "field string, kind string")
    out = counts.join(F.broadcast(lookup), "field")  # one row per field
    if numbers:
        row = records.agg(*[x for f in numbers for x in (F.min(f).cast("double").alias(f"low__{f}"), F.max(f).cast("double").alias(f"high__{f}"), F.avg(f).alias(f"mean__{f}"))])
        entries = [F.struct(F.lit(f).alias("field"), *[F.col(f"{m}__{f}").alias(m) for m in ("low", "high", "mean")]) for f in numbers]
        out = out.join(F.broadcast(row.select(F.inline(F.array(*entries)))), "field", "left")
    else:
        out = out.withColumns({m: F.lit(None).cast("double") for m in ("low", "high", "mean")})
    return out.select("field", "kind", "total", "distinct_values", "low", "high", "mean")


def field_report(records: DataFrame, fields: list[str], k: int = 5) -> DataFrame:
    """(field, distinct_values, top): the top values as a list."""
    top = top_values(records, fields, k).groupBy("field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("top")
    )
    return field_summary(records, fields).select("field", "distinct_values").join(F.broadcast(top), "field")


# --- draws ------------------------------------------------------------------


class FieldModel:
    """What a generator needs of one field: its weighted values, and the range of a numeric field.

    A short list is kept as it is.  Where there are more values, ``donors(_start, n, value)`` gives each its stretch of the
    numbers from 0 to ``total``, as long as the value is frequent and commonest first; a draw is a join on the number, so no
    value is left out.
    """

    def __init__(self, kind: str, values: list[tuple[str, int]], low=None, high=None, mean=None, donors: DataFrame | None = None, total: int = 0):
        self.kind, self.values, self.low, self.high, self.mean = kind, values, low, high, mean
        self.donors, self.total = donors, total

    def only(self, condition: str) -> FieldModel | None:
        """The values that fit a SQL condition on ``value``; None if none does."""
        if self.donors is None:
            spark = SparkSession.active()
            rows = spark.createDataFrame(list(enumerate(self.values)), "_at int, v struct<value:string,n:bigint>").select("_at", "v.*")
            kept = [(r.value, r.n) for r in rows.where(condition).orderBy("_at").collect()]  # of a short list
            return FieldModel(self.kind, kept) if kept else None
        ends = with_running_sum(self.donors.where(condition), ["_start"], "n", "_end")
        donors = cut_lineage(ends.select((F.col("_end") - F.col("n")).alias("_start"), "n", "value"))
        total = donors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return FieldModel(self.kind, [], donors=donors, total=total) if total else None


def fit_fields(records: DataFrame, fields: list[str], k: int = TOP_VALUES) -> dict[str, FieldModel]:
    """Fit the generators; lists of at most k values reach the driver, longer ones stay tables."""
    counts = cut_lineage(value_counts(records, fields))
    summary = {r.field: r for r in field_summary(records, fields, counts).collect()}
    short = [f for f, r in summary.items() if r.distinct_values <= k]
    long = [f for f, r in summary.items() if r.distinct_values > k]
    listed: dict[str, list] = {f: [] for f in short}
    for r in counts.where(F.col("field").isin(short)).orderBy("field", F.desc("n"), "value").collect():
        listed[r.field].append((r.value, r.n))
    models = {f: FieldModel(summary[f].kind, listed[f], summary[f].low, summary[f].high, summary[f].mean) for f in short}
    if long:
        weighed = counts.where(F.col("field").isin(long)).withColumn("_less", -F.col("n"))
        ends = with_running_sum(weighed, ["field", "_less", "value"], "n", "_end")
        every = cut_lineage(ends.select("field", (F.col("_end") - F.col("n")).alias("_start"), "n", "value"))
        starts = {r.field: r.start for r in every.groupBy("field").agg(F.min("_start").alias("start")).collect()}  # one row per field
        for f in long:
            donors = every.where(F.col("field") == f).select((F.col("_start") - starts[f]).alias("_start"), "n", "value")
            models[f] = FieldModel(summary[f].kind, [], summary[f].low, summary[f].high, summary[f].mean, donors, summary[f].total)
    return models


def _drawn(tag: str) -> str:
    return "_drawn_" + tag.replace(":", "_")


#: Stretches that every task may hold beside its rows.
HELD = 20_000


def _stretches(model: FieldModel) -> tuple[DataFrame, int]:
    """(_bucket, _low, _high, value) and the width of a bucket: the numbers are cut into as many buckets as there are values.

    A stretch is listed in every bucket it reaches, so there are at most twice as many rows as values, and a number meets
    two of them or so.  Few are broadcast; many are dealt by bucket, of which none is drawn more than others.
    """
    rows = model.donors.count()
    width = max(1, -(-model.total // max(1, rows)))
    low, high = F.col("_start"), F.col("_start") + F.col("n")
    first, last = F.floor(low / width).cast("bigint"), F.floor((high - 1) / width).cast("bigint")
    parts = model.donors.select(low.alias("_low"), high.alias("_high"), "value", first.alias("_first"), (last - first + 1).alias("_parts"))
    spans = expand_counts(parts, "_parts", "_p").select((F.col("_first") + F.col("_p")).alias("_bucket"), "_low", "_high", "value")
    return (F.broadcast(spans) if rows <= HELD else spans), width


def with_draws(rows: DataFrame, wanted: dict[str, FieldModel | None], seed: int = keyed.SEED, key: str = "id") -> DataFrame:
    """Join the draws, named by their tags, of those models that have donors; :func:`draw` finds them."""
    for tag, model in wanted.items():
        if model is not None and model.donors is not None:
            at = F.floor(keyed.uniform(tag, F.col(key), seed=seed) * F.lit(model.total)).cast("bigint")
            spans, width = _stretches(model)
            asked = keyed.with_drawn(rows, _at=at).withColumn("_bucket", F.floor(F.col("_at") / width).cast("bigint"))
            hit = (F.col("r._bucket") == F.col("v._bucket")) & (F.col("r._at") >= F.col("v._low")) & (F.col("r._at") < F.col("v._high"))
            joined = asked.alias("r").join(spans.alias("v"), hit, "left")
            rows = joined.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], F.col("v.value").alias(_drawn(tag)))
    return rows


def _text_literal(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Entries up to which all are searched.
FEW = 8


def weighted_draw(values: list[tuple[str, int]], u: Column) -> Column:
    """One of a short list of values by weight: the first whose cumulative share exceeds u.

    The list is one folded literal, and u is bound once before the search: written inside the search's lambda it
    would be hashed again for every entry.  More than a few entries are cut into as many cells of u, and one cell is searched.
    """
    total = sum(n for _, n in values)
    running, highs, steps = 0, [], []
    for i, (value, n) in enumerate(values):
        running += n
        highs.append(1.0 if i == len(values) - 1 else running / total)
        steps.append(f"named_struct('hi', {highs[-1]!r}D, 'value', {_text_literal(value)})")
    if len(steps) <= FEW:
        table = F.expr(f"array({', '.join(steps)})")
        found = F.transform(F.array(u), lambda x: F.get(F.filter(table, lambda s: x < s["hi"]), F.lit(0))["value"])
        return F.get(found, F.lit(0))
    # each cell of u lists what its numbers can take; its bounds are a little wider, so that rounding does not count
    cells = []
    for i in range(len(steps)):
        low, high = bisect_right(highs, i / len(steps) * (1 - 1e-12)), bisect_right(highs, (i + 1) / len(steps) * (1 + 1e-12))
        cells.append(f"array({', '.join(steps[low : high + 1])})")
    table = F.expr(f"array({', '.join(cells)})")

    def search(x):
        cell = F.get(table, F.floor(x * len(steps)).cast("int"))
        return F.get(F.filter(cell, lambda s: x < s["hi"]), F.lit(0))["value"]

    return F.get(F.transform(F.array(u), search), F.lit(0))


def draw(model: FieldModel, tag: str, *keys: Column, seed: int = keyed.SEED) -> Column:
    """One of the model's values by weight; where it has donors, what :func:`with_draws` joined."""
    if model.donors is not None:
        return F.col(_drawn(tag))
    return weighted_draw(model.values, keyed.uniform(tag, *keys, seed=seed))


def numeric_draw(model: FieldModel, tag: str, *keys: Column, seed: int = keyed.SEED) -> Column:
    """Seven times in ten an observed value, else a Gaussian around the mean kept inside the observed range."""
    low, high = float(model.low), float(model.high)
    spread = (high - low) / 4 if high > low else 1.0
    gauss = F.least(F.lit(high), F.greatest(F.lit(low), F.lit(float(model.mean)) + F.lit(spread) * keyed.normal(tag + ":g", *keys, seed=seed)))
    observed = draw(model, tag + ":v", *keys, seed=seed).try_cast("double")
    return F.when(keyed.uniform(tag + ":m", *keys, seed=seed) < 0.7, F.coalesce(observed, gauss)).otherwise(gauss)


def typed_draw(model: FieldModel, tag: str, *keys: Column, seed: int = keyed.SEED) -> Column:
    if model.kind == "boolean":
        return F.lower(draw(model, tag, *keys, seed=seed)).isin("true", "1", "yes")
    if model.kind == "integer":
        return F.round(numeric_draw(model, tag, *keys, seed=seed)).cast("bigint")
    if model.kind == "float":
        return F.round(numeric_draw(model, tag, *keys, seed=seed), 2)
    return draw(model, tag, *keys, seed=seed)


def spread_times(df: DataFrame, end, hours: int, seed: int = keyed.SEED, key: str = "id") -> DataFrame:
    """Add ``ts``, uniform over the hours before ``end``."""
    end = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
    micros = F.unix_micros(end) - F.floor(keyed.uniform("log-ts", F.col(key), seed=seed) * F.lit(hours * 3_600_000_000)).cast("bigint")
    return df.withColumn("ts", F.timestamp_micros(micros))


def _time_and_order(rows: DataFrame, line: Column, ordered: bool) -> DataFrame:
    """Lines in the order of time; the rows are sorted first, as a sort reads twice what it is given, draws and all."""
    return (rows.orderBy("ts", "id") if ordered else rows).select("id", "ts", line.alias("line"))


def make_rows(spark, n: int, end, hours: int, seed: int = keyed.SEED) -> DataFrame:
    return spread_times(spark.range(n), end, hours, seed)


def error_statuses(model: FieldModel | None) -> FieldModel:
    observed = model.only("value RLIKE '^[0-9]+$' AND try_cast(value AS int) >= 400") if model else None
    return observed or FieldModel("integer", [("400", 1), ("404", 1), ("500", 1)])


def access_lines(rows: DataFrame, models: dict[str, FieldModel], error_rate: float, seed: int = keyed.SEED, ordered: bool = True) -> DataFrame:
    """(id, ts, line): access-log lines; good statuses turn into observed errors at the given rate."""
    key = F.col("id")
    errors = error_statuses(models.get("status"))
    rows = with_draws(rows, {**models, "size:v": models.get("size"), "error": errors}, seed)

    def field(name, default):
        return draw(models[name], name, key, seed=seed) if name in models else F.lit(default)

    status = field("status", "200").try_cast("int")
    flips = (keyed.uniform("flip", key, seed=seed) < error_rate) & (status < 400)
    broken = draw(errors, "error", key, seed=seed).cast("int")
    if "size" in models:
        size = F.greatest(F.lit(0), F.round(numeric_draw(models["size"], "size", key, seed=seed)).cast("bigint"))
    else:
        size = keyed.index_below(49_969, "size", key, seed=seed) + 32
    line = F.concat(
        field("ip", "127.0.0.1"), F.lit(" - "), field("user", "-"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "'), field("method", "GET"), F.lit(" "), field("path", "/api/health"), F.lit(' HTTP/1.1" '),
        F.when(flips, broken).otherwise(status).cast("string"), F.lit(" "), size.cast("string"),
    )
    return _time_and_order(rows, line, ordered)


def syslog_lines(rows: DataFrame, models: dict[str, FieldModel], seed: int = keyed.SEED, ordered: bool = True) -> DataFrame:
    key = F.col("id")
    rows = with_draws(rows, models, seed)

    def field(name, default):
        return draw(models[name], name, key, seed=seed) if name in models else F.lit(default)

    spare = (keyed.index_below(64_001, "pid", key, seed=seed) + 1000).cast("string")
    pid = F.coalesce(F.when(field("pid", "").try_cast("int").isNotNull(), field("pid", "")), spare)
    line = F.concat(
        F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), field("hostname", "localhost"), F.lit(" "), field("process", "app"),
        F.lit("["), pid, F.lit("]: "), field("message", "service started"),
    )
    return _time_and_order(rows, line, ordered)


def severe_levels(models: dict[str, FieldModel]) -> FieldModel:
    observed = models["level"].only("value IN ('ERROR', 'FATAL')") if "level" in models else None
    return observed or FieldModel("string", [("ERROR", 1)])


def raised_level(models: dict[str, FieldModel], severe: FieldModel, error_rate: float, key: Column, seed: int) -> Column:
    """A drawn level, raised to an observed ERROR or FATAL at the error rate."""
    hit = keyed.uniform("raise", key, seed=seed) < error_rate
    if "level" not in models:
        return F.when(hit, "ERROR").otherwise("INFO")
    level = draw(models["level"], "level", key, seed=seed)
    level = F.when(level == "WARNING", "WARN").otherwise(level)
    raised = draw(severe, "severity", key, seed=seed)
    return F.when(hit & ~level.isin("ERROR", "FATAL"), raised).otherwise(level)


def application_lines(rows: DataFrame, models: dict[str, FieldModel], error_rate: float, seed: int = keyed.SEED, ordered: bool = True) -> DataFrame:
    key = F.col("id")
    severe = severe_levels(models)
    rows = with_draws(rows, {**models, "severity": severe}, seed)

    def field(name, default):
        return draw(models[name], name, key, seed=seed) if name in models else F.lit(default)

    level = raised_level(models, severe, error_rate, key, seed)
    padded = F.when(F.length(level) < 5, F.rpad(level, 5, " ")).otherwise(level)
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), padded, F.lit(" ["), field("component", "app"), F.lit("] "),
        field("message", "operation completed"),
    )
    return _time_and_order(rows, line, ordered)


def key_sets(records: DataFrame, fields: list[str]) -> DataFrame:
    """(keys, n): which fields occur together in a record; as many rows as there are shapes of records."""
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    return records.groupBy(present.alias("keys")).agg(F.count("*").alias("n"))


def json_lines(
    rows: DataFrame, records: DataFrame, fields: list[str], models: dict[str, FieldModel], error_rate: float, seed: int = keyed.SEED, ordered: bool = True
) -> DataFrame:
    """JSON lines: the key set of a drawn record shape, a typed draw per key, time and level set afresh."""
    key = F.col("id")
    severe = severe_levels(models)
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    shapes = fit_fields(records.select(F.array_join(present, ",").alias("shape")), ["shape"])["shape"]
    # the time is set afresh, so no observed one is drawn
    wanted = {f: m for f, m in models.items() if m.kind not in ("integer", "float") and f != "timestamp"}
    wanted |= {f"{f}:v": m for f, m in models.items() if m.kind in ("integer", "float")}
    rows = with_draws(rows, {**wanted, "shape": shapes, "severity": severe}, seed)
    shaped = rows.withColumn("_keys", F.split(draw(shapes, "shape", key, seed=seed), ","))
    cells = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")]
    has_level = F.array_contains("_keys", "level") if "level" not in models else F.lit(True)
    if "level" in fields:
        cells.append(F.when(has_level, raised_level(models, severe, error_rate, key, seed)).alias("level"))
    for f in fields:
        if f not in ("timestamp", "level") and f in models:
            cells.append(F.when(F.array_contains("_keys", f), typed_draw(models[f], f, key, seed=seed)).alias(f))
    return _time_and_order(shaped, F.to_json(F.struct(*cells)), ordered)


def generic_lines(rows: DataFrame, models: dict[str, FieldModel], seed: int = keyed.SEED, ordered: bool = True) -> DataFrame:
    """Drawn messages with a leading timestamp, if any, replaced by the new one."""
    rows = with_draws(rows, {"message": models["message"]}, seed)
    message = draw(models["message"], "message", F.col("id"), seed=seed)
    line = F.regexp_replace(message, F.lit(LEADING_TIMESTAMP), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _time_and_order(rows, line, ordered)


def parse(lines: DataFrame, fmt: str, **options) -> DataFrame:
    """Parse by format name."""
    if fmt in ("apache", "nginx"):
        return parse_access(lines)
    if fmt == "syslog":
        return parse_syslog(lines)
    if fmt == "application":
        return parse_application(lines)
    if fmt == "json":
        return parse_json(lines, options["schema"])
    if fmt == "csv":
        return parse_csv(lines, options["header"], options["order"])
    return parse_any(lines)
