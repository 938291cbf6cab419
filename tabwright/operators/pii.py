"""Finding and masking personal data with column expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import keyed
from tabwright.functions.pii_types import (
    DATE_FORMATS,
    DEFAULT_MARKER,
    GENERALIZED,
    INDIRECT_TYPES,
    MARKERS,
    NAME_HINTS,
    PATTERNS,
    STRATEGIES,
)

DETECTION = "column_name string, pii_type string, confidence double"
# Seven to fifteen digits, at least one separator, and no calendar date.
STRICT_PHONE = r"^(?!\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$)(?!\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$)(?=(?:\D*\d){7,15}\D*$)\+?[(]?\d{1,4}[)]?(?:[-\s.]\d{1,4}){1,4}$"


# --- detection --------------------------------------------------------------


def plain_text(df: DataFrame, column: str) -> Column:
    """A value as text; doubles with all their digits and without an exponent."""
    text = F.col(column).cast("string")
    if not isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return text
    # 1.25E-7 and 1.25E9: the point moves by the exponent through the digits; nothing is rounded
    shape = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    fraction = F.regexp_replace(part(3), "0+$", "")
    by = part(4).try_cast("int")
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -by - 1), part(2), fraction)
    whole = F.concat(part(1), part(2), F.rpad(F.substring(fraction, F.lit(1), by), by, F.lit("0")), F.lit("."))
    rest = F.substring(fraction, by + 1, F.greatest(F.length(fraction) - by, F.lit(0)))
    large = F.concat(whole, F.when(rest == "", F.lit("0")).otherwise(rest))
    return F.when(text.rlike(shape), F.when(by < 0, small).otherwise(large)).otherwise(text)


def hinted_type(column: str, mode: str = "compat") -> str | None:
    """The first type with a hint in the column name; ``strict`` wants whole words."""
    name = column.lower().strip().replace(" ", "_")
    words = set(name.split("_"))
    for kind, hints in NAME_HINTS.items():
        for h in hints:
            inside = h in name if mode == "compat" else (h == name or h in words or f"_{h}_" in f"_{name}_")
            if inside:
                return kind
    return None


def first_values(df: DataFrame, columns: list[str], order: list[str], first: int) -> DataFrame:
    """(column_name, position, value): the first non-null values of each column as text, in the given order.

    One top-n over the table serves every column that has enough values among its first rows; only a column
    that is nearly empty there gets a top-n of its own.  Either way at most ``first`` values per column remain.
    """
    reach = 10 * first
    head = df.select(*order, *[plain_text(df, c).alias(f"_t{i}") for i, c in enumerate(columns)]).orderBy(*order).limit(reach)
    found = head.agg(F.count("*").alias("rows"), *[F.count(f"_t{i}").alias(f"_t{i}") for i in range(len(columns))]).first()
    near = [i for i in range(len(columns)) if found["rows"] < reach or found[f"_t{i}"] >= first]
    parts = []
    if near:
        numbered = head.withColumn("_at", F.row_number().over(W.orderBy(*order)))  # at most ``reach`` rows
        cells = F.array(*[F.struct(F.lit(columns[i]).alias("column_name"), F.col(f"_t{i}").alias("value")) for i in near])
        parts.append(numbered.select("_at", F.inline(cells)).where(F.col("value").isNotNull()))
    for i, c in enumerate(columns):
        if i not in near:
            own = df.where(F.col(c).isNotNull()).orderBy(*order).limit(first)
            parts.append(own.select(F.row_number().over(W.orderBy(*order)).alias("_at"), F.lit(c).alias("column_name"), plain_text(df, c).alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    position = F.row_number().over(W.partitionBy("column_name").orderBy("_at"))
    return rows.select("column_name", position.alias("position"), "value").where(F.col("position") <= first)


def pattern_rates(df: DataFrame, columns: list[str], order: list[str], first: int | None = None, mode: str = "compat") -> DataFrame:
    """(column_name, values, <pattern rates>) over all non-null values of each column, in one aggregate over the table.

    ``first`` looks at so many values of each column only, in the given order.
    """
    patterns = dict(PATTERNS)
    if mode == "strict":
        patterns["phone"] = STRICT_PHONE
    if first is None:
        texts = df.select(*[F.trim(plain_text(df, c)).alias(f"_t{i}") for i, c in enumerate(columns)])
        cells = [F.count(f"_t{i}").alias(f"_n{i}") for i in range(len(columns))]
        for i in range(len(columns)):
            cells += [F.avg(F.col(f"_t{i}").rlike(p).cast("double")).alias(f"_{i}_{k}") for k, p in patterns.items()]
        entries = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("values"), *[F.col(f"_{i}_{k}").alias(k) for k in patterns])
            for i, c in enumerate(columns)
        ]
        return texts.agg(*cells).select(F.inline(F.array(*entries))).where("values > 0")
    rows = first_values(df, columns, order, first).withColumn("value", F.trim("value"))
    return rows.groupBy("column_name").agg(
        F.count("*").alias("values"), *[F.avg(F.col("value").rlike(p).cast("double")).alias(k) for k, p in patterns.items()]
    )


def detect(df: DataFrame, order: list[str], columns: list[str] | None = None, first: int | None = None, mode: str = "compat") -> DataFrame:
    """(column_name, pii_type, pii_category, confidence, suggested_strategy) of the columns that look personal."""
    columns = columns or df.columns
    rates = pattern_rates(df, columns, order, first, mode)
    hints = df.sparkSession.createDataFrame([(c, hinted_type(c, mode)) for c in columns], "column_name string, hint string")
    rows = F.broadcast(hints).join(F.broadcast(rates), "column_name")  # one row per column
    kind, best = F.col("hint"), F.when(F.col("hint").isNotNull(), 0.8).otherwise(0.0)
    for k in PATTERNS:
        wins = (F.col(k) > 0.5) & (F.col(k) > best)
        kind, best = F.when(wins, F.lit(k)).otherwise(kind), F.when(wins, F.col(k)).otherwise(best)
    found = rows.select("column_name", kind.alias("pii_type"), F.round(best, 2).alias("confidence"))
    return classify(found.where(F.col("pii_type").isNotNull()))


def classify(detections: DataFrame) -> DataFrame:
    """Add category and suggested strategy from the fixed vocabulary."""
    spark = detections.sparkSession
    known = spark.createDataFrame(
        [(k, "indirect" if k in INDIRECT_TYPES else "direct", s) for k, s in STRATEGIES.items()],
        "pii_type string, pii_category string, suggested_strategy string",
    )
    joined = detections.join(F.broadcast(known), "pii_type", "left")
    return joined.select(
        "column_name", "pii_type", F.coalesce("pii_category", F.lit("direct")).alias("pii_category"), "confidence",
        F.coalesce("suggested_strategy", F.lit("redact")).alias("suggested_strategy"),
    )


def sample_values(df: DataFrame, columns: list[str], order: list[str], n: int = 3) -> DataFrame:
    """(column_name, samples): the first few non-null values of each column."""
    rows = first_values(df, columns, order, n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"])
    return rows.groupBy("column_name").agg(listed.alias("samples"))


def non_pii_columns(df: DataFrame, detections: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    return names.join(detections, "column_name", "left_anti")


# --- hashing ----------------------------------------------------------------


def hash_digits(value: Column) -> Column:
    """SHA-256 hex with every hex digit taken modulo 10."""
    return F.translate(F.sha2(value, 256), "abcdef", "012345")


def hash_letters(value: Column) -> Column:
    return F.translate(F.sha2(value, 256), "0123456789abcdef", "ABCDEFGHIJKLMNOP")


# Templates of the format-preserving hash: #n takes the next n digits, @n the next n letters.
HASH_TEMPLATES = {
    "ssn": ["#3", "-", "#2", "-", "#4"],
    "credit_card": ["4", "#3", "-", "#4", "-", "#4", "-", "#4"],
    "phone": ["555-", "#3", "-", "#4"],
    "passport": ["@2", "#7"],
    "drivers_license": ["@1", "-", "#8"],
    "bank_account": ["#4", "-", "#4", "-", "#4", "-", "#4"],
    "medical_record": ["MRN-", "#7"],
    "national_id": ["#3", "-", "#2", "-", "#4"],
    "tax_id": ["#2", "-", "#7"],
    "license_plate": ["@3", "-", "#4"],
    "email": ["@6l", "#4", "@masked.example.com"],
    "employee_id": ["EMP-", "#6"],
    "vehicle_vin": ["@1", "#2", "@2", "#1", "@2", "#1", "#8"],
    "zip_code": ["#5"],
}


def fill_template(template: list[str], digits: Column, letters: Column) -> Column:
    parts, next_digit, next_letter = [], 1, 1
    for item in template:
        token = re.fullmatch(r"([#@])(\d+)(l?)", item)
        if token is None:
            parts.append(F.lit(item))
        elif token[1] == "#":
            parts.append(F.substring(digits, next_digit, int(token[2])))
            next_digit += int(token[2])
        else:
            piece = F.substring(letters, next_letter, int(token[2]))
            parts.append(F.lower(piece) if token[3] else piece)
            next_letter += int(token[2])
    return F.concat(*parts)


def hash_mask(value: Column, kind: str) -> Column:
    """Equal inputs give equal outputs that look like the original type; nulls stay null."""
    h = F.sha2(value, 256)
    if kind == "ip":
        octets = [(keyed.hex_to_long(h, 2 * i + 1, 2) % 224 + 1).cast("string") for i in range(4)]
        return F.concat(octets[0], *[x for o in octets[1:] for x in (F.lit("."), o)])
    if kind == "device_id":
        pairs = [F.upper(F.substring(h, 2 * i + 1, 2)) for i in range(6)]
        return F.concat(pairs[0], *[x for p in pairs[1:] for x in (F.lit(":"), p)])
    if kind in HASH_TEMPLATES:
        return fill_template(HASH_TEMPLATES[kind], hash_digits(value), hash_letters(value))
    return F.substring(h, 1, 16)


# --- redaction and generalisation -------------------------------------------


def redact(value: Column, kind: str) -> Column:
    return F.when(value.isNotNull(), F.lit(MARKERS.get(kind, DEFAULT_MARKER)))


def _or_generalized(value: Column, result: Column) -> Column:
    return F.when(value.isNotNull(), F.coalesce(result, F.lit(GENERALIZED)))


def parse_date(value: Column, pattern: str) -> Column:
    """The detected format first, then whatever Spark reads as a date."""
    text = F.trim(value)
    return F.coalesce(F.try_to_timestamp(text, F.lit(pattern)).cast("date"), text.try_cast("date"))


def generalize(value: Column, kind: str, date_pattern: str = "yyyy-MM-dd") -> Column:
    if kind == "age":
        age = value.try_cast("double").cast("bigint")
        decade = F.floor(age / 10) * 10
        return _or_generalized(value, F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string")))
    if kind == "salary":
        amount = F.regexp_replace(value, "[,$]", "").try_cast("double")
        bracket = (F.floor(amount / 25000) * 25000).cast("bigint")
        return _or_generalized(value, F.concat(bracket.cast("string"), F.lit("-"), (bracket + 24999).cast("string")))
    if kind == "zip_code":
        text = F.trim(value)
        return F.when(F.length(text) >= 3, F.concat(F.substring(text, 1, 3), F.lit("**"))).otherwise(text)
    if kind == "geolocation":
        parts = F.split(value, ",")
        places = [F.round(F.trim(F.get(parts, F.lit(i))).try_cast("double"), 1).cast("string") for i in (0, 1)]
        return _or_generalized(value, F.concat(places[0], F.lit(", "), places[1]))
    if kind == "date_of_birth":
        decade = (F.floor(F.year(parse_date(value, date_pattern)) / 10) * 10).cast("string")
        return _or_generalized(value, F.concat(decade, F.lit("s")))
    if kind in ("gender", "marital_status", "education", "nationality", "occupation"):
        return value
    if kind in ("name", "address", "email"):
        return F.when(F.length(value) > 0, F.concat(F.substring(value, 1, 1), F.lit("***"))).otherwise(value)
    return F.when(value.isNotNull(), F.lit(GENERALIZED))


def date_format_scores(df: DataFrame, column: str, order: list[str], first: int | None = None) -> DataFrame:
    """One row per format: how many values have its shape, and how many it parses; of the first so many, if asked."""
    head = df.where(F.col(column).isNotNull())
    head = (head if first is None else head.orderBy(*order).limit(first)).select(F.trim(F.col(column).cast("string")).alias("v"))
    cells = []
    for i, (fmt, shape) in enumerate(DATE_FORMATS):
        cells.append(F.count_if(F.col("v").rlike(shape)).alias(f"s{i}") if shape else F.lit(0).cast("bigint").alias(f"s{i}"))
        cells.append(F.count(F.try_to_timestamp("v", F.lit(fmt))).alias(f"p{i}"))
    row = head.agg(F.count("*").alias("n"), *cells)
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(fmt).alias("format"), F.lit(shape is not None).alias("shaped"),
                 F.col("n"), F.col(f"s{i}").alias("shape_hits"), F.col(f"p{i}").alias("parsed"))
        for i, (fmt, shape) in enumerate(DATE_FORMATS)
    ]
    return row.select(F.inline(F.array(*entries)))


def choose_date_format(scores: list) -> str:
    """Walk the scored formats in list order: shaped ones first, all of them where fewer than 30 % parse."""
    best, best_score = DATE_FORMATS[0][0], 0
    n = scores[0]["n"] if scores else 0
    for s in scores:
        if s["shaped"] and s["shape_hits"] > best_score and s["parsed"] > best_score:
            best, best_score = s["format"], s["parsed"]
    if best_score < n * 0.3:
        for s in scores:
            if s["parsed"] > best_score:
                best, best_score = s["format"], s["parsed"]
    return best


def detect_date_format(df: DataFrame, column: str, order: list[str], first: int | None = None) -> str:
    rows = date_format_scores(df, column, order, first).collect()  # twelve rows
    return choose_date_format(sorted((r.asDict() for r in rows), key=lambda r: r["position"]))


# --- synthetic replacement --------------------------------------------------

FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gina", "Hugo", "Iris", "Jack", "Kira", "Liam", "Maya", "Nils", "Olga", "Paul"]
LAST_NAMES = ["Adler", "Brook", "Clark", "Drake", "Ellis", "Frost", "Grant", "Hayes", "Irwin", "Jones", "Knight", "Lowe", "Mason", "North", "Owens", "Price"]
STREETS = ["Oak", "Maple", "Cedar", "Pine", "Elm", "Lake", "Hill", "River"]
CITIES = ["Springfield", "Fairview", "Georgetown", "Madison", "Clinton", "Salem", "Bristol", "Dover"]
STATES = ["CA", "NY", "TX", "WA", "IL", "OH", "GA", "NC"]
JOBS = ["Accountant", "Architect", "Chemist", "Designer", "Editor", "Engineer", "Nurse", "Teacher"]
COUNTRIES = ["Brazil", "Canada", "France", "India", "Japan", "Kenya", "Norway", "Spain"]
CHOICES = {
    "gender": ["Male", "Female", "Non-binary"],
    "marital_status": ["Single", "Married", "Divorced", "Widowed"],
    "education": ["High School", "Associate", "Bachelor", "Master", "Doctorate"],
    "occupation": JOBS,
    "nationality": COUNTRIES,
}
SYNTHETIC_TEMPLATES = {
    "phone": ["#3", "-", "#3", "-", "#4"],
    "ssn": ["#3", "-", "#2", "-", "#4"],
    "national_id": ["#3", "-", "#2", "-", "#4"],
    "credit_card": ["4", "#15"],
    "passport": ["@2", "#6"],
    "drivers_license": ["@1", "-", "#8"],
    "bank_account": ["#4", "-", "#4", "-", "#4", "-", "#4"],
    "medical_record": ["MRN-", "#7"],
    "tax_id": ["#2", "-", "#7"],
    "license_plate": ["@3", "-", "#4"],
    "employee_id": ["EMP-", "#6"],
    "vehicle_vin": ["@1", "#2", "@2", "#1", "@2", "#1", "@1", "#7"],
    "zip_code": ["#5"],
}


def shift_date(value: Column, pattern: str, seed: int = keyed.SEED) -> Column:
    """Move a birth date by 30 to 730 days either way, clamp the year to 1930-2010, keep the format.

    A text that is no date gets a date of its own between 1935 and 2004.
    """
    day = parse_date(value, pattern)
    steps = (keyed.index_below(701, "dob-days", value, seed=seed) + 30).cast("int")
    sign = F.when(keyed.uniform("dob-sign", value, seed=seed) < 0.5, -1).otherwise(1)
    moved = F.date_add(day, steps * sign)
    offset = keyed.index_below(11, "dob-clamp", value, seed=seed)

    def in_year(base):
        # 29 February falls back to the 28th in other years.
        return F.add_months(moved, ((base + offset - F.year(moved)) * 12).cast("int"))

    clamped = F.when(F.year(moved) < 1930, in_year(1930)).when(F.year(moved) > 2010, in_year(2000)).otherwise(moved)
    fresh = F.date_add(F.lit("1935-01-01").cast("date"), keyed.index_below(25000, "dob-new", value, seed=seed).cast("int"))
    return F.when(value.isNotNull(), F.date_format(F.coalesce(clamped, fresh), pattern))


def synthesize(value: Column, kind: str, date_pattern: str = "yyyy-MM-dd", seed: int = keyed.SEED) -> Column:
    """A made-up value of the type.  It depends on the value only, so joins on a masked key still work."""

    def number(tag, low, high):
        return keyed.index_below(high - low + 1, f"{kind}:{tag}", value, seed=seed) + low

    def pick(values, tag):
        return keyed.pick(values, f"{kind}:{tag}", value, seed=seed)

    if kind == "date_of_birth":
        return shift_date(value, date_pattern, seed)
    if kind in CHOICES:
        made = pick(CHOICES[kind], "choice")
    elif kind == "name":
        made = F.concat(pick(FIRST_NAMES, "first"), F.lit(" "), pick(LAST_NAMES, "last"))
    elif kind == "username":
        made = F.concat(F.lower(pick(FIRST_NAMES, "first")), number("n", 10, 9999).cast("string"))
    elif kind == "email":
        made = F.concat(
            F.lower(pick(FIRST_NAMES, "first")), F.lit("."), F.lower(pick(LAST_NAMES, "last")),
            number("n", 10, 99999).cast("string"), F.lit("@example.com"),
        )
    elif kind == "address":
        made = F.concat(
            number("house", 1, 9999).cast("string"), F.lit(" "), pick(STREETS, "street"), F.lit(" Street, "),
            pick(CITIES, "city"), F.lit(", "), pick(STATES, "state"), F.lit(" "), number("zip", 10000, 99999).cast("string"),
        )
    elif kind == "ip":
        parts = [number(f"o{i}", 1, 254).cast("string") for i in range(4)]
        made = F.concat(parts[0], F.lit("."), parts[1], F.lit("."), parts[2], F.lit("."), parts[3])
    elif kind == "geolocation":
        lat = F.round(keyed.uniform(f"{kind}:lat", value, seed=seed) * 180 - 90, 6)
        lon = F.round(keyed.uniform(f"{kind}:lon", value, seed=seed) * 360 - 180, 6)
        made = F.format_string("%.6f, %.6f", lat, lon)
    elif kind == "age":
        made = number("age", 18, 85).cast("string")
    elif kind == "salary":
        cents = number("cents", 3_000_000, 20_000_000)
        made = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    elif kind == "device_id":
        made = hash_mask(keyed.digest("device", value, seed=seed), "device_id")
    elif kind in SYNTHETIC_TEMPLATES:
        salted = keyed.digest(f"template:{kind}", value, seed=seed)
        made = fill_template(SYNTHETIC_TEMPLATES[kind], hash_digits(salted), hash_letters(salted))
    else:
        made = F.concat(F.lit("text-"), F.substring(keyed.digest("text", value, seed=seed), 1, 12))
    return F.when(value.isNotNull(), made)


# --- whole tables -----------------------------------------------------------


def mask_expression(value: Column, kind: str, strategy: str, date_pattern: str = "yyyy-MM-dd", seed: int = keyed.SEED) -> Column:
    """One column's mask; an unknown strategy redacts."""
    if strategy == "synthetic":
        return synthesize(value, kind, date_pattern, seed)
    if strategy == "hash":
        return F.when(value.isNotNull(), hash_mask(value, kind))
    if strategy == "generalize":
        return generalize(value, kind, date_pattern)
    return redact(value, kind)


def mask_plan(df: DataFrame, detections: list[dict], strategies: dict[str, str] | None = None) -> dict[str, tuple[str, str]]:
    """Column -> (type, strategy).  A strategy map limits the columns; otherwise detections decide."""
    found = {d["column_name"]: d for d in detections}
    if strategies:
        return {c: (found.get(c, {}).get("pii_type", "unknown"), s) for c, s in strategies.items() if c in df.columns}
    return {c: (d["pii_type"], d["suggested_strategy"]) for c, d in found.items()}


def mask_table(df: DataFrame, plan: dict[str, tuple[str, str]], date_patterns: dict[str, str] | None = None, seed: int = keyed.SEED) -> DataFrame:
    """One narrow projection, no shuffle."""
    patterns = date_patterns or {}
    return df.withColumns(
        {c: mask_expression(plain_text(df, c), k, s, patterns.get(c, "yyyy-MM-dd"), seed) for c, (k, s) in plan.items()}
    )


def mask_report(df: DataFrame, detected: int, plan: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: rows, cells masked, risk and privacy scores."""
    masked, total = len(plan), len(df.columns)
    return df.agg(F.count("*").alias("rows_processed")).select(
        F.lit(total).cast("bigint").alias("total_columns"),
        F.lit(detected).cast("bigint").alias("pii_columns_detected"),
        F.lit(masked).cast("bigint").alias("pii_columns_masked"),
        "rows_processed",
        (F.col("rows_processed") * masked).alias("cells_masked"),
        F.lit(max(0.0, 1.0 - masked / max(total, 1))).alias("risk_score"),
        F.lit(min(1.0, masked / max(total * 0.5, 1))).alias("privacy_score"),
    )


def strategy_counts(plan: dict[str, tuple[str, str]], df: DataFrame) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(c, k, s) for c, (k, s) in plan.items()], "column_name string, pii_type string, strategy string")
    return rows.groupBy("strategy").agg(F.count("*").alias("columns"))


def mask_samples(df: DataFrame, masked: DataFrame, plan: dict[str, tuple[str, str]], order: list[str], n: int = 3) -> DataFrame:
    """(column_name, before, after): the first few values of each masked column."""
    columns = list(plan)
    before = sample_values(df, columns, order, n).withColumnRenamed("samples", "before")
    after = sample_values(masked, columns, order, n).withColumnRenamed("samples", "after")
    return before.join(F.broadcast(after), "column_name")
