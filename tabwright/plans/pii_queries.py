"""Personal data derived from every customer: found, classified and masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.pii_types import DATE_FORMATS, INDIRECT_TYPES, MARKERS, NAME_HINTS, PATTERNS, STRATEGIES
from tabwright.operators import pii
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, sql_digest, sql_index, sql_uniform, table


def people(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    missing = (key % 11) == 5

    def unless_missing(value):
        return F.when(~missing, value)

    return table(spark, folder, "customer").select(
        key.alias("record"),
        F.col("c_name").alias("full_name"),
        F.format_string("user%d@mail%d.com", key, F.col("c_nationkey")).alias("email"),
        unless_missing(F.format_string("%03d-555-%04d", key % 1000, key % 10000)).alias("phone_number"),
        F.format_string("%03d-%02d-%04d", key % 900 + 100, key % 90 + 10, key % 9000 + 1000).alias("ssn"),
        unless_missing(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 20000).cast("int")), "yyyy-MM-dd")).alias("dob"),
        F.format_string("10.%d.%d.%d", key % 250, key * 7 % 250, key * 13 % 250).alias("client_ip"),
        F.format_string("%d", key % 70 + 18).alias("age"),
        F.format_string("$%d,%03d", key % 180 + 20, key % 1000).alias("income"),
        F.format_string("%05d", key * 17 % 100000).alias("zip"),
        F.format_string("%d.25, -%d.75", key % 80 + 1, key % 170 + 1).alias("place"),
        F.col("c_mktsegment").alias("segment"),
    )


PEOPLE = """(SELECT c_custkey AS record, c_name AS full_name, printf('user%d@mail%d.com', c_custkey, c_nationkey) AS email,
    CASE WHEN c_custkey % 11 <> 5 THEN printf('%03d-555-%04d', c_custkey % 1000, c_custkey % 10000) END AS phone_number,
    printf('%03d-%02d-%04d', c_custkey % 900 + 100, c_custkey % 90 + 10, c_custkey % 9000 + 1000) AS ssn,
    CASE WHEN c_custkey % 11 <> 5 THEN strftime(DATE '1950-01-01' + (c_custkey * 37 % 20000)::INTEGER, '%Y-%m-%d') END AS dob,
    printf('10.%d.%d.%d', c_custkey % 250, c_custkey * 7 % 250, c_custkey * 13 % 250) AS client_ip,
    printf('%d', c_custkey % 70 + 18) AS age, printf('$%d,%03d', c_custkey % 180 + 20, c_custkey % 1000) AS income,
    printf('%05d', c_custkey * 17 % 100000) AS zip, printf('%d.25, -%d.75', c_custkey % 80 + 1, c_custkey % 170 + 1) AS place,
    c_mktsegment AS segment FROM customer)"""
COLUMNS = ["full_name", "email", "phone_number", "ssn", "dob", "client_ip", "age", "income", "zip", "place", "segment"]


def _hint_sql(name):
    """The type a column name hints at, looked up while the SQL text is built."""
    for kind, hints in NAME_HINTS.items():
        if any(h in name for h in hints):
            return f"'{kind}'"
    return "NULL"


_RATES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_hint_sql(c)} AS hint, count(*) AS values, "
    + ", ".join(f"avg(regexp_matches(v, '{p}')::INT) AS {k}" for k, p in PATTERNS.items())
    + f" FROM (SELECT trim({c}) AS v FROM {PEOPLE} WHERE {c} IS NOT NULL)"
    for c in COLUMNS
)


def _detect_sql():
    kind, best = "hint", "CASE WHEN hint IS NOT NULL THEN 0.8 ELSE 0 END"
    for k in PATTERNS:
        wins = f"({k} > 0.5 AND {k} > ({best}))"
        kind, best = f"CASE WHEN {wins} THEN '{k}' ELSE {kind} END", f"CASE WHEN {wins} THEN {k} ELSE {best} END"
    return f"SELECT column_name, {kind} AS pii_type, round(({best})::DOUBLE, 2) AS confidence FROM ({_RATES})"


_STRATEGY_VALUES = ", ".join(f"('{k}', '{s}')" for k, s in STRATEGIES.items())
_INDIRECT = "(" + ", ".join(f"'{k}'" for k in sorted(INDIRECT_TYPES)) + ")"
_DETECTED = f"""SELECT column_name, pii_type, CASE WHEN pii_type IN {_INDIRECT} THEN 'indirect' ELSE 'direct' END AS pii_category,
    confidence, s AS suggested_strategy FROM ({_detect_sql()}) JOIN (VALUES {_STRATEGY_VALUES}) t(k, s) ON k = pii_type"""


@query("pii_pattern_rates", f"SELECT column_name, values, {', '.join(f'round({k}, 6) AS {k}' for k in PATTERNS)} FROM ({_RATES})")
def pii_pattern_rates(spark, folder):
    return rounded(pii.pattern_rates(people(spark, folder), COLUMNS, ["record"]), **{k: 6 for k in PATTERNS})


@query("pii_detection", _DETECTED)
def pii_detection(spark, folder):
    return pii.detect(people(spark, folder), ["record"], COLUMNS)


@query("pii_detection_strict")
def pii_detection_strict(spark, folder):
    return pii.detect(people(spark, folder), ["record"], COLUMNS, mode="strict")


@query(
    "non_personal_columns",
    f"SELECT unnest({['record', *COLUMNS]}) AS column_name EXCEPT SELECT column_name FROM ({_DETECTED})",
)
def non_personal_columns(spark, folder):
    rows = people(spark, folder)
    return pii.non_pii_columns(rows, pii.detect(rows, ["record"], COLUMNS))


@query(
    "pii_samples",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, list(v ORDER BY record) AS samples FROM (SELECT record, {c} AS v FROM {PEOPLE} WHERE {c} IS NOT NULL ORDER BY record LIMIT 3)"
        for c in COLUMNS
    ),
)
def pii_samples(spark, folder):
    return pii.sample_values(people(spark, folder), COLUMNS, ["record"])


# --- hashing ----------------------------------------------------------------

_D, _L = "translate(sha256({v}), 'abcdef', '012345')", "translate(sha256({v}), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"


def sql_template(template, digits, letters):
    parts, d, a = [], 1, 1
    for item in template:
        if item[0] == "#":
            parts.append(f"substr({digits}, {d}, {item[1:]})")
            d += int(item[1:])
        elif item[0] == "@" and item[1].isdigit():
            n = int(item[1:].rstrip("l"))
            piece = f"substr({letters}, {a}, {n})"
            parts.append(f"lower({piece})" if item.endswith("l") else piece)
            a += n
        else:
            parts.append(f"'{item}'")
    return " || ".join(parts)


HASHED = [*pii.HASH_TEMPLATES, "ip", "device_id", "username"]


def sql_hash(kind, v):
    h = f"sha256({v})"
    if kind == "ip":
        return " || '.' || ".join(f"((('0x' || substr({h}, {2 * i + 1}, 2))::BIGINT) % 224 + 1)::VARCHAR" for i in range(4))
    if kind == "device_id":
        return " || ':' || ".join(f"upper(substr({h}, {2 * i + 1}, 2))" for i in range(6))
    if kind in pii.HASH_TEMPLATES:
        return sql_template(pii.HASH_TEMPLATES[kind], _D.format(v=v), _L.format(v=v))
    return f"substr({h}, 1, 16)"


@query("hash_masks", f"SELECT record, {', '.join(f'{sql_hash(k, "phone_number")} AS {k}' for k in HASHED)} FROM {PEOPLE}")
def hash_masks(spark, folder):
    value = F.col("phone_number")
    return people(spark, folder).select("record", *[F.when(value.isNotNull(), pii.hash_mask(value, k)).alias(k) for k in HASHED])


REDACTED = [*MARKERS, "name", "password"]


@query(
    "redaction_markers",
    f"SELECT record, {', '.join(f"CASE WHEN phone_number IS NOT NULL THEN '{MARKERS.get(k, '[REDACTED]')}' END AS {k}" for k in REDACTED)} FROM {PEOPLE}",
)
def redaction_markers(spark, folder):
    return people(spark, folder).select("record", *[pii.redact(F.col("phone_number"), k).alias(k) for k in REDACTED])


@query(
    "generalized_values",
    f"""SELECT record, (age::INT // 10 * 10)::VARCHAR || '-' || (age::INT // 10 * 10 + 9)::VARCHAR AS age,
        (floor(replace(replace(income, '$', ''), ',', '')::DOUBLE / 25000) * 25000)::BIGINT::VARCHAR || '-' ||
          (floor(replace(replace(income, '$', ''), ',', '')::DOUBLE / 25000) * 25000 + 24999)::BIGINT::VARCHAR AS income,
        substr(zip, 1, 3) || '**' AS zip, substr(dob, 1, 3) || '0s' AS dob, substr(full_name, 1, 1) || '***' AS full_name,
        (c % 80 + 1)::VARCHAR || '.3, -' || (c % 170 + 1)::VARCHAR || '.8' AS place, segment,
        CASE WHEN phone_number IS NOT NULL THEN '[GENERALIZED]' END AS phone_number, '[GENERALIZED]' AS not_an_age
        FROM (SELECT *, record AS c FROM {PEOPLE})""",
)
def generalized_values(spark, folder):
    kinds = {"age": "age", "income": "salary", "zip": "zip_code", "dob": "date_of_birth", "full_name": "name", "place": "geolocation", "segment": "education", "phone_number": "phone"}
    rows = people(spark, folder)
    return rows.select(
        "record", *[pii.generalize(F.col(c), k).alias(c) for c, k in kinds.items()], pii.generalize(F.col("email"), "age").alias("not_an_age")
    )


# --- dates ------------------------------------------------------------------

_DUCK_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%b-%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%Y/%m/%d", "%d.%m.%Y", "%m.%d.%Y", "%Y%m%d"]


@query(
    "date_format_scores",
    f"WITH h AS (SELECT strftime(strptime(dob, '%Y-%m-%d'), '%d-%b-%Y') AS v FROM {PEOPLE} WHERE dob IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{fmt}' AS format, count(*) FILTER (WHERE {f"regexp_matches(v, '{shape}')" if shape else 'false'}) AS shape_hits, count(TRY_STRPTIME(v, '{duck}')) AS parsed FROM h"
        for i, ((fmt, shape), duck) in enumerate(zip(DATE_FORMATS, _DUCK_FORMATS))
    ),
)
def date_format_scores(spark, folder):
    rows = people(spark, folder).withColumn("dob", F.date_format(F.col("dob").cast("date"), "dd-MMM-yyyy"))
    return pii.date_format_scores(rows, "dob", ["record"]).select("position", "format", "shape_hits", "parsed")


@query(
    "shifted_birth_dates",
    f"""SELECT record, strftime(CASE WHEN year(m) < 1930 THEN m + to_years((1930 + o - year(m))::INTEGER) WHEN year(m) > 2010 THEN m + to_years((2000 + o - year(m))::INTEGER) ELSE m END, '%Y-%m-%d') AS dob FROM (
        SELECT record, dob, {sql_index('11', 'dob-clamp', 'dob')} AS o,
          CASE WHEN dob IS NOT NULL THEN strptime(dob, '%Y-%m-%d')::DATE + ((({sql_index('701', 'dob-days', 'dob')}) + 30) * CASE WHEN {sql_uniform('dob-sign', 'dob')} < 0.5 THEN -1 ELSE 1 END)::INTEGER END AS m
        FROM {PEOPLE})""",
)
def shifted_birth_dates(spark, folder):
    return people(spark, folder).select("record", pii.shift_date(F.col("dob"), "yyyy-MM-dd").alias("dob"))


# --- synthetic --------------------------------------------------------------


def sql_pick(values, tag, key):
    return f"({values!r}::VARCHAR[])[{sql_index(str(len(values)), tag, key)} + 1]"


def _templated(kind, v):
    h = sql_digest(f"template:{kind}", v)
    return sql_template(pii.SYNTHETIC_TEMPLATES[kind], _D.format(v=h), _L.format(v=h))


_SYNTHETIC_SQL = {
    "name": lambda v: f"{sql_pick(pii.FIRST_NAMES, 'name:first', v)} || ' ' || {sql_pick(pii.LAST_NAMES, 'name:last', v)}",
    "age": lambda v: f"({sql_index('68', 'age:age', v)} + 18)::VARCHAR",
    "gender": lambda v: sql_pick(pii.CHOICES["gender"], "gender:choice", v),
    "username": lambda v: f"lower({sql_pick(pii.FIRST_NAMES, 'username:first', v)}) || ({sql_index('9990', 'username:n', v)} + 10)::VARCHAR",
    "ip": lambda v: " || '.' || ".join(f"({sql_index('254', f'ip:o{i}', v)} + 1)::VARCHAR" for i in range(4)),
    **{k: (lambda v, k=k: _templated(k, v)) for k in pii.SYNTHETIC_TEMPLATES},
}


@query(
    "synthetic_values",
    "SELECT record, "
    + ", ".join(f"CASE WHEN phone_number IS NOT NULL THEN {fn('phone_number')} END AS {k}" for k, fn in _SYNTHETIC_SQL.items())
    + f" FROM {PEOPLE}",
)
def synthetic_values(spark, folder):
    rows = people(spark, folder)
    return rows.select("record", *[pii.synthesize(F.col("phone_number"), k).alias(k) for k in _SYNTHETIC_SQL])


# --- tables -----------------------------------------------------------------

PLAN = {"ssn": ("ssn", "hash"), "client_ip": ("ip", "hash"), "phone_number": ("phone", "redact"), "zip": ("zip_code", "generalize"), "email": ("email", "hash"), "full_name": ("name", "no such strategy")}


@query(
    "masked_table",
    f"""SELECT record, '[REDACTED]' AS full_name, {sql_hash('email', 'email')} AS email, CASE WHEN phone_number IS NOT NULL THEN '***-***-****' END AS phone_number,
        {sql_hash('ssn', 'ssn')} AS ssn, dob, {sql_hash('ip', 'client_ip')} AS client_ip, age, income, substr(zip, 1, 3) || '**' AS zip, place, segment FROM {PEOPLE}""",
)
def masked_table(spark, folder):
    return pii.mask_table(people(spark, folder), PLAN)


@query("masked_table_detected")
def masked_table_detected(spark, folder):
    rows = people(spark, folder)
    plan = pii.mask_plan(rows, [r.asDict() for r in pii.detect(rows, ["record"], COLUMNS).collect()])
    return pii.mask_table(rows, plan)


@query(
    "mask_report",
    """SELECT 12::BIGINT AS total_columns, 9::BIGINT AS pii_columns_detected, 6::BIGINT AS pii_columns_masked, count(*) AS rows_processed,
        count(*) * 6 AS cells_masked, 0.5::DOUBLE AS risk_score, 1::DOUBLE AS privacy_score FROM customer""",
)
def mask_report(spark, folder):
    return pii.mask_report(people(spark, folder), 9, PLAN)


@query(
    "mask_samples",
    f"""SELECT 'ssn' AS column_name, list(ssn ORDER BY record) AS before, list({sql_hash('ssn', 'ssn')} ORDER BY record) AS after FROM (SELECT record, ssn FROM {PEOPLE} ORDER BY record LIMIT 3)
        UNION ALL SELECT 'zip', list(zip ORDER BY record), list(substr(zip, 1, 3) || '**' ORDER BY record) FROM (SELECT record, zip FROM {PEOPLE} ORDER BY record LIMIT 3)""",
)
def mask_samples(spark, folder):
    rows = people(spark, folder)
    plan = {k: PLAN[k] for k in ("ssn", "zip")}
    return pii.mask_samples(rows, pii.mask_table(rows, plan), plan, ["record"])


@query(
    "masked_columns_by_strategy",
    f"SELECT suggested_strategy AS strategy, count(*) AS columns FROM ({_DETECTED}) GROUP BY 1",
)
def masked_columns_by_strategy(spark, folder):
    rows = people(spark, folder)
    plan = pii.mask_plan(rows, [r.asDict() for r in pii.detect(rows, ["record"], COLUMNS).collect()])
    return pii.strategy_counts(plan, rows)


# --- whole documents --------------------------------------------------------


@query(
    "document_text_masks",
    f"""SELECT doc_id, {sql_hash('email', 'text')} AS as_email, substr(sha256(text), 1, 16) AS digest, substr(text, 1, 1) || '***' AS first_letter FROM documents""",
)
def document_text_masks(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", pii.hash_mask(text, "email").alias("as_email"), pii.hash_mask(text, "other").alias("digest"), pii.generalize(text, "name").alias("first_letter")
    )
