"""Conversations with damaged turns: faults, the cheapest edits that give a well-formed dialogue, and its digest.

Edits are paths through a graph of (turns read, state of the role pattern). A path has one integer weight: its cost in the high
digits, and below them the letters of its edits, the first letter in the highest of a fixed number of places and zeros behind
the last. So the least integer is the least cost, and among equal costs the least string. Where two paths meet, both have read
the same turns; if one string began with the other, it would go on with insertions only and cost more. Hence equal costs differ
in some place both have, the better path stays better whatever follows, and plain minima over the nodes decide everything.

A conversation is read by one task, unless it has over LONG turns: then its turns are numbered, cut into segments, and each
segment yields the least weights from every state to every state; these are joined from first to last, keeping only what is
still undecided.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import hot_join, number_rows, row_id, store

#: Edit letters by their digit; digits ascend as the letters do.
LETTERS = ".DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
BITS = 3
#: Costs of deleting, inserting and changing a role; a truncated turn that stays costs one more.
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTED = (BEGIN, ASSISTANT)
MADE_ROLES = {"u": "user", "a": "assistant"}
#: First faults of a turn.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Conversations with more turns are cut into segments of so many turns.
LONG, SEGMENT = 4096, 512
#: A conversation is dealt to many tasks at once if it has over a thousandth of all rows; there are fewer than a thousand.
HOT = 1000

Path = tuple[int, int]  # weight, letters written


def _shift(places: int, cost: int, digit: int, written: int) -> int:
    """Weight of an edge: its cost, and its letter in the place behind those written."""
    return (cost << BITS * places) + (digit << BITS * (places - 1 - written))


def _better(paths: dict[int, Path], state: int, path: Path) -> bool:
    if state not in paths or path[0] < paths[state][0]:
        paths[state] = path
        return True
    return False


def _insert(paths: dict[int, Path], places: int) -> dict[int, Path]:
    """Paths that go on with insertions; no state is worth visiting twice, so there are three at most."""
    open_ = dict(paths)
    while open_:
        found: dict[int, Path] = {}
        for state, (weight, written) in open_.items():
            for role, target in NEXT[state].items():
                if role in MADE_ROLES:
                    path = (weight + _shift(places, INSERT_COST, INSERT, written), written + 1)
                    if _better(paths, target, path):
                        found[target] = path
        open_ = found
    return paths


def segment_paths(turns: list[tuple[str, int]], start: int, opening: bool) -> dict[int, tuple[int, str]]:
    """(cost, edits) of the best path from a state to each state it can reach; turns: initial and first fault of each.

    Insertions belong to the turn before them; those before the first turn of all are looked at if `opening`.
    """
    places = len(turns) + 3 * (len(turns) + 1)
    paths: dict[int, Path] = {start: (0, 0)}
    if opening:
        _insert(paths, places)
    for initial, fault in turns:
        found: dict[int, Path] = {}
        for state, (weight, written) in paths.items():
            _better(found, state, (weight + _shift(places, DELETE_COST, DELETE, written), written + 1))
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            for role, target in NEXT[state].items():
                if role == initial:
                    _better(found, target, (weight + _shift(places, more, KEEP, written), written + 1))
                if role in MADE_ROLES:
                    _better(found, target, (weight + _shift(places, REROLE_COST + more, REROLE, written), written + 1))
        paths = _insert(found, places)
    return {state: (weight >> BITS * places, _letters(weight, written, places)) for state, (weight, written) in paths.items()}


def _letters(weight: int, written: int, places: int) -> str:
    mask = (1 << BITS) - 1
    return "".join(LETTERS[weight >> BITS * (places - 1 - k) & mask] for k in range(written))


def cheapest(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of a whole conversation."""
    paths = segment_paths(turns, BEGIN, True)
    return min(paths[s] for s in ACCEPTED if s in paths)


def edited(turns: list[tuple[str, str]], edits: str, state: int = BEGIN) -> list[str]:
    """The `role:text` lines that edits make of (role, text) turns, beginning in a state."""
    lines, k = [], 0
    for letter in edits:
        role, text = ("", "") if letter == "I" else turns[k]
        k += letter != "I"
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else next(r for r in NEXT[state] if r in MADE_ROLES)
        state = NEXT[state][initial]
        lines.append(f"{role if letter == 'K' else MADE_ROLES[initial]}:{text}")
    return lines


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copy (0, or 1 of a repeated turn), dropped: turns damaged by the checksum of `conv:turn`.

    Of twenty remainders, 0 drops the turn (its row stays as a mark, with dropped true), 1 empties its text, 2 takes out full
    stops, exclamation and question marks, 3 repeats the turn, 4 makes it the user's. A null is one space, in the checked text
    too; a null conversation is a conversation.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conversation), F.lit(":"), space(turn)).cast("binary")) % 20
    marked = rows.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("_kind")
    )
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    without = F.regexp_replace("text", "[.!?]", "")
    return marked.select(
        "conv",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind").isin(0, 1), F.lit("")).when(F.col("_kind") == 2, without).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
        (F.col("_kind") == 0).alias("dropped"),
    )


def _text_fault() -> Column:
    """Blank, truncated or sound, by the text alone."""
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~some, BLANK).when(~ended, TRUNCATED).otherwise(SOUND).cast("int")


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _facts(turns: list[tuple]) -> tuple:
    """The result of one conversation from its (turn, role, text, fault by text) rows in order."""
    if not turns:
        return (0, 0, 0, 0, 0, 0, "", _EMPTY)
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen: set[tuple[str, str]] = set()
    marked = []
    for _, role, text, fault in turns:
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        marked.append((role[:1], fault))
    faults = [fault for _, fault in marked]
    cost, edits = cheapest(marked)
    repaired = "\n".join(edited([(role, text) for _, role, text, _ in turns], edits))
    counts = [faults.count(kind) for kind in (BLANK, DUPLICATE, TRUNCATED)]
    wrong = illegal([initial for initial, _ in marked])
    return (gaps, *counts, wrong, cost, edits, hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest())


def repair(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG
) -> DataFrame:
    """One row per conversation of `damaged` turns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Turns go by number (null first), then by role and text, so equal numbers have an order of their own; repeated rows are
    turns of their own. A conversation of which no turn is left has zeros, no edits and the digest of nothing; null is a
    conversation like others; an empty table gives no rows. Other columns are not looked at. Conversations with over `long`
    turns go by segments; the results are the same.
    """
    marked = damaged(rows, conversation, turn, role, text).withColumn("fault", _text_fault())
    sizes = rows.groupBy(F.col(conversation).alias("conv")).agg(F.count("*").alias("_n"))
    sizes = store(sizes, "conversation-sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = sizes.filter((F.col("_n") * HOT > total) & (F.col("_n") > long)).select(F.col("conv").alias("_hot_conv"), F.lit(True).alias("_hot"))
    split = marked.join(F.broadcast(hot), F.col("conv").eqNullSafe(F.col("_hot_conv")), "left").drop("_hot_conv")
    columns = ["conv", "turn", "role", "text", "copy", "dropped", "fault"]
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    short = split.filter(F.col("_hot").isNull()).select(*columns)
    short = short.repartition("conv").sortWithinPartitions(*order)
    kept = [T.StructField(c, short.schema[c].dataType) for c in columns]
    made = [T.StructField(n, T.LongType()) for n in _FACTS] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    schema = T.StructType([*kept, T.StructField("settled", T.BooleanType()), *made])
    arrow = {f.name: t for f, t in zip(schema.fields, _arrow_types(schema))}

    def read(batches):
        """Settled conversations as one row each; the turns of long ones as they came."""
        for results, passed in _conversations(batches, columns, long):
            if results:
                arrays = [pa.array([r[0] for r in results], arrow["conv"])]
                arrays += [pa.nulls(len(results), arrow[c]) for c in columns[1:]]
                arrays.append(pa.array([True] * len(results)))
                arrays += [pa.array([r[1][k] for r in results], arrow[f.name]) for k, f in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            if passed:
                arrays = [pa.array([r[k] for r in passed], arrow[c]) for k, c in enumerate(columns)]
                arrays.append(pa.array([False] * len(passed)))
                arrays += [pa.nulls(len(passed), arrow[f.name]) for f in made]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    done = store(short.mapInArrow(read, schema), "conversations")
    out = done.filter("settled").select("conv", *[f.name for f in made])
    left = done.filter("NOT settled").select(*columns).unionByName(split.filter("_hot").select(*columns))
    if hot.isEmpty() and done.filter("NOT settled").isEmpty():
        return out
    return out.unionByName(_long(store(left, "conversations-long"), order).select(*out.columns))


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _conversations(batches, columns: list[str], long: int):
    """(results, rows passed on) of sorted rows. No more than `long` turns of a conversation are held."""
    current, turns, passing, any_ = None, [], False, False
    for batch in batches:
        results, passed = [], []
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if not any_ or row[0] != current:
                if any_ and not passing:
                    results.append((current, _facts([(t, r, x, f) for _, t, r, x, _, gone, f in turns if not gone])))
                current, turns, passing, any_ = row[0], [], False, True
            if passing:
                passed.append(row)
                continue
            turns.append(row)
            if len(turns) > long:
                passed += turns
                turns, passing = [], True
        yield results, passed
    if any_ and not passing:
        yield [(current, _facts([(t, r, x, f) for _, t, r, x, _, gone, f in turns if not gone]))], []


def _long(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The results of long conversations, whatever share of the rows they hold."""
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null")))
    live = keyed.filter("NOT dropped").withColumn("_row", row_id())
    numbered = number_rows(live, [*order, F.col("_row")], "conversations-order", "_number")
    known = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    all_ = keyed.groupBy("_key").agg(F.first("conv", ignorenulls=True).alias("conv"))
    starts = numbered.groupBy("_key").agg(
        F.min("_number").alias("_start"), F.count("*").alias("_n"), F.coalesce(known, F.lit(0)).cast("long").alias("gaps")
    )
    base = store(all_.join(starts, "_key", "left"), "conversations-base")
    total = numbered.count()
    numbered = hot_join(numbered, base.filter("_start IS NOT NULL").select("_key", "_start", "_n"), ["_key"], "_n", total).drop("_n")
    numbered = numbered.withColumn("_index", F.col("_number") - F.col("_start"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    numbered = store(numbered.withColumn("_same", digest), "conversations-numbered")
    first = numbered.groupBy("_start", "_same").agg(F.min("_index").alias("_first"), F.count("*").alias("_alike")).filter("_alike > 1")
    marked = hot_join(numbered, first, ["_start", "_same"], "_alike", total)
    repeated = (F.col("_index") > F.col("_first")) & (F.col("fault") != BLANK)
    marked = marked.select(
        "_start",
        F.expr(f"_index div {SEGMENT}").alias("segment"),
        "_index",
        "role",
        "text",
        F.when(F.coalesce(repeated, F.lit(False)), DUPLICATE).otherwise(F.col("fault")).cast("int").alias("fault"),
    )
    marked = store(marked, "conversations-marked")

    def weigh(part: pa.Table) -> pa.Table:
        part = part.sort_by("_index")
        turns = [(r[:1], f) for r, f in zip(part.column("role").to_pylist(), part.column("fault").to_pylist())]
        opening = part.column("segment")[0].as_py() == 0
        costs, edits = [], []
        for start in range(4):
            paths = segment_paths(turns, start, opening)
            for end in range(4):
                cost, letters = paths.get(end, (None, None))
                costs.append(cost)
                edits.append(letters)
        faults = [f for _, f in turns]
        initials = [i for i, _ in turns]
        row = {
            "_start": part.column("_start")[0].as_py(),
            "segment": part.column("segment")[0].as_py(),
            "costs": costs,
            "edits": edits,
            "blank": faults.count(BLANK),
            "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(TRUNCATED),
            "illegal": illegal(initials),
            "first": initials[0],
            "last": initials[-1],
        }
        return pa.Table.from_pylist([row], schema=weighed_arrow)

    weighed = (
        "_start long, segment long, costs array<long>, edits array<string>, blank long, duplicate long, truncated long, "
        "illegal long, first string, last string"
    )
    listed = {"costs": pa.list_(pa.int64()), "edits": pa.list_(pa.string()), "first": pa.string(), "last": pa.string()}
    weighed_arrow = pa.schema([(w.split()[0], listed.get(w.split()[0], pa.int64())) for w in weighed.split(", ")])
    segments = marked.drop("text").groupBy("_start", "segment").applyInArrow(weigh, weighed)
    chosen = "_start long, segment long, state long, cost long, edits string, blank long, duplicate long, truncated long, illegal long"
    ordered = segments.repartition("_start").sortWithinPartitions("_start", "segment")
    choices = store(ordered.mapInArrow(_choose, chosen), "conversations-choices")

    def edit(turns: pa.Table, choice: pa.Table) -> pa.Table:
        turns = turns.sort_by("_index")
        pairs = list(zip(turns.column("role").to_pylist(), turns.column("text").to_pylist()))
        lines = edited(pairs, choice.column("edits")[0].as_py(), choice.column("state")[0].as_py())
        whole = "\n".join(lines).encode("utf-8", "surrogatepass")
        columns = {n: choice.column(n).combine_chunks() for n in ("_start", "segment", "edits")}
        return pa.table({**columns, "lines": pa.array([len(lines)], pa.int64()), "made": pa.array([whole], pa.binary())})

    parts = marked.groupBy("_start", "segment").cogroup(choices.select("_start", "segment", "state", "edits").groupBy("_start", "segment"))
    parts = parts.applyInArrow(edit, "_start long, segment long, edits string, lines long, made binary")
    # a digest is made from front to back: one task per conversation reads its segments' lines, and holds one at a time
    parts = parts.repartition("_start").sortWithinPartitions("_start", "segment")
    digests = parts.mapInArrow(_join, "_start long, audit string, repaired_sha256 string")
    sums = choices.groupBy("_start").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    found = base.join(sums, "_start", "left").join(digests, "_start", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _FACTS]
    return found.select("conv", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def _choose(batches):
    """Of sorted segments, the state each begins in and its edits on the best path through all of them.

    For each state the undecided end of its best path is kept; what all paths share is written and forgotten.
    """
    names = ["_start", "segment", "state", "cost", "edits", "blank", "duplicate", "truncated", "illegal"]
    types = [pa.string() if n == "edits" else pa.int64() for n in names]
    out: list[tuple] = []
    current, last, ends = None, "", {BEGIN: (0, [])}

    def settle(ends):
        state = min((s for s in ACCEPTED if s in ends), key=lambda s: (ends[s][0], "".join(p[4] for p in ends[s][1])))
        out.extend(ends[state][1])

    def batch():
        rows, out[:] = list(out), []
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for received in batches:
        for row in received.to_pylist():
            if row["_start"] != current:
                if current is not None:
                    settle(ends)
                current, last, ends = row["_start"], None, {BEGIN: (0, [])}
            border = illegal([last, row["first"]]) if last is not None else 0
            counts = (row["blank"], row["duplicate"], row["truncated"], row["illegal"] + border)
            last = row["last"]
            found: dict[int, tuple[int, list]] = {}
            for state, (cost, tail) in ends.items():
                for end in range(4):
                    more, letters = row["costs"][4 * state + end], row["edits"][4 * state + end]
                    if more is None:
                        continue
                    path = (cost + more, [*tail, (current, row["segment"], state, more, letters, *counts)])
                    if end not in found or (path[0], "".join(p[4] for p in path[1])) < (found[end][0], "".join(p[4] for p in found[end][1])):
                        found[end] = path
            tails = [tail for _, tail in found.values()]
            shared = sum(1 for _ in _while_equal(tails))
            out.extend(tails[0][:shared])
            ends = {s: (cost, tail[shared:]) for s, (cost, tail) in found.items()}
        yield batch()
    if current is not None:
        settle(ends)
    yield batch()


def _while_equal(tails: list[list]):
    for step in zip(*tails):
        if any(other != step[0] for other in step):
            return
        yield step[0]


def _join(batches):
    """Edits and digest of sorted segments, conversation by conversation."""
    current, edits, state, begun = None, [], None, False
    done: list[tuple] = []

    def finish():
        done.append((current, "".join(edits), state.hexdigest()))

    for received in batches:
        for start, rows in groupby(zip(*(received.column(n).to_pylist() for n in ("_start", "edits", "lines", "made"))), lambda r: r[0]):
            if start != current:
                if current is not None:
                    finish()
                current, edits, state, begun = start, [], hashlib.sha256(), False
            for _, letters, lines, made in rows:
                edits.append(letters)
                if lines:
                    state.update(b"\n" + made if begun else made)
                    begun = True
        yield _results(done)
        done.clear()
    if current is not None:
        finish()
    yield _results(done)


def _results(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) if done else [()] * 3
    types = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["_start", "audit", "repaired_sha256"])
