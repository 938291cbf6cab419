"""Languages of texts and of spans in mixed texts.

Character n-grams of labelled texts give every word a score per language. The script of a word, by code-point ranges, narrows
the languages that can have written it to those that use the script in the labelled texts. Viterbi decoding over the words,
with a penalty for each switch, labels spans; the language with most letters is the text's. Texts of a block are decoded side
by side, one word of each at a time, so the work is array arithmetic whatever the lengths.
"""

from __future__ import annotations

import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.bpe import blocks
from tabwright.llm.common import claim_worker, free_name
from tabwright.session import shuffle_partitions

#: The fit takes at most about so many labelled texts of a language, drawn by a hash of their id; every label is learned.
FIT_TEXTS = 1500
#: n-grams of these lengths are hashed to so many buckets.
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Share of the pooled n-gram frequencies in a language's own; n-grams overlap, so their logs are scaled down.
BACKOFF, SCALE = 0.01, 0.4
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that makes up so much of its letters; other languages lose so much per word.
SCRIPT_SHARE, NOT_CANDIDATE = 0.005, 40.0
#: Words whose scores a task keeps, words it scores at a time, and bytes of text that it decodes side by side.
KEPT_WORDS, SCORED_WORDS = 300_000, 16_384
BLOCK_CHARS = 4_000_000
UNKNOWN = "und"

#: First and last code points of scripts' letter ranges. Fixed values of the Unicode standard.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters or marks, each code point's script (0: other), and which are letters."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x32400)]
    letters = np.array([k in "LM" for k in kinds])
    alone = np.array([k == "L" for k in kinds])
    script = np.zeros(0x32400, np.int8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = i
    script[~letters] = 0
    return letters, script, alone


_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets of all words with the word of each, letters per word, and the script of each word's first letter."""
    letters, scripts, alone = _code_tables()
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.cumsum(codes == 10) - 1
    inside = np.where(codes < len(letters), codes, 0)
    letter = letters[inside]
    codes = np.where(letter, codes, 10)  # a boundary: n-grams may begin or end with one
    count = np.bincount(word[alone[inside]], minlength=len(words))[: len(words)]
    script = np.zeros(len(words), np.int64)
    at = np.flatnonzero(letter)[::-1]
    script[word[at]] = scripts[inside[at]]
    buckets, owners = [], []
    for n in GRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        good = letter[:size].copy() if n == 1 else np.ones(size, bool)
        for k in range(1, n - 1):
            good &= letter[k : k + size]
        if n == 2:
            good &= letter[:size] | letter[1 : 1 + size]
        value = np.full(size, n, np.uint64)
        for k in range(n):
            value = (value ^ codes[k : k + size].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        buckets.append((value[good] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[:size][good] if n == 1 else word[1 : 1 + size][good] if n > 2 else np.where(letter[:size], word[:size], word[1 : 1 + size])[good])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count, script
    return np.concatenate(buckets), np.concatenate(owners), count, script


class Model:
    """Languages, log-frequency tables [bucket, language] and candidate languages by script."""

    def __init__(self, languages: list[str], counts: np.ndarray, script_letters: np.ndarray):
        self.languages = languages
        total = np.maximum(counts.sum(0, keepdims=True), 1)
        pooled = (counts.sum(1, keepdims=True) + 1) / (counts.sum() + len(counts))
        own = (counts / total + BACKOFF * pooled) / (1 + BACKOFF)
        self.weights = (SCALE * (np.log(own) - np.log(pooled))).astype(np.float32)
        share = script_letters / np.maximum(script_letters.sum(0, keepdims=True), 1)
        candidates = share >= SCRIPT_SHARE
        self.fine = np.where(candidates.any(1, keepdims=True), np.where(candidates, 0, -NOT_CANDIDATE), 0).astype(np.float32)
        self.known = candidates.any(1)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [word, language] and letters per word; 0 for all languages where the script is nobody's."""
        if len(words) > SCORED_WORDS:  # the arrays of all their n-grams would be the most memory a task takes
            parts = [self.word_scores(words[i : i + SCORED_WORDS]) for i in range(0, len(words), SCORED_WORDS)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        buckets, owners, letters, script = word_grams(words)
        scores = np.empty((len(words), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            scores[:, i] = np.bincount(owners, self.weights[buckets, i], minlength=len(words))[: len(words)]
        scores[(letters == 0) | ~self.known[script]] = 0
        scores += np.where(letters[:, None] > 0, self.fine[script], 0)
        return scores, letters


def viterbi(flat: np.ndarray, lengths: np.ndarray, scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of every word. flat: word numbers of all texts, one after another."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts with more than t words
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    stays, bests = [], []
    for t in range(steps):
        m = running[t]
        v = value[:m]
        best = v.argmax(1)
        top = v[np.arange(m), best][:, None]
        stay = v >= top - penalty
        np.maximum(v, top - penalty, out=v)
        v -= top
        v += scores[flat[starts[:m] + t]]
        stays.append(stay)
        bests.append(best.astype(np.int16))
    labels = np.zeros(len(flat), np.int16)
    state = value.argmax(1) if len(sizes) else np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        m = running[t]
        s = state[:m]
        labels[starts[:m] + t] = s
        state[:m] = np.where(stays[t][np.arange(m), s], s, bests[t])
    return labels


class _Numbers(dict):
    """Words in order of first appearance."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model from labelled rows: null labels and texts are left out; the sample's bound is FIT_TEXTS a language."""
    spark = docs.sparkSession
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_of_label"))  # one row per language
    languages = sorted(r["_label"] for r in counts.collect())
    place = {name: i for i, name in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS) + 1, 0)))
    labelled = labelled.select(
        F.col(label).alias("_label"),
        F.col(text).cast("string").alias("_text"),
        F.pmod(F.xxhash64(F.col(id_column), F.lit("fit")), F.lit(1_000_000)).alias("_turn"),
    )
    drawn = F.col("_turn") < F.least(F.lit(1.0), F.lit(float(FIT_TEXTS)) / F.col("_of_label")) * 1_000_000
    sample = labelled.join(F.broadcast(counts), "_label").filter(drawn).select("_label", "_text")
    width = len(languages)

    def count(batches):
        claim_worker("languages")
        grams = np.zeros((BUCKETS, width), np.int64)
        scripts = np.zeros((len(SCRIPTS) + 1, width), np.int64)
        for whole in batches:
            for batch in blocks(whole, "_text"):
                labels = batch.column("_label").to_pylist()
                for name, value in zip(labels, batch.column("_text").to_pylist()):
                    words = value.casefold().split()
                    if not words:
                        continue
                    buckets, _, letters, script = word_grams(words)
                    np.add.at(grams[:, place[name]], buckets, 1)
                    np.add.at(scripts[:, place[name]], script, letters)
        both = np.concatenate([grams, scripts])
        rows, columns = np.nonzero(both)
        arrays = [pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), pa.array(both[rows, columns], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "column", "n"])

    counted = sample.mapInArrow(count, "row long, column long, n long").groupBy("row", "column").agg(F.sum("n").alias("n"))
    found = counted.repartition(min(8, shuffle_partitions(spark))).toArrow()  # at most BUCKETS x languages numbers
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, width), np.int64)
    table[found["row"].to_numpy(), found["column"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, table[:BUCKETS], table[BUCKETS:])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred, score (the share of letters in that language) and lang_spans.

    lang_spans has language:first word:end word of each span, joined by commas; words are what white space separates. A text
    that is null or has no letter is `und` with score 0; so is any text if no language was learned. Letters of a script that
    no learned language uses count for none: if a text has no others, its language is the first by the alphabet, score 0.
    Columns of docs that are named like outputs are replaced.
    """
    made = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_spans", T.StringType()),
    ]
    whole_text = free_name(docs, "_text")
    source = docs.withColumn(whole_text, F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(*[f.name for f in made])
    kept = [f for f in source.schema.fields if f.name != whole_text]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim_worker("languages")
        model = shared.value
        languages = model.languages
        numbers, scores = _Numbers(), np.zeros((0, len(languages)), np.float32)
        letters = np.zeros(0, np.int64)
        for whole in batches:
            for batch in blocks(whole, whole_text, BLOCK_CHARS):
                if len(numbers) > KEPT_WORDS:
                    numbers = _Numbers()
                    scores, letters = scores[:0], letters[:0]
                texts = batch.column(whole_text).to_pylist()
                parts = []
                for value in texts:
                    words = value.casefold().split()
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                del texts
                if len(numbers) > len(scores):
                    new = list(islice(numbers, len(scores), None))
                    more, counted = model.word_scores(new)
                    scores, letters = np.concatenate([scores, more]), np.concatenate([letters, counted])
                lengths = np.fromiter(map(len, parts), np.int64, len(parts))
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                labels = viterbi(flat, lengths, scores) if languages else np.zeros(len(flat), np.int16)
                owner = np.repeat(np.arange(len(parts)), lengths)
                count = letters[flat]
                told = np.zeros(len(flat), np.int64) if not languages else np.where(scores[flat].any(1), count, 0)
                width = max(1, len(languages))
                mass = np.bincount(owner * width + labels, told, minlength=len(parts) * width).reshape(len(parts), width)
                all_letters = np.bincount(owner, count, minlength=len(parts))
                best = mass.argmax(1)
                some = (all_letters > 0) & bool(languages)
                share = mass[np.arange(len(parts)), best] / np.maximum(all_letters, 1)
                predicted = [languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), some.tolist())]
                spans, end = [], np.cumsum(lengths)
                for i, ok in enumerate(some.tolist()):
                    own = labels[end[i] - lengths[i] : end[i]]
                    if not ok:
                        spans.append("")
                        continue
                    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                    spans.append(",".join(f"{languages[own[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:])))
                columns = [batch.column(f.name) for f in kept]
                columns += [pa.array(predicted, pa.string()), pa.array(np.where(some, share, 0.0)), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + made])

    return source.mapInArrow(run, T.StructType(kept + made))


def held_out(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs with held_out: whether the id's checksum, divided by four, leaves two. A null id counts as its empty text."""
    checksum = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    return docs.withColumn("held_out", (checksum % 4) == 2)


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language that wrote at least so much of it, with all their columns."""
    # asked of the prediction only; docs keeps columns of its own that are named like it
    judged = docs.select(F.struct(*docs.columns).alias("_all"), F.col("text").alias("_judged"))
    judged = predict(judged, model, "_judged")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("_all.*")
