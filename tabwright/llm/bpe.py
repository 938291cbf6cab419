"""Byte-level BPE by a pair occurrence index.

A partition's texts are cut into pre-tokens; the different ones among them are laid out once, byte by byte. An index maps each
adjacent pair that has a merge rank to all its positions in that layout. The lowest active rank is applied to its whole list at
once, the pairs that the merges create are appended to the lists of their ranks, and so on in ascending order. A pair made by
a merge always contains the new token, so its rank is higher than the current one: every rank is visited once. Texts are then
put together from their pre-tokens' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import claim_worker, free_name

#: The pre-token pattern of byte-level BPE vocabularies. Fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between white space, or before the end after white space: only there a cut before a space would move a boundary.
_JOINED_SPACE = re.compile(r"\s (?=\s|\Z)")
#: Pieces kept between batches; beyond that a worker begins anew.
KEPT_PIECES = 500_000
#: Characters of text encoded at a time.
BLOCK_CHARS = 4_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """A vocabulary file of the tokenizers format with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("two merges make the same token; ranks would not ascend")
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in characters], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = [(int(a), int(b), vocab[x + y]) for (x, y), a, b in zip(merges, left, right)]
        keys = left * self.size + right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self.pre_token = regex.compile(PRE_TOKEN)
        self.pieces: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 where there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        ends = np.cumsum(lengths)
        following = np.arange(1, n + 1)
        previous = np.arange(-1, n - 1)
        following[ends[lengths > 0] - 1] = -1
        previous[(ends - lengths)[lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            if len(positions) == 0:
                return
            ranks = self._ranks(ids[positions], ids[following[positions]])
            found = ranks >= 0
            ranks, positions = ranks[found], positions[found]
            if len(ranks) == 0:
                return
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for i, rank in enumerate(ranks[starts[:-1]].tolist()):
                part = positions[starts[i] : starts[i + 1]]
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        add(np.flatnonzero(following >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            a, b, new = self.merged[rank]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            second = following[at]
            right = (ids[at] == a) & (second >= 0) & (ids[second] == b)
            if not right.all():
                at, second = at[right], second[right]
            if a == b and len(at) > 1:  # aaa: from the left, every other pair of a chain
                first = np.concatenate([[True], second[:-1] != at[1:]])
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(first, place, 0))
                even = (place - start) % 2 == 0
                at, second = at[even], second[even]
            if len(at) == 0:
                continue
            after = following[second]
            ids[at] = new
            ids[second] = -1
            following[at] = after
            inner = after >= 0
            previous[after[inner]] = at[inner]
            before = previous[at]
            add(np.concatenate([before[before >= 0], at[inner]]))
        alive = ids >= 0
        counts = np.add.reduceat(alive, (ends - lengths)[lengths > 0]) if n else np.zeros(0, np.int64)
        per_word = np.zeros(len(words), np.int64)
        per_word[lengths > 0] = counts
        return ids[alive], per_word

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet; ids are kept as little-endian 32-bit integers."""
        cut = {p: self.pre_token.findall(p) for p in pieces}
        words = list({w for tokens in cut.values() for w in tokens})
        ids, counts = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        data = ids.astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        starts = [0, *ends[:-1]]
        known = {w: data[i:j] for w, i, j in zip(words, starts, ends)}
        for p, tokens in cut.items():
            self.pieces[p] = b"".join(map(known.__getitem__, tokens))

    def cut(self, text: str) -> list[str]:
        """Pieces that can be encoded on their own: a text is cut before single spaces, where pre-tokens begin anyway."""
        if not text:
            return []
        if _JOINED_SPACE.search(text):
            return self.pre_token.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + p for p in rest]] if head else [" " + p for p in rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.special_split is not None and any(s in text for s in self.special):
                pieces: list[str] = []
                for part in self.special_split.split(text):
                    pieces += [part] if part in self.special else self.cut(part)
                cut.append(pieces)
            else:
                cut.append(self.cut(text))
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        new.difference_update(self.pieces)
        for token in self.special.keys() & new:
            self.pieces[token] = np.array([self.special[token]], "<u4").tobytes()
            new.discard(token)
        if new:
            self._learn(new)
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """A worker's vocabulary; its known pieces serve later tasks of the same worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_CHARS):
    """Slices of a batch, each of about so many bytes of text at most, or of one row."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    for i, j in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(i), int(j - i))


def encode_decode(
    docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text", outputs: str = "digests"
) -> DataFrame:
    """Encode every whole text, and decode the ids again. One row per input row.

    outputs="digests": id, n_tokens, ids_sha256, decoded_sha256; outputs="ids": all columns of docs, then n_tokens,
    token_ids, decoded_equal (whether decoding gave back the text). Null text counts as empty: no tokens. A special token's
    string in a text becomes that token. Columns of docs that are named like outputs are replaced.
    """
    path = path or default_path()
    digests = outputs == "digests"
    whole_text = free_name(docs, "_text")
    made = [T.StructField("n_tokens", T.LongType())]
    if digests:
        source = docs.select(F.col(id_column), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(whole_text))
        made += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        made += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_equal", T.BooleanType())]
        source = docs.withColumn(whole_text, F.coalesce(F.col(text).cast("string"), F.lit("")))
        source = source.drop(*[f.name for f in made])
    kept = [f for f in source.schema.fields if f.name != whole_text]

    def run(batches):
        claim_worker("bpe", _LOADED.clear)
        bpe = loaded(path)
        for whole in batches:
            for batch in blocks(whole, whole_text):
                texts = batch.column(whole_text).to_pylist()
                ids = bpe.encode(texts)
                decoded = [bpe.decode(x) for x in ids]
                columns = [batch.column(f.name) for f in kept]
                columns.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
                if digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                    columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]))
                else:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                    columns.append(pa.array([x == y for x, y in zip(decoded, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + made])

    return source.mapInArrow(run, T.StructType(kept + made))
