"""Token ids of whole columns by a public byte-pair vocabulary.

The vocabulary is a ``.tiktoken`` file (a byte string in base64 and its rank on
each line) whose path is a parameter. A text is cut by the vocabulary's pattern;
each distinct piece is encoded once per batch, and all pieces of a batch are
merged together: pieces of similar length form one padded matrix of ids, every
row merges its leftmost pair of least rank each round, ranks come from a hash
table of pairs, and rows that have no pair left drop out.

Null and empty texts have the empty list. Names of special tokens are ordinary
text. Spark partitions the rows; no step needs a shuffle.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII alone.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: No pair of this rank exists.
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this merge all places of their best pair in a round.
LONG = 256
#: Pieces remembered by a worker before it starts again.
REMEMBERED = 1 << 20


class PairTable:
    """Rank of a pair of ids, in an open hash table over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        self.probes = 1
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1 if len(todo) else 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair merges to, which is also its rank; NONE without one."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1) & (left >= 0) & (right >= 0))
        where = at[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            where = (where + 1) & self.mask
            seen = self.keys[where]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[where[hit]]
            more = ~hit & (seen != -1)
            open_, where = open_[more], where[more]
        return out


class Encoder:
    """A vocabulary file and the pieces this worker has met."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pairs = [(l, r, n) for token, n in ranks.items() for k in range(1, len(token)) if (l := ranks.get(token[:k])) is not None and (r := ranks.get(token[k:])) is not None]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*pairs, strict=True)))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: each round merges every place of the pair of least rank, from the left."""
        while len(ids) > 1:
            ranks = self.pairs.look(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:  # of overlapping places, as in "aaa", every second one of a run
                new_run = np.concatenate([[True], np.diff(at) > 1])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def _bucket(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of ids, padded with -1 at the right, merged until no row has a pair."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(ids)
        row = np.arange(len(ids))
        ranks = self.pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row) and ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k][ids[k] >= 0]
            ids, ranks, row, at, best = (x[~done] for x in (ids, ranks, row, at, best))
            k, column = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[k, at] = best
            take = column + (column > at[:, None])  # close the gap that the merged pair leaves
            ids = np.take_along_axis(ids, take, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], len(column) - 1), axis=1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ranks.shape[1])
                ranks[k[ok], side[ok]] = self.pairs.look(ids[k[ok], side[ok]], ids[k[ok], side[ok] + 1])
        for k, n in enumerate(row):
            out[n] = ids[k][ids[k] >= 0]
        return out

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(b) for b in raw])
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        width = np.where(size <= 8, size, -(-size // 8) * 8)
        order = np.argsort(width, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(width[order]) > 0) + 1):
            n = int(width[group[0]])
            for part in np.array_split(group, max(1, len(group) * n // 2_000_000)):
                if n > LONG:
                    done = [self._long(self.byte[np.frombuffer(raw[i], np.uint8)]) for i in part]
                else:
                    ids = np.full((len(part), n), -1, np.int32)
                    ids[np.arange(n) < size[part][:, None]] = self.byte[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                    done = self._bucket(ids)
                for i, x in zip(part, done, strict=True):
                    found[i] = x
        length = np.array([len(x) for x in found], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, *found])

    def _pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The place of every piece of every text, and how many pieces each text has."""
        if len(self.place) > REMEMBERED:
            self.forget()
        place, new = self.place, []
        places, counts = [], np.zeros(len(texts), np.int64)
        known = place.__getitem__
        for n, text in enumerate(texts):
            if not text:
                continue
            found = (self.ascii if text.isascii() else self.pattern).findall(text)
            try:
                at = np.fromiter(map(known, found), np.int64, len(found))
            except KeyError:
                for piece in found:
                    if piece not in place:
                        place[piece] = len(place)
                        new.append(piece)
                at = np.fromiter(map(known, found), np.int64, len(found))
            places.append(at)
            counts[n] = len(found)
        if new:
            self._learn(new)
        return np.concatenate(places) if places else np.zeros(0, np.int64), counts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        places, pieces = self._pieces(texts)
        total = np.concatenate([[0], np.cumsum(self.length[places])])
        ends = np.cumsum(pieces)
        return total[ends] - total[ends - pieces]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        places, pieces = self._pieces(texts)
        length = self.length[places]
        ends = np.cumsum(length)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[places] - (ends - length), length)
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])]
        return pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(self.flat[take]))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder of a vocabulary for each Python worker."""
    return Encoder(path)


def _small(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, so that few long texts are held at once."""
    for batch in batches:
        parts = max(1, min(batch.num_rows, batch.nbytes // most))
        step = -(-batch.num_rows // parts) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the token ids of ``text_column``, for every row.

    Null and empty texts give an empty list; repeated rows and null ids stay as
    they are; other columns are not read.
    """
    given = df.select(F.col(id_column), F.col(text_column).cast("string").alias("__text"))
    schema = T.StructType([given.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), e.encode(batch.column(1).to_pylist())], names=[id_column, "ids"])

    return given.mapInArrow(run, schema)


def count_tokens(df: DataFrame, vocabulary: str, text_column: str = "text", name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text_column`` and with ``name``, its number of tokens (0 for null)."""
    given = df.select(*[c for c in df.columns if c not in (text_column, name)], F.col(text_column).cast("string").alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in _small(batches):
            count = pa.array(e.counts(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], count], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)
