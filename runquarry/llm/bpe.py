"""Byte-level BPE by padded numpy matrices: many pieces are merged at once, one pair per row and round."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runquarry.llm.common import mix64, parts_of, slices, worker_once

_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Merge ranks of a rank file: hashed pair table, single-byte ids, and the bytes of every id.

    The pair table maps (left id, right id) to the id of the joined bytes. It is open-addressed and filled and
    probed by whole arrays.
    """

    def __init__(self, lines: list[bytes]):
        pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        joined = [b""] * size
        for token, rank in self.ranks.items():
            joined[rank] = token
        self.lengths = np.array([len(t) for t in joined])
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.pool = np.frombuffer(b"".join(joined), dtype=np.uint8)
        self.bytes = np.full(256, -1, dtype=np.int32)
        for b in range(256):
            self.bytes[b] = self.ranks.get(bytes([b]), -1)
        if (self.bytes < 0).any():
            raise ValueError("the rank file lacks a single byte")
        found = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        self._fill(left << 32 | right, rank)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        slots = 1 << max(4, int(4 * max(len(keys), 1)).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.values = np.full(slots, -1, dtype=np.int64), np.full(slots, _NONE, dtype=np.int32)
        at = mix64(keys.astype(np.uint64)) & self.mask
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            put = np.flatnonzero(free)
            self.keys[at[put]] = keys[put]  # of several the last stays; the others go on to the next slot
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + np.uint64(1)) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's joined bytes, or the largest int32."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = mix64(keys.astype(np.uint64)) & self.mask
        out = np.where(self.keys[at] == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != keys).ravel() & (self.keys[at] >= 0).ravel() & (keys >= 0).ravel())
        flat, keys, at = out.ravel(), keys.ravel(), at.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            flat[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return flat.reshape(left.shape)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered at once."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) + np.repeat(self.begins[ids] - (ends - lengths), lengths)].tobytes()


def merge_bucket(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Ids of pieces of up to ``width`` bytes.

    The matrix holds one piece a row, padded with -1. A round finds each row's lowest-ranked pair, the leftmost of
    equals, joins it and closes the gap. Rows without a pair left are moved out, and columns that are padding
    everywhere are cut off, so a round costs only what is still open.
    """
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    sizes = np.array([len(p) for p in pieces])
    ids = np.where(np.arange(width) < sizes[:, None], vocabulary.bytes[raw], -1).astype(np.int32)
    out: list[np.ndarray] = [None] * n
    rows = np.arange(n)
    ranks = vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:])
    while True:
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
        done = low == _NONE
        if done.any():
            for i, r, m in zip(rows[done], ids[done], sizes[done]):
                out[i] = r[:m].copy()
            rows, ids, ranks, sizes, at, low = (x[~done] for x in (rows, ids, ranks, sizes, at, low))
        if not len(rows):
            return out
        sizes = sizes - 1
        here = np.arange(len(rows))
        columns = np.arange(ids.shape[1] - 1)
        moved = columns + (columns > at[:, None])
        ids[here, at] = low
        ids = np.take_along_axis(ids, moved, axis=1)
        narrow = int(sizes.max())
        ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], ranks.shape[1] - 1), axis=1)
        ids, ranks = np.ascontiguousarray(ids[:, :narrow]), np.ascontiguousarray(ranks[:, :max(narrow - 1, 0)])
        # only the pairs beside the joined one have changed
        for side in (-1, 0):
            j = at + side
            ok = np.flatnonzero((j >= 0) & (j < ranks.shape[1]))
            ranks[ok, j[ok]] = vocabulary.pair_ranks(ids[ok, j[ok]], ids[ok, j[ok] + 1])


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes], cells: int = 1 << 20) -> list[np.ndarray]:
    """Ids of each piece. Pieces are dealt to buckets of similar length (powers of the square root of two), and a
    bucket is worked off in matrices of about ``cells`` cells; a longer piece has a matrix of its own."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = vocabulary.ranks.get(p)
        if whole is not None:
            out[i] = np.array([whole], dtype=np.int32)
        elif p:
            buckets.setdefault(int(2 * np.log2(len(p))), []).append(i)
    for some in buckets.values():
        width = max(len(pieces[i]) for i in some)
        step = max(1, cells // width)
        for k in range(0, len(some), step):
            part = some[k:k + step]
            for i, ids in zip(part, merge_bucket(vocabulary, [pieces[i] for i in part], max(len(pieces[i]) for i in part))):
                out[i] = ids
    return out


def codec(path: str, pattern: str, most: int = 400_000, cut: bool = True):
    """(encode, vocabulary): ``encode`` maps texts to (ids, decimal text) parts.

    With ``cut`` a text is first parted at spaces before which every match of the pattern ends (``parts_of``: true of
    patterns whose matches take a leading space). Equal parts are matched and merged once and kept, up to ``most``.
    """
    import regex

    with open(path, "rb") as file:
        vocabulary = Vocabulary(file.read().splitlines())
    split = regex.compile(pattern).findall
    known: dict[str, tuple[np.ndarray, str]] = {}

    def encode(texts: list[str]) -> list[list[tuple[np.ndarray, str]]]:
        if len(known) > most:
            known.clear()
        parted = [parts_of(t) if cut else [t] for t in texts]
        new = list({p for parts in parted for p in parts if p not in known})
        pieces = [split(p) for p in new]
        distinct = list({x for some in pieces for x in some})
        merged = dict(zip(distinct, encode_pieces(vocabulary, [x.encode() for x in distinct])))
        for p, some in zip(new, pieces):
            ids = merged[some[0]] if len(some) == 1 else np.concatenate([merged[x] for x in some]) if some else np.empty(0, np.int32)
            known[p] = ids, " ".join(map(str, ids.tolist()))
        return [[known[p] for p in parts] for parts in parted]

    return encode, vocabulary


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False,
                  block_bytes: int = 1_000_000) -> DataFrame:
    """Encode every whole text with the ranks in ``path``, each match of ``pattern`` by itself, and decode the ids.

    One row per input row: the key, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space),
    ``decoded_sha256`` (of the decoded bytes), and with ``keep_ids`` also ``ids`` and ``decoded``. Rows are
    independent, so nothing is shuffled, and a text's memory is its own.

    Null or empty text: no ids, hashes of nothing. Null and repeated keys are kept as they are. Text outside all
    matches of the pattern is left out, as the tiktoken library does.
    """
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids

    def run(batches):
        encode, vocabulary = worker_once(f"bpe {path} {pattern}", lambda: codec(path, pattern))
        for batch in batches:
            for some in slices(batch, text, block_bytes):
                counts, digests, back, all_ids, decoded = [], [], [], [], []
                for parts in encode([t or "" for t in some.column(text).to_pylist()]):
                    ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
                    plain = vocabulary.decode(ids)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join([p[1] for p in parts if p[1]]).encode()).hexdigest())
                    back.append(hashlib.sha256(plain).hexdigest())
                    if keep_ids:
                        all_ids.append(ids)
                        decoded.append(plain)
                columns = [some.column(key), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)
