"""Repeated passages of a corpus, byte by byte, from merged Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runquarry.llm.common import fixed, mix64, slices, text_bytes

_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)
# Bytes that UTF-8 never has: the end of a segment, and of a shard.
_END, _LAST = 0xFF, 0xFE


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of bytes, and the factors that make the hash of a stretch independent of its place."""
    steps = np.full((2, len(data) + 1), np.uint64(1))
    steps[0, 1:], steps[1, 1:] = _FACTOR, _INVERSE
    powers, back = np.multiply.accumulate(steps, axis=1)
    letters = mix64(np.arange(256, dtype=np.uint64), 21)[data]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[:-1], dtype=np.uint64)]), back


def stretch_hashes(sums: np.ndarray, back: np.ndarray, begins: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    return mix64(mix64((sums[ends] - sums[begins]) * back[begins], salt) + (ends - begins).astype(np.uint64), salt)


def segments(column: pa.Array, length: int, gram: int):
    """Runs of windows of ``length`` bytes that share their least ``gram``-byte hash, over whole texts.

    Returns (text number, first window, windows, least hash, content hash, twice) per run. Equal windows have the same
    least hash, so they meet wherever runs are brought together by it. ``twice`` tells that the least gram occurs
    more than once in the run, without which its own windows cannot be equal.
    """
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    none = np.empty(0, np.int64)
    if not windows.sum():
        return none, none, none, none, none, none.astype(bool)
    sums, back = _sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = stretch_hashes(sums, back, at, at + gram, 31)
    width, span, least = length - gram + 1, 1, grams
    while span < width:
        shift = min(span, width - span)
        least = np.minimum(least[:-shift], least[shift:])
        span += shift
    owner = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(int(windows.sum())) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    value, begin = value[first], start[first]
    twice = np.zeros(len(first), bool)
    for i in range(0, len(first), 4096):
        here = slice(i, i + 4096)
        a = grams[begin[here, None] + np.arange(width)] == value[here, None]
        b = grams[(begin + count - 1)[here, None] + np.arange(width)] == value[here, None]
        twice[here] = (a.sum(1) > 1) | (b.sum(1) > 1) | (a.argmax(1) != b.argmax(1) + count[here] - 1)
    content = stretch_hashes(sums, back, begin, begin + count + length - 1, 32)
    return owner[first], begin - offsets[owner[first]], count, value.view(np.int64), content.view(np.int64), twice


def shard_bwt(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform) of a text whose last byte is found nowhere else in it.

    Prefix doubling over numbers: the first step compares 7 bytes at once.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 8 | np.roll(text, -j)
    _, rank = np.unique(key, return_inverse=True)
    depth, order = 7, None
    while True:
        key = rank * (n + 1) + np.roll(rank, -depth)
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order, np.roll(text, 1)[order]
        depth *= 2


def merged_blocks(transforms: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For every row of every shard's transform the block of its suffix in the merged order: rows share a block if and
    only if their suffixes agree in ``length`` bytes.

    The interleave of the shards is refined round by round from the transforms alone; no suffix is compared or sorted
    anew. At first rows are interleaved by their first byte. If the blocks of common prefixes of d bytes are known,
    those of d + e bytes follow from the pair (own block, block of the row d bytes on), which LF-mapping gives; in each shard
    these pairs already ascend, so a round is a merge of sorted runs. d doubles, so the common prefix of 200 bytes
    takes nine rounds in place of 200.
    """
    begins = np.concatenate([[0], np.cumsum([len(t) for t in transforms])])
    n = int(begins[-1])
    # row of the suffix one byte on: the inverse of the LF-mapping
    onward = np.concatenate([np.argsort(t, kind="stable") + b for t, b in zip(transforms, begins)])
    key = np.concatenate([np.sort(t) for t in transforms]).astype(np.int64)

    def blocks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        out = np.empty(n, np.int64)
        out[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return out

    block, depth, steps = blocks(key), 1, {1: onward}
    while 2 * depth <= length:
        block = blocks(block * n + block[steps[depth]])
        steps[2 * depth] = steps[depth][steps[depth]]
        depth *= 2
    rest, bit, on = length - depth, 1, np.arange(n)
    while rest:
        if rest & 1:
            on = steps[bit][on]
        rest, bit = rest >> 1, bit << 1
    if length > depth:
        block = blocks(block * n + block[on])
    return [block[a:b] for a, b in zip(begins[:-1], begins[1:])]


def repeated_windows(texts: list[bytes], length: int, shard_bytes: int = 1 << 17) -> list[np.ndarray]:
    """Per text the starts of its windows of ``length`` bytes that occur anywhere else among the texts.

    Texts are dealt to shards; each shard is transformed by itself, the transforms are merged, and the intervals of
    the merged order with a common prefix of ``length`` bytes and at least two rows are the repeats.
    """
    shards, size = [[]], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(t) + 1
    joined = []
    for some in shards:
        raw = np.frombuffer(bytes([_END]).join([texts[i] for i in some]) + bytes([_LAST]), dtype=np.uint8)
        joined.append((raw, *shard_bwt(raw)))
    block = merged_blocks([t for _, _, t in joined], length)
    rows = np.bincount(np.concatenate(block))
    out: list[np.ndarray] = [None] * len(texts)
    for (raw, order, _), b, some in zip(joined, block, shards):
        repeated = np.zeros(len(raw), bool)
        repeated[order] = rows[b] > 1
        at = 0
        for i in some:
            n = max(len(texts[i]) - length + 1, 0)  # later windows would cross the end
            out[i] = np.flatnonzero(repeated[at:at + n])
            at += len(texts[i]) + 1
    return out


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as runs [a, b)."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + 1


def removed_spans(size: int, windows: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which of ``size`` bytes are covered by the windows with starts in [a, b)."""
    edge = np.zeros(size + 1, np.int64)
    if windows:
        a, b = np.array(windows).T
        np.add.at(edge, a, 1)
        np.add.at(edge, np.minimum(b + length - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 32, bucket_bytes: int = 1 << 20,
                   hot_bytes: int = 1 << 22, keep: str | None = None, block_bytes: int = 1_000_000) -> DataFrame:
    """Remove every byte that is covered by a string of ``length`` bytes which also starts anywhere else in the corpus.

    Texts are UTF-8 bytes; windows do not cross texts, those of one text count as elsewhere, overlaps included, and all
    are judged on the input. Returns one row per row: the key, ``n_bytes``, ``n_removed``, ``n_spans`` (runs removed)
    and ``kept_sha256``; with ``keep`` all columns of ``docs`` instead, ``keep`` being the text column that is replaced by
    what is left (bytes of a character that was cut are dropped).

    1. Texts are cut in runs of windows with the same least gram hash (:func:`segments`); two equal windows always
       have the same. A least hash that occurs once in the corpus has no repeats, which most do not; its runs go.
    2. Runs of equal content are counted as one. If there are several, all their windows are repeats.
    3. Different contents with one least hash are dealt to buckets of about ``bucket_bytes`` by that hash. In a bucket
       they are split into shards, every shard gets its Burrows-Wheeler transform, and the transforms are
       merged by interleave refinement (:func:`merged_blocks`); repeats are the intervals of the merged order.
    4. A least hash whose contents exceed ``hot_bytes`` (a passage that a great part of all texts shares, each time in other
       surroundings) would make an unbounded bucket; there single windows are counted by a 128-bit hash.
    5. Repeats go back to all runs of their content and are united per text.

    Contents are told apart by two 64-bit hashes. Null text: 0 bytes, hash of nothing. Null and repeated keys are
    rows as others. Texts shorter than ``length`` keep all. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rid = F.xxhash64(F.lit(17), F.col(key), plain)
    rows = docs.select(rid.alias("rid"), plain.alias("t"))

    def cut(batches):
        for batch in batches:
            for some in slices(batch, "t", block_bytes):
                owner, first, count, mh, ch, twice = segments(some.column("t"), length, gram)
                ids = some.column("rid").to_numpy()[owner]
                place = first << 32 | count << 1 | twice
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), pa.array(mh), pa.array(ch)], names=["rid", "place", "mh", "ch"])

    # place: first window << 32 | windows << 1 | twice
    all_runs = fixed(rows.where(F.octet_length("t") >= length).mapInArrow(cut, "rid bigint, place bigint, mh bigint, ch bigint"), "runs")
    twice = F.col("place").bitwiseAND(F.lit(1))
    seen = all_runs.groupBy("mh").agg(F.count("*").alias("c"), F.max(twice).alias("w")).where("c > 1 or w = 1").select("mh")
    live = fixed(all_runs.join(seen, "mh"), "live-runs")
    windows = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    first = F.shiftright("place", 32).cast("int")
    contents = live.groupBy("mh", "ch").agg(F.count("*").alias("c"), F.min(F.struct("rid", "place")).alias("at"))
    contents = fixed(contents.select("mh", "ch", "c", F.col("at.rid").alias("rid"), F.col("at.place").alias("place")), "contents")
    per_hash = contents.groupBy("mh").agg(F.count("*").alias("k"), F.max(twice).alias("w"), F.sum(windows + length - 1).alias("bytes")).where("k > 1 or w = 1")
    total = per_hash.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    wanted = contents.join(per_hash.select("mh", (F.col("bytes") > hot_bytes).alias("hot")), "mh")
    lists_ = wanted.groupBy("rid").agg(F.collect_list(F.struct("mh", "ch", first.alias("a"), windows.alias("n"), "hot")).alias("l"))

    def fetch(batches):
        for batch in batches:
            for some in slices(batch, "t", block_bytes):
                found = []
                for t, items in zip(some.column("t").to_pylist(), some.column("l").to_pylist()):
                    raw = t.encode()
                    found += [(x["mh"], x["ch"], x["hot"], raw[x["a"]:x["a"] + x["n"] + length - 1]) for x in items]
                names = ["mh", "ch", "hot", "b"]
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=names)

    # rows that repeat id and text hold the same bytes, so one of them would do; equal contents are told apart by mh, ch
    texts = fixed(rows.join(lists_, "rid").mapInArrow(fetch, "mh bigint, ch bigint, hot boolean, b binary"), "segments")
    buckets = max(1, math.ceil(total / bucket_bytes))

    def solve(table: pa.Table) -> pa.Table:
        ids = list(zip(table.column("mh").to_pylist(), table.column("ch").to_pylist()))
        unique = dict(zip(ids, table.column("b").to_pylist()))
        out = []
        for (mh, ch), starts in zip(unique, repeated_windows(list(unique.values()), length)):
            out += [(mh, ch, int(a), int(b)) for a, b in zip(*runs(starts))]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["mh", "ch", "a", "b"])

    cold = texts.where("not hot").select(F.pmod(F.xxhash64("mh"), F.lit(buckets)).alias("bucket"), "mh", "ch", "b")
    solved = cold.groupBy("bucket").applyInArrow(solve, "mh bigint, ch bigint, a int, b int")

    def single(batches):
        for batch in batches:
            for some in slices(batch, "b", block_bytes // 8):
                for mh, ch, raw in zip(*(some.column(c).to_pylist() for c in ("mh", "ch", "b"))):
                    data = np.frombuffer(raw, dtype=np.uint8)
                    sums, back = _sums(data)
                    at = np.arange(len(data) - length + 1)
                    h = [stretch_hashes(sums, back, at, at + length, k).view(np.int64) for k in (41,)]
                    h.append(stretch_hashes(*_sums(data[::-1]), len(data) - at - length, len(data) - at, 42).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), mh)), pa.array(np.full(len(at), ch)), pa.array(at.astype(np.int32)),
                                                      pa.array(h[0]), pa.array(h[1])], names=["mh", "ch", "a", "h", "i"])

    hot = texts.where("hot").dropDuplicates(["mh", "ch"]).mapInArrow(single, "mh bigint, ch bigint, a int, h bigint, i bigint")
    often = hot.groupBy("h", "i").count().where("count > 1").drop("count")
    hot = hot.join(often, ["h", "i"]).select("mh", "ch", "a", (F.col("a") + 1).alias("b"))
    marks = fixed(solved.unionByName(hot) if wanted.where("hot").limit(1).count() else solved, "repeats")

    # contents that occur once are at one known place; the others are looked up among all runs
    once = contents.where("c = 1").join(marks, ["mh", "ch"]).select("rid", (first + F.col("a")).alias("a"), (first + F.col("b")).alias("b"))
    several = live.join(contents.where("c > 1").select("mh", "ch"), ["mh", "ch"]).select("rid", first.alias("a"), (first + windows).alias("b"))
    spans = once.unionByName(several).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("_rq_spans"))

    kept_columns = docs.columns if keep else [key]
    names = kept_columns if keep else [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def finish(batches):
        for batch in batches:
            for some in slices(batch, "_rq_t", block_bytes):
                out = []
                for t, found in zip(some.column("_rq_t").to_pylist(), some.column("_rq_spans").to_pylist()):
                    raw = t.encode()
                    gone = removed_spans(len(raw), [(x["a"], x["b"]) for x in found or []], length)
                    left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(raw), int(gone.sum()), spans, left))
                if keep:
                    fresh = pa.array([o[3].decode("utf-8", "ignore") if o[1] else None for o in out], pa.string())
                    columns = [pa.compute.coalesce(fresh, some.column(i)) if c == keep else some.column(i) for i, c in enumerate(kept_columns)]
                else:
                    columns = [some.column(0), *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                               pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    base = docs.select(*[docs[c] for c in kept_columns], rid.alias("_rq_rid"), plain.alias("_rq_t"))
    joined = base.join(spans.withColumnRenamed("rid", "_rq_span_rid"), F.col("_rq_rid") == F.col("_rq_span_rid"), "left")
    schema = docs.schema if keep else f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.select(*[base[c] for c in kept_columns], "_rq_t", "_rq_spans").mapInArrow(finish, schema)
