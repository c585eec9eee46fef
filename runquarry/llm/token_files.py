"""Token ids of a corpus as Simple-8b words in blocks, written and read as distributed files."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runquarry.llm.common import ODD, lists, parts_of, slices, worker_once

# Selector -> (ids in a word, bits of each). Selector 15 is the escape: one id in 60 bits.
# Selectors 0 and 1 hold runs of zeros.
_COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
_BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


_MINI = 1024  # ids of a mini-block


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Simple-8b words of non-negative ids below 2**60, little-endian, the selector in the top four bits; and the
    number of words before each mini-block of 1024 ids, any of which can be decoded alone.

    Every word takes the selector that holds the most ids. Whether a selector fits is found for all positions at
    once by sliding maxima of the widths; then all mini-blocks are worked off together, one word of each a step.
    The last word of a mini-block may have unused slots.
    """
    n = len(ids)
    if not n:
        return b"", []
    lanes = -(-n // _MINI)
    grid = np.zeros((lanes, _MINI + 240), np.uint64)  # beyond the end anything fits
    tail = np.zeros(lanes * _MINI, np.uint64)
    tail[:n] = ids
    grid[:, :_MINI] = tail.reshape(lanes, _MINI)
    if tail.max() >= 1 << 53:
        width = np.array([int(x).bit_length() for x in grid.ravel()]).reshape(grid.shape)
        if width.max() > 60:
            raise ValueError("ids must be below 2**60")
    else:
        width = np.frexp(grid.astype(np.float64))[1]
    most, span = width.astype(np.uint8), 1
    best = np.full((lanes, _MINI), 15, dtype=np.uint8)
    for s in range(14, -1, -1):
        while span < _COUNTS[s]:  # max over the next `span` widths
            shift = min(span, int(_COUNTS[s]) - span)
            most = np.maximum(most[:, :-shift], most[:, shift:])
            span += shift
        np.putmask(best, most[:, :_MINI] <= _BITS[s], np.uint8(s))
    size = np.full(lanes, _MINI)
    size[-1] = n - (lanes - 1) * _MINI
    lane, at, found = np.arange(lanes), np.zeros(lanes, np.int64), []
    while len(lane):
        chosen = best[lane, at]
        found.append((lane, at, chosen))
        at = at + _COUNTS[chosen]
        open_ = at < size[lane]
        lane, at = lane[open_], at[open_]
    lane, at, chosen = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(lane, kind="stable")
    lane, chosen, place = lane[order], chosen[order], (lane * grid.shape[1] + at)[order]
    words, flat = chosen.astype(np.uint64) << np.uint64(60), grid.ravel()
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        for k in range(_COUNTS[s] if len(rows) else 0):
            words[rows] |= flat[place[rows] + k] << np.uint64(k * _BITS[s])
    return words.astype("<u8").tobytes(), np.searchsorted(lane, np.arange(lanes)).tolist()


def unpack(data: bytes, offsets: list[int], n: int) -> np.ndarray:
    """The ``n`` ids of packed words, decoded selector by selector for all words of all mini-blocks at once."""
    words = np.frombuffer(data, dtype="<u8")
    if not len(words):
        return np.empty(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(_COUNTS[chosen]) - _COUNTS[chosen]
    lane = np.repeat(np.arange(len(offsets)), np.diff([*offsets, len(words)]))
    begin = before - before[offsets][lane] + lane * _MINI
    end = (lane + 1) * _MINI
    out = np.zeros(len(offsets) * _MINI, dtype=np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(_BITS[s])) - 1)
        for k in range(_COUNTS[s] if len(rows) else 0):
            ok = rows[begin[rows] + k < end[rows]]
            out[begin[ok] + k] = (words[ok] >> np.uint64(k * _BITS[s])) & mask
    return out[:n]


def encoder(path: str, most: int = 200_000_000, longest: int = 100):
    """A function from texts to (all ids, ids per text), by the tokenizers library.

    Special tokens are not added. Equal parts of texts (``parts_of``) of up to ``longest`` characters are encoded once and their
    ids kept as bytes, which the ids of a text are joined from; beyond ``most`` bytes the table is emptied. A text that
    names an added token is a part as a whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    named = re.compile("|".join(map(re.escape, added))) if added else None
    line = tokenizer.encode("\n", add_special_tokens=False).ids
    known: dict[str, bytes] = {"": b""}
    held = 0

    def each(parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def fresh(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of new parts. Plain ones are joined to one text of lines: a line break between them is
        always a piece, and a token, of its own."""
        text = "\n".join(parts)
        if len(line) == 1 and text.count("\n") == len(parts) - 1 and not ODD.search(text) and not (named and named.search(text)):
            found = each([text])[0]
            breaks = found == line[0]
            at = np.flatnonzero(breaks)
            return found[~breaks], np.diff(np.concatenate([[-1], at, [len(found)]])) - 1
        several = each(parts)
        return np.concatenate(several), np.array([len(x) for x in several])

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if held > most:
            known.clear()
            known[""], held = b"", 0
        cut = [[t] if named and named.search(t) else parts_of(t) for t in texts]
        raw = [list(map(known.get, parts)) for parts in cut]
        new = list(dict.fromkeys(p for parts, found in zip(cut, raw) if None in found for p, x in zip(parts, found) if x is None))
        now: dict[str, bytes] = {}
        for i in range(0, len(new), 2000):
            some = new[i:i + 2000]
            ids, lengths = fresh(some)
            data, ends = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
            now.update(zip(some, (data[a:b] for a, b in zip([0, *ends], ends))))
        for k, (parts, found) in enumerate(zip(cut, raw)):
            if None in found:
                raw[k] = [now[p] if x is None else x for p, x in zip(parts, found)]
        kept = {p: x for p, x in now.items() if len(p) <= longest}
        known.update(kept)
        held += sum(200 + 2 * len(p) + len(x) for p, x in kept.items())  # with what Python adds to a string, a bytes object and an entry
        joined = [b"".join(found) for found in raw]
        return np.frombuffer(b"".join(joined), "<u4"), np.array([len(x) // 4 for x in joined], dtype=np.int64)

    return encode


_BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, ids bigint, offsets array<bigint>, words binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text",
                      block_bytes: int = 1_000_000) -> None:
    """Encode whole texts and write them in ascending key order as blocks of Simple-8b words.

    The container is Parquet, so Spark's commit protocol makes the files safe against lost executors on any store.
    Each row is one block: ``part`` and ``block`` order the blocks, ``doc_ids`` and ``lengths`` (ids per document)
    give its documents, ``ids`` the number of ids, ``words`` the packed ids and ``offsets`` the words before every
    mini-block of 1024 ids. Documents are ordered by range partitions and a sort, never in one task.

    Null or empty text: no ids but the end id. Null keys come first; rows of one key are ordered by text. An empty
    table gives files without rows.
    """
    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                       ("ids", pa.int64()), ("offsets", pa.list_(pa.int64())), ("words", pa.binary())])

    def encode(batches):
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        run = worker_once(f"token_files {tokenizer}", lambda: encoder(tokenizer))
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "_text", block_bytes):
                ids, lengths = run([t or "" for t in some.column("_text").to_pylist()])
                if end_id is not None:
                    ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
                words, offsets = pack(ids)
                row = (part, block, some.column("_key").to_pylist(), lengths.tolist(), len(ids), offsets, words)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)
                block += 1

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).cast("string").alias("_text"))
    rows = rows.repartitionByRange("_key").sortWithinPartitions("_key", "_text")
    rows.mapInArrow(encode, _BLOCKS).write.parquet(path)


def read_token_files(spark, path: str, digest: bool = False) -> DataFrame:
    """One row per document of written files: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (array).

    With ``digest`` ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) instead of
    ``ids``. Starts are running sums of one small row per block, within each part, and of one row per part; blocks
    are decoded where they are read.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sizes = blocks.select("part", "block", "ids")
    earlier = Window.unboundedPreceding, -1
    # one row per written partition: their number is set by the cluster
    per_part = sizes.groupBy("part").agg(F.sum("ids").alias("_sum"))
    per_part = per_part.select("part", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*earlier)), F.lit(0))
    starts = sizes.select("part", "block", inside.alias("_inside")).join(per_part, "part").select(
        "part", "block", (F.col("_inside") + F.col("_before")).alias("_start"))

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(row["words"], row["offsets"], row["ids"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["_start"] + ends - lengths, pa.int64())]
                if digest:
                    raw = ids.astype("<u4")
                    out += [pa.array(lengths), pa.array([zlib.crc32(raw[e - n:e].tobytes()) for e, n in zip(ends, lengths)], pa.int64())]
                else:
                    out.append(lists(ids.astype(np.int64), np.concatenate([[0], ends]), pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] if digest else ["doc_id", "start", "ids"]
    rest = "n_tokens bigint, ids_crc32 bigint" if digest else "ids array<bigint>"
    return blocks.join(starts, ["part", "block"]).mapInArrow(decode, f"doc_id bigint, start bigint, {rest}")
