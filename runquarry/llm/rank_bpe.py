"""Byte-level BPE word by word: a contiguous array of part boundaries and one of adjacent ranks per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runquarry.llm.common import lists, parts_of, slices, worker_once

_NONE = 1 << 62  # rank of parts that no rule joins


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, after = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(after)
            after += 1
    return [letters[b] for b in range(256)]


class WordMerger:
    """Vocabulary and merge rules of a ``tokenizers`` file with a byte-level BPE model.

    ``special``: whether the strings of added tokens in a text are these tokens (the library's default) or plain text.
    """

    def __init__(self, path: str, special: bool = True, long: int = 200):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex") or spec["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE file")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that look at the text beside them are not supported")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        ids = model["vocab"]
        self.bytes = [ids[c] for c in byte_letters()]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.joined = [ids[a + b] for a, b in pairs]
        self.long = long
        self.added = {t["content"]: t["id"] for t in added} if special else {}
        names = sorted(self.added, key=len, reverse=True)  # of several that begin at one place the longest counts
        self.named = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.token_bytes = [b""] * (max([*ids.values(), *(t["id"] for t in added)]) + 1)
        for token, i in ids.items():
            self.token_bytes[i] = raw(token)
        for t in added:
            known = all(c in byte_of for c in t["content"])
            self.token_bytes[t["id"]] = raw(t["content"]) if known else t["content"].encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word. The lowest rank is looked for anew each time, of equal ones the leftmost; joining two
        parts deletes the boundary between them and changes only the ranks beside it."""
        if len(word) > self.long:
            return self._merge_long(word)
        rank, joined = self.ranks.get, self.joined
        at = list(range(len(word) + 1))  # boundaries: part i is word[at[i]:at[i + 1]]
        ids = [self.bytes[b] for b in word]
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            del at[i + 1], ids[i + 1]
            new = ids[i] = joined[low]
            if i + 1 < len(ranks):  # the pair to the right is one of the joined part now
                del ranks[i + 1]
                ranks[i] = rank(new << 32 | ids[i + 1], _NONE)
            else:
                del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, _NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same joins in the same order, but the lowest (rank, place) comes from a heap and boundaries are linked, so a
        word of n bytes takes about n log n steps. Entries of parts that have changed since are passed over."""
        n, rank = len(word), self.ranks.get
        ids = [self.bytes[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        found = [(rank(a << 32 | b), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        open_ = [x for x in found if x[0] is not None]
        heapq.heapify(open_)
        while open_:
            low, i = heapq.heappop(open_)
            j = after[i]
            if ids[i] is None or j >= n or rank(ids[i] << 32 | ids[j]) != low:
                continue
            ids[i], ids[j], after[i] = self.joined[low], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    new = rank(ids[a] << 32 | ids[b])
                    if new is not None:
                        heapq.heappush(open_, (new, a))
        return [x for x in ids if x is not None]


class _Known(dict):
    """Ids of parts of texts, each as the bytes of unsigned 32-bit numbers; made where they are first asked for.

    Bounded by bytes, not entries: beyond ``most`` the table is emptied, and a part of more than ``longest`` characters is
    never kept.
    """

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.held = make, most, longest, 0

    def __missing__(self, part: str) -> bytes:
        ids = self.make(part)
        if len(part) <= self.longest:
            self.held += 200 + 2 * len(part) + len(ids)  # with what Python adds to a string, a bytes object and an entry
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[part] = ids
        return ids


def word_encoder(path: str, pattern: str, special: bool = True, most: int = 200_000_000, longest: int = 100):
    """(encode, merger): ``encode`` maps a text to its ids as the bytes of little-endian unsigned 32-bit numbers.

    Added tokens are cut out first, the rest is split by ``pattern`` and every match merged by itself. Texts are parted at
    spaces and line breaks where a match surely begins (``parts_of``), and equal parts of up to ``longest`` characters
    are encoded once, within ``most`` bytes of memory.
    """
    import regex

    merger = WordMerger(path, special)
    split = regex.compile(pattern).findall

    def make(part: str) -> bytes:
        words = split(part)
        if len(words) == 1:
            ids = merger.merge(words[0].encode())
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, words))

    known = _Known(make, most, longest)
    added = {name: np.array([i], dtype="<u4").tobytes() for name, i in merger.added.items()}

    def encode(text: str) -> bytes:
        if merger.named and merger.named.search(text):
            pieces = merger.named.split(text)
            return b"".join(added[p] if k % 2 else b"".join(map(known.__getitem__, parts_of(p))) for k, p in enumerate(pieces))
        return b"".join(map(known.__getitem__, parts_of(text)))

    return encode, merger


def gathered(pool: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Entries ``at`` of a binary array joined in that order, and the n + 1 offsets of each."""
    taken = pool.take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:taken.offset + len(at) + 1]
    return memoryview(taken.buffers()[2] or b""), offsets


def encode_words(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", special: bool = True,
                 keep_ids: bool = False, block_bytes: int = 1_000_000) -> DataFrame:
    """Encode every whole text as the tokenizers library does with the file ``path`` and without adding special tokens, and
    decode the ids as it does without skipping special tokens.

    One row per input row: the key, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the decoded text in UTF-8), and with ``keep_ids`` also ``ids`` and ``decoded``. The strings of added
    tokens in a text are these tokens unless ``special`` is off. Rows are independent: nothing is shuffled.

    Null or empty text: no ids, hashes of nothing. Null and repeated keys are kept as they are. A word of more than 200
    bytes finds its joins by a heap instead of repeated scans, with the same result, so long runs without a space
    take no quadratic time.
    """
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids

    def run(batches):
        encode, merger = worker_once(f"rank_bpe {path} {pattern} {special}", lambda: word_encoder(path, pattern, special))
        pool = pa.array(merger.token_bytes, pa.large_binary())
        for batch in batches:
            for some in slices(batch, text, block_bytes):
                raw = [encode(t) if t else b"" for t in some.column(text).to_pylist()]
                counts = np.array([len(r) // 4 for r in raw])
                ids = np.frombuffer(b"".join(raw), dtype="<u4")
                plain, offsets = gathered(pool, ids)
                ends = np.concatenate([[0], np.cumsum(counts)])
                back = [plain[a:b] for a, b in zip(offsets[ends[:-1]], offsets[ends[1:]])]
                # a token may end within a character: what is no UTF-8 becomes the replacement character
                back = [bytes(b).decode("utf-8", errors="replace") for b in back]
                columns = [some.column(key), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                           pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string())]
                if keep_ids:
                    columns += [lists(ids.astype(np.int32), ends, pa.int32()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)
