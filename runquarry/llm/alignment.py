"""Cross-tokenizer alignment: two tokenizations of a text matched by byte offsets, each distinct text once."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runquarry.llm.common import fixed, lists, slices, worker_once
from runquarry.llm.rank_bpe import _Known, gathered, word_encoder

_BEFORE_SPACE = re.compile(r"(?<=[^ ])(?= )")


class PieceEncoder:
    """Ids of `` text`` by a sentencepiece model that puts a space before a text and changes nothing else.

    A text is parted before every space behind another character. No piece of the model has a space behind another
    character (checked), so none crosses such a place, and equal parts are encoded once.
    """

    def __init__(self, path: str, most: int = 100_000_000, longest: int = 100):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        space = model.piece_to_id("▁")
        crossing = any("▁" in p.lstrip("▁") for p in pieces)
        if crossing or model.encode("a") != model.encode("b  a")[-1:] or model.encode("") or model.id_to_piece(model.encode("a ")[-1]) != "▁":
            raise ValueError("the model's pieces cross spaces, or it changes spaces")

        def make(part: str) -> bytes:
            ids = model.encode(part) if part else [space]
            return struct.pack(f"<{len(ids)}I", *ids)

        self.known = _Known(make, most, longest)

    def encode(self, text: str) -> bytes:
        """The ids of a non-empty text as bytes of little-endian unsigned 32-bit numbers."""
        if "  " in text or text[0] == " ":
            parts = [p[1:] for p in _BEFORE_SPACE.split(" " + text)]
        else:
            parts = text.split(" ")
        return b"".join(map(self.known.__getitem__, parts))


class Aligner:
    """Both tokenizers with the bytes of their ids, and the decimal texts of ids with what may follow them."""

    _COMMA, _BAR, _SEMICOLON, _END = range(4)

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.encode_a, merger = word_encoder(path_a, pattern, special=False, most=100_000_000)
        b = PieceEncoder(path_b)
        self.encode_b = b.encode
        self.pools = [pa.array(x, pa.large_binary()) for x in (merger.token_bytes, b.token_bytes)]
        self.lengths = [np.array([len(t) for t in x], dtype=np.int64) for x in (merger.token_bytes, b.token_bytes)]
        most = max(len(x) for x in self.lengths)
        self.decimals = pa.array([f"{i}{s}".encode() for i in range(most) for s in (",", "|", ";", "")], pa.large_binary())

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, tokens per text) of each side; none for an empty text and for one whose tokens are other bytes than it is."""
        raw = [[encode(pre + t) if t else b"" for t in texts] for encode, pre in ((self.encode_a, " "), (self.encode_b, ""))]
        fine = np.ones(len(texts), bool)
        sides = []
        for side, pool in zip(raw, self.pools):
            ids, counts = np.frombuffer(b"".join(side), "<u4").astype(np.int64), np.array([len(r) // 4 for r in side], dtype=np.int64)
            data, offsets = gathered(pool, ids)
            ends = np.concatenate([[0], np.cumsum(counts)])
            for i, t in enumerate(texts):
                fine[i] &= bytes(data[offsets[ends[i]]:offsets[ends[i + 1]]]) == (" " + t if t else "").encode()
            sides.append((ids, counts))
        return [ids[np.repeat(fine, counts)] for ids, counts in sides], [np.where(fine, counts, 0) for _, counts in sides]

    def align(self, texts: list[str]) -> dict:
        """Groups and links of some texts. ``pairs`` are the distinct linked (A id << 32 | B id); links of the k-th (text, pair)
        that occurs: text ``where[k]``, pair ``which[k]``, ``times[k]`` of them, in order of the texts."""
        (a, b), (count_a, count_b) = self.tokens(texts)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        begin_a, begin_b = end_a - self.lengths[0][a], end_b - self.lengths[1][b]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = np.cumsum(count_a), np.cumsum(count_b)
        after = np.concatenate([[0], group_a + 1])[last_a] if len(a) else np.zeros(len(texts), np.int64)  # groups up to each text

        ends_text = np.zeros(len(cuts), bool)
        ends_text[after[count_a > 0] - 1] = True
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = 4 * a + np.where(end_a == cuts[group_a], self._BAR, self._COMMA)
        closing = np.where(ends_text, self._END, self._SEMICOLON)[group_b]
        order[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = 4 * b + np.where(end_b == cuts[group_b], closing, self._COMMA)
        data, offsets = gathered(self.decimals, order)
        upto = offsets[np.concatenate([[0], last_a + last_b])]
        groups = [data[x:y] for x, y in zip(upto, upto[1:])]

        first = np.searchsorted(end_b, begin_a, side="right")
        each = np.searchsorted(begin_b, end_a, side="left") - first
        total = np.concatenate([[0], np.cumsum(each)])
        other = np.arange(total[-1]) + np.repeat(first - total[:-1], each)
        pairs, which = np.unique(np.repeat(a, each) << 32 | b[other], return_inverse=True)
        text = np.repeat(np.repeat(np.arange(len(texts)), count_a), each)
        codes, times = np.unique(text * max(len(pairs), 1) + which, return_counts=True)
        where, which = np.divmod(codes, max(len(pairs), 1))
        return {"n_a": count_a, "n_b": count_b, "n_groups": np.diff(np.concatenate([[0], after])), "n_links": np.diff(total[np.concatenate([[0], last_a])]),
                "groups": groups, "pairs": pairs, "where": where, "which": which, "times": times}


def align_in_steps(aligner: Aligner, texts: list[str], step_bytes: int) -> dict:
    """``align`` of many texts, some of about ``step_bytes`` at a time: its work arrays take a hundred times the texts, what is kept a few."""
    found, some, size = [], [], 0
    for t in [*texts, None]:
        more = len(t) if t is not None else 0  # characters will do
        if some and (t is None or size + more > step_bytes):
            found.append((len(some), aligner.align(some)))
            some, size = [], 0
        if t is not None:
            some.append(t)
            size += more
    if len(found) == 1:
        return found[0][1]
    pairs = np.unique(np.concatenate([f["pairs"] for _, f in found]))
    before = np.cumsum([0, *[n for n, _ in found]])
    joined = {"where": [f["where"] + n for n, (_, f) in zip(before, found)], "which": [np.searchsorted(pairs, f["pairs"])[f["which"]] for _, f in found],
              **{name: [f[name] for _, f in found] for name in ("times", *_MEASURES)}}
    return {"pairs": pairs, "groups": [g for _, f in found for g in f["groups"]], **{name: np.concatenate(x) for name, x in joined.items()}}


_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def align_tokenizers(docs: DataFrame, path_a: str, pattern: str, path_b: str, key: str = "doc_id", text: str = "text",
                     keep_groups: bool = False,
                     block_bytes: int = 4_000_000, step_bytes: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """How the tokens of two tokenizers lie over each other in every text, and how often their ids do in the corpus.

    A is a byte-level BPE file of the tokenizers library that encodes `` text`` without added tokens, B a sentencepiece model that
    adds the space itself. Offsets are bytes. Places where tokens of both end cut a text into groups; every A and B token
    that share a byte are a link.

    Result 1, per document: key, n_a, n_b, n_groups, n_links, n_best (links whose pair of ids is held by as many documents as
    any pair of its A id), count_sum (over the links, how many documents hold their pair), groups_sha256 (of the groups as
    ``a1,a2|b1;a3|b2,b3``), with ``keep_groups`` also ``groups``. Result 2: a_id, b_id, documents, best.

    Texts are shuffled by their full text, so that each distinct text is tokenised and aligned once; its pairs count as
    often as documents have it. A block of some megabytes of texts holds a pair once, so a pair that is everywhere is
    one row per block when pairs are counted and when their counts come back. Measures reach the documents by the sha256
    of the text. Only the highest count per A id is broadcast: at most one row for each id of the vocabulary.

    Null or empty text, and text that either tokenizer does not give back: zeros and an empty groups_sha256. Null and
    repeated keys are kept; each row is a document. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    distinct = rows.where("_text <> ''").groupBy("_text").agg(F.count("*").alias("_documents"))
    schema = ("id bigint, digests array<binary>, " + ", ".join(f"{m} array<bigint>" for m in _MEASURES) + ", sums array<string>, groups array<string>, "
              "pairs array<bigint>, documents array<bigint>, ends array<int>, which array<int>, times array<int>")

    def blocks(batches):
        from pyspark import TaskContext

        aligner = worker_once(f"alignment {path_a} {pattern} {path_b}", lambda: Aligner(path_a, pattern, path_b))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, "_text", block_bytes):
                texts = some.column("_text").to_pylist()
                found = align_in_steps(aligner, texts, step_bytes)
                held = np.bincount(found["which"], weights=some.column("_documents").to_numpy()[found["where"]], minlength=len(found["pairs"]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(found["where"], minlength=len(texts)))])
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                whole = lambda x, kind: lists(x, np.array([0, len(x)]), kind)
                columns = [pa.array([number], pa.int64()), one([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                           *[whole(found[m], pa.int64()) for m in _MEASURES],
                           one([hashlib.sha256(g).hexdigest() if len(g) else "" for g in found["groups"]], pa.string()),
                           one([bytes(g).decode() for g in found["groups"]] if keep_groups else None, pa.string()),
                           whole(found["pairs"], pa.int64()), whole(held.astype(np.int64), pa.int64()),
                           whole(ends[1:].astype(np.int32), pa.int32()), whole(found["which"].astype(np.int32), pa.int32()), whole(found["times"].astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                number += 1

    names = ["id", "digests", *_MEASURES, "sums", "groups", "pairs", "documents", "ends", "which", "times"]
    aligned = fixed(distinct.mapInArrow(blocks, schema), "aligned")

    each = aligned.select(F.explode(F.arrays_zip("pairs", "documents")).alias("_p")).select("_p.*")
    counts = fixed(each.groupBy("pairs").agg(F.sum("documents").alias("documents")), "pair-counts")
    a_id = F.shiftright("pairs", 32)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("documents").alias("highest"))
    counts = counts.withColumn("a", a_id).join(F.broadcast(highest), "a").withColumn("best", F.col("documents") == F.col("highest"))

    asked = aligned.select("id", F.posexplode("pairs").alias("i", "pairs"))
    told = asked.join(counts.select("pairs", "documents", "best"), "pairs").groupBy("id").agg(F.collect_list(F.struct("i", "documents", "best")).alias("told"))

    def measures(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                array = lambda c: batch.column(c)[r].values  # noqa: E731,B023
                told = array("told")
                n_pairs = len(told) if told is not None else 0
                documents, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
                if n_pairs:
                    at = told.field("i").to_numpy()
                    documents[at], best[at] = told.field("documents").to_numpy(), told.field("best").to_numpy(zero_copy_only=False)
                which, times, ends = array("which").to_numpy(), array("times").to_numpy().astype(np.int64), array("ends").to_numpy()
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(times * x[which])])[np.concatenate([[0], ends])])  # noqa: E731,B023
                columns = [array("digests"), *[array(m) for m in _MEASURES], pa.array(total(best), pa.int64()), pa.array(total(documents), pa.int64()), array("sums")]
                columns += [array("groups")] if keep_groups else []
                yield pa.RecordBatch.from_arrays(columns, names=["digest", *_MEASURES, "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups])

    numbers = [*_MEASURES, "n_best", "count_sum"]
    measured = aligned.drop("pairs", "documents").join(told, "id", "left").mapInArrow(
        measures, "digest binary, " + ", ".join(f"{n} bigint" for n in numbers) + ", groups_sha256 string" + ", groups string" * keep_groups)
    digest = F.when(F.col("_text") != "", F.unhex(F.sha2("_text", 256)))
    out = rows.select("_key", digest.alias("digest")).join(measured, "digest", "left")
    out = out.select(F.col("_key").alias(key), *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
                     *[F.coalesce("groups", F.lit("")).alias("groups")] * keep_groups)
    pairs = counts.select(F.col("a").cast("bigint").alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b_id"), "documents", "best")
    return out, pairs
