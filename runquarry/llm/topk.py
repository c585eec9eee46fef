"""Exact top-k search by term-at-a-time accumulation of integer postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Whole numbers that hold terms, narrowest first, and the largest each holds.
_WIDTHS = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}
#: Best candidates that a task keeps at a time for all its queries together, and bytes of the queries' terms.
GROUP_BEST, GROUP_BYTES = 2**21, 2**25
#: Blocks of candidates that one task goes through, and bytes of their terms.
GROUP_BLOCKS, GROUP_BLOCK_BYTES = 64, 2**27
#: Tasks at most that pairs of groups are dealt to.
MAX_TASKS = 2000


def integer_terms(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null for vectors that are null or hold null or non-finite ones."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda v: F.floor(x(v) * scale).cast("bigint")))


def _measured(df: DataFrame, key: str, terms: str) -> tuple[int, int, int]:
    """Distinct rows (by a hash: it only decides how many blocks there are), all their terms, and the largest magnitude."""
    row = df.select(F.xxhash64(key, terms).alias("h"), F.size(terms).alias("n"), F.array_max(terms).alias("a"), F.array_min(terms).alias("b"))
    row = row.groupBy("h").agg(F.max("n").alias("n"), F.max("a").alias("a"), F.min("b").alias("b"))
    rows, n, a, b = row.agg(F.count("*"), F.sum("n"), F.max("a"), F.min("b")).first()
    return rows, n or 0, max(a or 0, -1 - (b or 0))


def _packed(df: DataFrame, key: str, terms: str, width: str, count: int) -> DataFrame:
    """Rows packed to ``count`` rows, one per ``block`` (a hash, so blocks are even): ids ascending, and the rows' terms as lists."""
    rows = df.select(key, F.col(terms).cast(f"array<{width}>").alias("_t"), F.pmod(F.xxhash64(F.lit(11), key, terms), F.lit(count)).alias("block")).distinct()
    rows = rows.select("block", F.struct(F.col(key).alias("i"), F.col("_t").alias("t")).alias("_r"))
    rows = rows.groupBy("block").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return rows.select("block", F.col("_r.i").alias("ids"), F.col("_r.t").alias("terms"))


def _norm(terms: np.ndarray, row: np.ndarray, n: int) -> float:
    """The largest Euclidean norm of ``n`` rows of terms."""
    return float(np.sqrt(np.bincount(row, terms.astype(np.float64) ** 2, n).max(initial=0)))


class Asked:
    """Queries of a block side by side [queries x terms], zeros where one has fewer terms, and their k best so far."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, lengths: np.ndarray, k: int):
        row = np.repeat(np.arange(len(ids)), lengths)
        self.ids, self.norm, self.k = ids, _norm(terms, row, len(ids)), k
        self.terms = np.zeros((len(ids), int(lengths.max(initial=0))), dtype=terms.dtype)
        self.terms[row, np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = terms
        self.found = (np.empty(0, np.int64),) * 3  # query's row, candidate's id, score; by row, best first
        self.least, self.last = None, None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block of candidates with ascending ids and their scores [queries x candidates], which are written to.

        The k-th score of the block comes from a partition as long as a query has fewer than k; only what may
        be among the k best is put in order. Ties go to the smaller id, whatever order blocks come in.
        """
        k, low, high = self.k, np.iinfo(scores.dtype).min, np.iinfo(scores.dtype).max
        own = np.stack([np.searchsorted(ids, self.ids), np.searchsorted(ids, self.ids, side="right")], axis=1)
        for i in np.flatnonzero(own[:, 0] < own[:, 1]):  # no query is its own candidate
            scores[i, own[i, 0]:own[i, 1]] = low
        least = np.full(len(scores), low, dtype=scores.dtype) if self.least is None else np.clip(self.least, low, high).astype(scores.dtype)
        if (self.least is None or (self.least == np.iinfo(np.int64).min).any()) and len(ids) > k:
            least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        row, at = np.divmod(np.flatnonzero(scores >= least[:, None]), len(ids))
        value, id_ = scores[row, at].astype(np.int64), ids[at]
        keep = (at < own[row, 0]) | (at >= own[row, 1])
        if self.least is not None:
            keep &= (value > self.least[row]) | (value == self.least[row]) & (id_ < self.last[row])
        if not keep.any():
            return
        row, id_, value = (np.concatenate(x) for x in zip(self.found, (row[keep], id_[keep], value[keep])))
        order = np.lexsort((id_, ~value, row))
        row, id_, value = row[order], id_[order], value[order]
        starts = np.searchsorted(row, np.arange(len(self.ids) + 1))
        best = np.arange(len(row)) - starts[row] < k
        self.found = row[best], id_[best], value[best]
        full = np.diff(starts) >= k
        self.least, self.last = np.full(len(self.ids), np.iinfo(np.int64).min), np.full(len(self.ids), np.iinfo(np.int64).max)
        self.least[full], self.last[full] = value[starts[:-1][full] + k - 1], id_[starts[:-1][full] + k - 1]


class Postings:
    """An inverted list per term of one block of candidates: places and weights, or all weights where most have one."""

    def __init__(self, terms: np.ndarray, lengths: np.ndarray, norm: float):
        """``norm``: the largest of the queries. No sum of products, whole or in part, exceeds the product of both
        norms, so sums have 16 or 32 bits where that fits, else 64."""
        place = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        term = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        most = 1.000001 * norm * _norm(terms, place, len(lengths)) + 1
        self.n, self.kind = len(lengths), np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
        used = terms != 0
        order = np.argsort(term[used], kind="stable")
        place, weight = place[used][order], terms[used][order].astype(self.kind)
        ends = np.searchsorted(term[used][order], np.arange(int(lengths.max(initial=0)) + 1))
        self.lists = [(place[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        for t, (places, weights) in enumerate(self.lists):
            if 2 * len(places) > self.n:  # a list that most candidates are on is held as an array
                dense = np.zeros(self.n, dtype=self.kind)
                dense[places] = weights
                self.lists[t] = None, dense

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Dense integer scores [queries x candidates]: term after term the weights of its list are scattered, times
        the weight of each query that has the term."""
        q = queries[:, :len(self.lists)].astype(self.kind)
        out, product = np.zeros((len(q), self.n), dtype=self.kind), np.empty((len(q), self.n), dtype=self.kind)
        for t in range(q.shape[1]):
            places, weights = self.lists[t]
            if places is None and np.count_nonzero(q[:, t]) * 2 > len(q):
                np.multiply(q[:, t, None], weights, out=product)
                out += product
                continue
            rows = np.flatnonzero(q[:, t])
            if not len(rows) or not len(weights):
                continue
            if places is None:
                out[rows] += q[rows, t][:, None] * weights
            else:
                out[np.ix_(rows, places)] += q[rows, t][:, None] * weights
        return out


def top_k(candidates: DataFrame, queries: DataFrame, key: str, terms: str, k: int = 20, candidate_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """The k highest integer inner products of every query with all candidates but itself, ties to the smaller key.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Candidates and queries are packed into blocks by a hash
    of the key, their terms in the narrowest type that holds all. Blocks form groups, and every group of queries meets every group of
    candidates in one task: it holds the queries, goes through the candidates block by block, accumulates dense
    scores term by term and keeps each query's k best, so a pair of vectors is never a row. A block travels once per
    group of the other side, by a shuffle: a broadcast would bring all copies to the driver. The k best of
    groups are merged per query by a window with a limit before its shuffle.

    Null keys and null terms take no part; vectors of different lengths share the terms both have. Rows with the
    same key and terms are one; of different vectors with one key each is asked, none is its own candidate. Fewer candidates than k:
    all of them. Empty tables: no rows. Sums are 64-bit.
    """
    spark = candidates.sparkSession
    candidates = candidates.where(F.col(key).isNotNull() & F.col(terms).isNotNull()).select(key, terms)
    queries = queries.where(F.col(key).isNotNull() & F.col(terms).isNotNull()).select(key, terms)
    (n, n_terms, high), (q, q_terms, q_high) = _measured(candidates, key, terms), _measured(queries, key, terms)
    width = next(w for w, most in _WIDTHS.items() if max(high, q_high) <= most)
    size = (_WIDTHS[width].bit_length() + 1) // 8
    c_blocks, q_blocks = max(1, -(-n // candidate_rows)), max(1, -(-q // query_rows))
    # not written and read again: a reader of files takes as many blocks at once as it takes rows elsewhere
    c, s = _packed(candidates, key, terms, width, c_blocks), _packed(queries, key, terms, width, q_blocks)
    # as few groups as a task's memory allows, but some tasks for each core
    c_groups = min(c_blocks, max(-(-c_blocks // GROUP_BLOCKS), -(-n_terms * size // GROUP_BLOCK_BYTES)))
    q_groups = min(q_blocks, max(-(-q * k // GROUP_BEST), -(-q_terms * size // GROUP_BYTES)))
    tasks = 3 * spark.sparkContext.defaultParallelism
    c_groups = min(c_blocks, max(c_groups, -(-tasks // q_groups)))
    q_groups = min(q_blocks, max(q_groups, -(-tasks // c_groups)))
    # each block is copied to the pairs of groups it belongs to; queries come first in a pair
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    own = lambda count: F.pmod("block", F.lit(count))
    c = c.withColumn("_g", each(q_groups)).select((F.col("_g") * c_groups + own(c_groups)).alias("pair"), F.lit(True).alias("candidates"), "block", "ids", "terms")
    s = s.withColumn("_g", each(c_groups)).select((own(q_groups) * c_groups + F.col("_g")).alias("pair"), F.lit(False).alias("candidates"), "block", "ids", "terms")
    parts = min(c_groups * q_groups, MAX_TASKS)
    pairs = s.unionByName(c).repartitionById(parts, F.pmod("pair", F.lit(parts)).cast("int")).sortWithinPartitions("pair", "candidates", "block")

    def search(batches):
        def found(asked):
            for a in asked:
                row, ids, scores = a.found
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[row]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

        pair, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("pair")[i].as_py() != pair:
                    yield from found(asked)
                    pair, asked = batch.column("pair")[i].as_py(), []
                ids, lists = batch.column("ids")[i].values.to_numpy(), batch.column("terms")[i].values
                flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                if not batch.column("candidates")[i].as_py():
                    for j in range(0, len(ids), 32):  # score arrays that fit a core's cache
                        at = starts[j:j + 33]
                        asked.append(Asked(ids[j:j + 32].copy(), flat[at[0]:at[-1]], np.diff(at), k))
                elif asked:
                    postings = Postings(flat, np.diff(starts), max(a.norm for a in asked))
                    for a in asked:
                        a.add(postings.scores(a.terms), ids)
        yield from found(asked)

    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
