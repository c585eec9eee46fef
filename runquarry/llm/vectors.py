"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runquarry.llm.common import fixed
from runquarry.llm.components import connected


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of one length as unit rows in double precision, scaled by their largest component first."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids of unit rows: assignment by cosine, centroids are normalised sums; empty ones keep their place."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        ok = size > 1e-12
        centroids[ok] = sums[ok] / size[ok, None]
    return centroids


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, [rows x cells] cells in which a vector within ``threshold`` cosine of the row may be at home).

    With b = c - h the difference of another centroid and the home one, a vector at angle t from v has
    w.b <= cos t (v.b + tan t |b without its part along v|); below 0 it cannot prefer c to h. So no link is lost
    whatever the centroids are.
    """
    dots = x @ centroids.T
    home = dots.argmax(axis=1)
    away = dots[np.arange(len(x)), home][:, None] - dots  # -v.b, at least 0
    squares = np.maximum(2 - 2 * (centroids @ centroids.T), 0)[home]
    tangent = math.sqrt(max(0.0, 1 - threshold * threshold)) / threshold
    return home, away <= tangent * np.sqrt(np.maximum(squares - away * away, 0)) + 1e-9


def block_links(home: np.ndarray, others: np.ndarray, copies: np.ndarray, home_ids: np.ndarray, other_ids: np.ndarray, threshold: float):
    """(copies linked to each home row, edges (id, smallest id of its group in this block)).

    All cosines of two blocks are one matrix product. The groups of the block come from passing the smallest id to
    and fro along links, so at most one edge per row leaves the block, however many links it has.
    """
    linked = home @ others.T >= threshold
    linked |= home_ids[:, None] == other_ids[None, :]  # itself, whatever the rounding
    counts = linked @ copies
    row = np.flatnonzero((linked & (home_ids[:, None] != other_ids[None, :])).any(axis=1))
    if not len(row):
        return counts, np.empty((0, 2), np.int64)
    part = linked[row]
    column = np.flatnonzero(part.any(axis=0))
    part = part[:, column]
    a, b = home_ids[row].copy(), other_ids[column].copy()
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(part, b[None, :], far).min(axis=1))
        new_b = np.minimum(b, np.where(part, new_a[:, None], far).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    edges = np.concatenate([np.stack([home_ids[row], a], 1), np.stack([other_ids[column], b], 1)])
    return counts, edges[edges[:, 0] != edges[:, 1]]


def near_duplicate_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
                           cell_rows: int = 512, block_rows: int = 1024, max_centroids: int = 4096, sample_per_centroid: int = 16) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links are pairs of equal label with cosine >= ``threshold``.

    Equal vectors are first counted as one. The others of a label are dealt to cells: each to the cell of its nearest
    centroid, and as a guest to all cells in which a vector linked with it may be at home (``cells_of``), so every link
    is found. Cells are cut in blocks by a hash of the id, and a task compares one block of a cell's own vectors with
    one block of all its vectors by a matrix product; large cells and labels thus become many tasks. Counts are summed
    and one edge per row and block goes into connected components.

    Cells hold about max(``cell_rows``, 4 sqrt(n)) of a label's n vectors. Centroids, at most ``max_centroids`` over all labels,
    are fitted on a sample of ``sample_per_centroid`` vectors for each, chosen by a hash; both bounds limit what
    the driver holds and are sent to the tasks. They set the cost, not the result.

    Vectors that are null, empty, zero or hold null or non-finite components, null labels and null keys link with nothing:
    0 links, component_id their own key, kept. Vectors of different lengths never link. Rows that repeat key and vector
    are counted each; different vectors of one key are in one component. An empty table gives no rows.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))
    ok = F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.when(ok, F.col(vector)).alias("v"),
                     F.when(ok, F.concat_ws(":", F.size(vector), F.col(label).cast("string"))).alias("part"))
    whole = rows.where("part is not null").groupBy("part", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    whole = fixed(whole, "vectors")
    sizes = {r["part"]: (r["n"], r["d"]) for r in whole.groupBy("part").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("d")).where(F.col("n") > cell_rows).collect()}
    wanted = {p: math.ceil(n / max(cell_rows, 4 * math.sqrt(n))) for p, (n, _) in sizes.items()}
    scale = min(1.0, max_centroids / max(1, sum(wanted.values())))
    wanted = {p: max(1, int(k * scale)) for p, k in wanted.items()}
    centroids: dict[str, np.ndarray] = {}
    if any(k > 1 for k in wanted.values()):
        share = {p: min(1.0, 1.2 * sample_per_centroid * k / sizes[p][0]) for p, k in wanted.items() if k > 1}
        chance = F.coalesce(*[F.when(F.col("part") == p, F.lit(s)) for p, s in share.items()], F.lit(0.0))
        sample = whole.where(F.pmod(F.xxhash64("part", "rep"), F.lit(1 << 20)) < chance * (1 << 20)).select("part", "v").toArrow().to_pydict()
        by_part: dict[str, list] = {}
        for p, v in zip(sample["part"], sample["v"]):
            by_part.setdefault(p, []).append(v)
        centroids = {p: spherical_kmeans(unit_rows(v), min(wanted[p], len(v))) for p, v in by_part.items()}
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            parts, reps, copies = (batch.column(c).to_pylist() for c in ("part", "rep", "copies"))
            vectors = batch.column("v").to_pylist()
            by: dict[str, list[int]] = {}
            for i, p in enumerate(parts):
                by.setdefault(p, []).append(i)
            out = {c: [] for c in ("part", "cell", "home", "id", "copies", "x")}
            for p, at in by.items():
                x = unit_rows([vectors[i] for i in at])
                c = shared.value.get(p)
                home, near = (np.zeros(len(at), int), np.ones((len(at), 1), bool)) if c is None else cells_of(x, c, threshold)
                for r, cell in zip(*np.nonzero(near)):
                    for name, value in zip(out, (p, int(cell), bool(home[r] == cell), reps[at[r]], copies[at[r]], x[r].tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.string()), pa.array(out["cell"], pa.int32()), pa.array(out["home"], pa.bool_()),
                                              pa.array(out["id"], pa.int64()), pa.array(out["copies"], pa.int64()), pa.array(out["x"], pa.binary())], names=list(out))

    dealt = whole.select("part", "rep", "copies", "v").mapInArrow(assign, "part string, cell int, home boolean, id bigint, copies bigint, x binary")
    dealt = fixed(dealt, "cells")
    cells = dealt.groupBy("part", "cell").agg(F.ceil(F.count("*") / block_rows).alias("nj"), F.ceil(F.count_if("home") / block_rows).alias("ni"))
    dealt = dealt.join(cells, ["part", "cell"])
    h = F.xxhash64("id")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    block = F.collect_list(F.struct("id", "copies", "x"))
    # packed first, copied to its partners then: a block is moved once per block it meets
    own = dealt.where("home").groupBy("part", "cell", "nj", F.pmod(h, F.col("ni")).alias("i")).agg(block.alias("a")).withColumn("j", upto("nj"))
    others = dealt.where("ni > 0").groupBy("part", "cell", "ni", F.pmod(h, F.col("nj")).alias("j")).agg(block.alias("b")).withColumn("i", upto("ni"))
    pairs = own.drop("nj").join(others.drop("ni"), ["part", "cell", "i", "j"]).select("a", "b")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, copies = {}, {}, {}
                for side in ("a", "b"):
                    s = batch.column(side)[i].values
                    ids[side], copies[side] = s.field("id").to_numpy(), s.field("copies").to_numpy()
                    x[side] = np.frombuffer(b"".join(s.field("x").to_pylist()), dtype=np.float64).reshape(len(s), -1)
                counts, edges = block_links(x["a"], x["b"], copies["b"], ids["a"], ids["b"], threshold)
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([ids["a"][used], edges[:, 0]])), pa.array(np.concatenate([counts[used], np.zeros(len(edges), np.int64)])),
                    pa.array(np.concatenate([ids["a"][used], edges[:, 1]]))], names=["id", "n", "to"])

    found = fixed(pairs.mapInArrow(compare, "id bigint, n bigint, to bigint"), "vector-links")
    counts = found.groupBy(F.col("id").alias("rep")).agg((F.sum("n") - 1).alias("n_links"))
    groups = connected(found.where("id <> to"), "id", "to").withColumnRenamed("id", "rep")
    known = whole.select("part", "v", "rep").join(counts, "rep", "left").join(groups, "rep", "left")
    linked = rows.where("part is not null").join(known, ["part", "v"]).select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("part is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
