"""MinHash near-dedup of texts with tensored banding and verified links."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runquarry.llm.common import fixed, lists, mix64, release, slices, text_bytes
from runquarry.llm.components import connected

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, n + 1 offsets of each text's words); A-Z count as a-z, bytes are grouped between white space.

    A word's hash is a polynomial of its bytes, read off running sums of the whole block, so no word is touched in
    Python.
    """
    lower = np.arange(256)
    lower[65:91] += 32
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | first[:-1])) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | first[1:])) + 1 if len(data) else np.empty(0, np.int64)
    powers = np.full(len(data) + 1, np.uint64(_FACTOR))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    letters = mix64(lower.astype(np.uint64), 3)[data]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[:-1], dtype=np.uint64)])
    back = np.full(len(data) + 1, np.uint64(_INVERSE))
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix64((sums[ends] - sums[begins]) * back[begins], 4), np.searchsorted(begins, offsets)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingle hashes, sorted within each text; n + 1 offsets) of whole texts.

    A text of fewer words than a shingle has its whole sequence as one, an empty one has none.
    """
    data, offsets = text_bytes(column)
    h, at = word_hashes(data, offsets)
    counts = np.diff(at)
    full = np.maximum(counts - words + 1, 0)
    ends = np.cumsum(full)
    start = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[:-1] - (ends - full), full)
    total = np.zeros(len(start), np.uint64)
    for j in range(words):
        total += mix64(h[start + j], 10 + j) if len(start) else total
    total = mix64(total, 5)
    pieces = np.split(total, ends[:-1]) if len(ends) else []
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        some = h[at[i]:at[i + 1]]
        pieces[i] = mix64(np.array([sum(int(mix64(some[j:j + 1], 10 + j)[0]) for j in range(len(some))) % (1 << 64)], dtype=np.uint64), 50 + len(some))
    pieces = [np.sort(p) for p in pieces]
    flat = np.concatenate(pieces) if pieces else np.empty(0, np.uint64)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begins = np.cumsum(sizes) - sizes
    new[begins[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], np.concatenate([kept[begins], kept[-1:]]).astype(np.int64)


def collections_for(threshold: float, rows: int, miss: float = 5e-4) -> int:
    """How many collections of ``rows`` minhashes it takes so that a pair at the threshold shares two of them but for
    a chance of ``miss`` (two shared collections are one shared table key)."""
    p = threshold ** rows
    m = 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def collection_keys(flat: np.ndarray, offsets: np.ndarray, count: int, rows: int) -> np.ndarray:
    """[texts x count] hashes of ``rows`` minhashes each; rows of empty sets are 0."""
    out = np.zeros((len(offsets) - 1, count), dtype=np.uint64)
    used = np.flatnonzero(np.diff(offsets))
    if len(used):
        for i in range(count):
            key = np.zeros(len(used), np.uint64)
            for j in range(rows):
                factor = mix64(np.array([i * rows + j], dtype=np.uint64), 77)[0] | np.uint64(1)
                key = mix64(key + np.minimum.reduceat(flat * factor, offsets[used]), i + 1)
            out[used, i] = key
    return out


def common_shingles(a: list[np.ndarray], b: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """[a x b] intersection sizes of two blocks of sets, as products of 0/1 matrices over the shingles both blocks have."""
    flat, other = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat, other)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    sides = []
    for sets, values in ((a, flat), (b, other)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.searchsorted(both, values)
        ok = (column < len(both)) & (both[np.minimum(column, len(both) - 1)] == values) if len(both) else np.zeros(len(values), bool)
        order = np.argsort(column[ok], kind="stable")
        sides.append((len(sets), row[ok][order], column[ok][order]))
    for start in range(0, len(both), chunk):
        parts = []
        for n, row, column in sides:
            here = slice(*np.searchsorted(column, [start, start + chunk]))
            x = np.zeros((n, chunk), dtype=np.float32)
            x[row[here], column[here] - start] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def block_edges(ids: tuple[np.ndarray, np.ndarray], sets: tuple[list[np.ndarray], list[np.ndarray]], percent: int) -> np.ndarray:
    """Edges (id, smallest id of its group) of the links between two blocks: at most one per set, however many links."""
    sizes = [np.array([len(x) for x in s]) for s in sets]
    common = common_shingles(*sets)
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    linked &= ids[0][:, None] != ids[1][None, :]
    a, b = ids[0].copy(), ids[1].copy()
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], far).min(axis=1))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], far).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            edges = np.concatenate([np.stack([ids[0], a], 1), np.stack([ids[1], b], 1)])
            return edges[edges[:, 0] != edges[:, 1]]
        a, b = new_a, new_b


def near_duplicate_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, rows: int = 3,
                         star_rounds: int = 1, block_shingles: int = 100_000, block_bytes: int = 1_000_000, unique: bool = False) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: groups of texts linked by Jaccard similarity of shingle sets.

    Words are separated by white space, A-Z are lower-cased; whole texts count. Texts with the same set are first taken
    as one. Tensored banding: m collections of ``rows`` minhashes are computed, and each pair of collections
    is a table whose key combines both, so m(m-1)/2 tables of 2 * ``rows`` minhashes cost only m * ``rows`` minhashes. m is such
    that a pair at the threshold is missed with a chance below 0.0005. Links have 100 * intersection >= ``percent`` * union
    on the full sets (64-bit hashes of the shingles).

    Within a bucket pairs are never rows. First all members are compared with one of them, then, for ``star_rounds``
    rounds, those of other components with another one. Buckets that still hold different components are united to
    clusters, whose sets are cut in blocks of about ``block_shingles`` shingles by a hash; every two blocks of a cluster are
    compared in a task of their own by matrix products, and one edge per set leaves it. So no candidate that could
    join two components is left out, and groups of thousands are a few blocks. Members and hubs meet in joins
    that skew handling can split.

    Null text or text without words: 0 shingles, linked with nothing. Null keys: counted, linked with nothing, component
    null, kept. Rows with the same key share a component only if their sets do. component_id is the smallest key
    of the group; an empty table gives no rows. ``unique``: keys are known to be distinct, so full sets need no shuffle
    that takes copies out.
    """
    m = collections_for(percent / 100, rows)
    kind = pa.list_(pa.int64())

    def signatures(batches):
        for batch in batches:
            for some in slices(batch, "t", block_bytes):
                flat, offsets = shingle_sets(some.column("t"), words)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat, 90 + k), dtype=np.uint64)]) for k in (1, 2)]
                g, check = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
                c = collection_keys(flat, offsets, m, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    some.column("id"), pa.array(np.diff(offsets)), pa.array(g.view(np.int64)), pa.array(check.view(np.int64)),
                    lists(c.ravel(), np.arange(len(c) + 1) * m, pa.int64())], names=["id", "n", "g", "d", "c"])

    def sets(batches):
        for batch in batches:
            for some in slices(batch, "t", block_bytes):
                flat, offsets = shingle_sets(some.column("t"), words)
                s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat, 91), dtype=np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64)),
                                                  lists(flat.view(np.int64), offsets, pa.int64()).cast(kind)], names=["g", "s"])

    rows_in = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    signed = fixed(rows_in.mapInArrow(signatures, "id bigint, n bigint, g bigint, d bigint, c array<bigint>"), "signatures")
    reps = signed.where("n > 0 and id is not null").groupBy("g", "d", "n").agg(F.min("id").alias("rep"), F.first("c").alias("c"))
    reps = fixed(reps, "sets")
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("c")[i], F.col("c")[j]) for t, (i, j) in enumerate(combinations(range(m), 2))])
    tables = reps.select("g", F.explode(keys).alias("k"))
    # only the key and a count travel to find what several sets have; the rest joins the few rows that are left
    shared = tables.groupBy("k").agg(F.count("*").alias("size")).where("size > 1").select("k")
    buckets = fixed(tables.join(shared, "k").join(reps.select("g", "n"), "g").select("k", "g", "n"), "buckets")

    wanted = buckets.select("g").distinct().join(reps.select("g", "rep"), "g").select(F.col("rep").alias("id")).distinct()
    full = rows_in.where("id is not null").join(wanted, "id", "left_semi").mapInArrow(sets, "g bigint, s array<bigint>")
    full = fixed(full if unique else full.groupBy("g").agg(F.first("s").alias("s")), "full-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        a, b = full.select(F.col("g").alias("a"), F.col("s").alias("sa")), full.select(F.col("g").alias("b"), F.col("s").alias("sb"))
        both = pairs.join(a, "a").join(b, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    def pairs_of(df: DataFrame, other: str, other_n: str) -> DataFrame:
        """Distinct pairs whose sizes allow a link."""
        able = 100 * F.least("n", other_n) >= percent * F.greatest("n", other_n)
        return df.where(able & (F.col("g") != F.col(other))).select(F.least("g", other).alias("a"), F.greatest("g", other).alias("b")).distinct()

    size_of = lambda name: reps.select(F.col("g").alias(name), F.col("n").alias(f"{name}_n"))
    hubs = buckets.groupBy("k").agg(F.min("g").alias("hub"))
    star = buckets.join(hubs, "k").select("g", "n", "hub").distinct().join(size_of("hub"), "hub")
    tested = fixed(pairs_of(star, "hub", "hub_n"), "pairs")
    links = fixed(verified(tested), "text-links")
    done = [buckets, full, tested, links]  # tables that are of no use once all links are known
    for step in range(star_rounds + 1):
        groups = connected(links, "a", "b").select(F.col("id").alias("g"), "component")
        placed = buckets.select("k", "g", "n").join(groups, "g", "left").withColumn("component", F.coalesce("component", "g"))
        mixed = placed.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.min_by(F.struct("g", "n", "component"), F.xxhash64(F.lit(step), "g")).alias("h")).where("lo <> hi")
        if step == star_rounds:
            break
        at = placed.join(mixed.select("k", F.col("h.g").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.component").alias("hub_c")), "k")
        pairs = fixed(pairs_of(at.where("component <> hub_c"), "hub", "hub_n").join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = fixed(links.unionByName(verified(pairs)), "text-links")
        done += [pairs, links]
    left = fixed(placed.join(mixed.select("k", F.col("h.g").alias("hub")), "k").select("g", "hub").distinct(), "mixed")
    clusters = connected(left.where("g <> hub"), "g", "hub").select(F.col("id").alias("g"), F.col("component").alias("cluster"))
    rest = clustered = fixed(clusters.join(full, "g"), "clusters")
    blocks = rest.groupBy("cluster").agg(F.ceil(F.sum(F.size("s")) / block_shingles).alias("blocks"))
    rest = rest.join(blocks, "cluster").groupBy("cluster", "blocks", F.pmod(F.xxhash64("g"), F.col("blocks")).alias("i")).agg(F.collect_list(F.struct("g", "s")).alias("x"))
    one = rest.select("cluster", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"), F.col("x").alias("a"))
    two = rest.select("cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("i"))).alias("i"), F.col("i").alias("j"), F.col("x").alias("b"))

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sides = [batch.column(c)[r].values for c in "ab"]
                lists_of = [x.field("s") for x in sides]
                sets_of = tuple(np.split(v.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(v).to_numpy(zero_copy_only=False))[:-1]) for v in lists_of)
                edges = block_edges(tuple(x.field("g").to_numpy() for x in sides), sets_of, percent)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    found = one.join(two, ["cluster", "i", "j"]).select("a", "b").mapInArrow(compare, "a bigint, b bigint")
    links = fixed(links.unionByName(found), "text-links")
    release(*done, left, clustered)
    groups = connected(links, "a", "b").select(F.col("id").alias("g"), "component")
    placed = reps.select("g", "rep").join(groups, "g", "left").withColumn("component", F.coalesce("component", "g"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = placed.join(smallest, "component").select("g", "component_id")
    out = signed.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("g")).alias("g")).join(known, "g", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
