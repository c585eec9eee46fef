"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runquarry.functions.scale import local_frame
from runquarry.llm.common import fixed

_BINS = 1 << 16


def capped_targets(sizes: Mapping[str | None, int], weights: Sequence[float], share: float = 1.0, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes, split by weight, at most ``most`` times the source's own size.

    Sources take the weights in code point order, null last, repeating. What a capped source cannot take is shared
    again among the others by weight, until none is above its cap. Empty sources get 0.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if total > 0 and left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: (left * weight[s] / total if total > 0 else 0.0) for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def route(capacity: Mapping[tuple, float], quota: Mapping[str | None, float], passes: int) -> dict[tuple[tuple, str | None], float]:
    """Tokens that each membership pattern gives to each source: a maximal flow of least repetition cost.

    A pattern can give its capacity ``passes`` times; the n-th pass costs n - 1 a token, so a token is repeated only
    where no unread one can fill a quota. Paths of least cost are filled one after the other (Dijkstra with
    potentials, over patterns and sources only, so its size does not depend on the number of documents). Every set of
    patterns that sources connect is solved apart, a pattern that shares no source with others too.
    """
    root: dict[str | None, str | None] = {s: s for p in capacity for s in p}

    def top(s: str | None) -> str | None:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for p in capacity:
        for s in p[1:]:
            root[top(s)] = top(p[0])
    apart: dict[str | None, list[tuple]] = {}
    for p in capacity:
        if p:
            apart.setdefault(top(p[0]), []).append(p)
    return {k: v for patterns in apart.values() for k, v in _route_connected(patterns, capacity, quota, passes).items()}


def _route_connected(patterns: Sequence[tuple], capacity: Mapping[tuple, float], quota: Mapping[str | None, float], passes: int) -> dict[tuple[tuple, str | None], float]:
    """:func:`route` of patterns that are connected by their sources."""
    flow: dict[tuple[tuple, str | None], float] = {}
    members: dict[str | None, list[tuple]] = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    given = {p: 0.0 for p in patterns}
    need = {s: quota.get(s, 0.0) for s in members}
    for p in patterns:
        for s in p:
            flow[p, s] = 0.0
    slack = 1e-9 * (sum(need.values()) + 1.0)

    def next_pass(p: tuple) -> tuple[int, float]:
        n = int((given[p] + slack) // capacity[p]) if capacity[p] > 0 else passes
        return n, (n + 1) * capacity[p] - given[p]

    while True:
        # from all patterns with room, over pattern -> source, and source -> pattern where its flow can be taken back
        cost, back, heap = {}, {}, []
        for i, p in enumerate(patterns):
            n, room = next_pass(p)
            if n < passes and room > slack:
                cost[p] = n
                heapq.heappush(heap, (n, 0, i, p))
        end, seen, order = None, set(), len(patterns)
        while heap:
            c, kind, _, node = heapq.heappop(heap)
            if (kind, node) in seen:
                continue
            seen.add((kind, node))
            if kind and need[node] > slack:
                end = node
                break
            for other in ([p for p in members[node] if flow[p, node] > slack] if kind else node):
                key = (1 - kind, other)
                if key not in seen and key not in back and not (not key[0] and other in cost):
                    back[key] = node
                    order += 1
                    heapq.heappush(heap, (c, 1 - kind, order, other))
        if end is None:
            return {k: v for k, v in flow.items() if v > 0}
        path, node, kind = [], end, 1
        while (kind, node) in back:
            path.append((kind, back[kind, node], node))
            node, kind = back[kind, node], 1 - kind
        amount = min([need[end], next_pass(node)[1], *(flow[to, frm] for k, frm, to in path if not k)])
        for k, frm, to in path:
            if k:
                flow[frm, to] += amount
            else:
                flow[to, frm] -= amount
        given[node] += amount
        need[end] -= amount


def mix_sources(docs: DataFrame, members: Column, size: Column, quota, passes: int = 2, seed: int = 7, key: str = "doc_id",
                flips: int = 6, max_patterns: int = 100_000, rounds: str = "rounds") -> DataFrame:
    """``docs`` with ``rounds``: how often the mix takes each document (0 to ``passes``), whole each time.

    ``members`` is the array of sources a document belongs to, ``size`` its tokens; ``quota`` maps a source to its
    wanted tokens, or is a function from the sizes of the membership patterns, 0 included, to such a map. Documents are summed by
    membership pattern; the flow over patterns and sources gives the tokens a pattern delivers. These are full passes
    over all its documents and a rest, for which documents are taken in a seeded order until the rest is reached;
    then, up to ``flips`` times, the one document is added or left out that brings the sum nearest to the rest.

    Only patterns come to the driver, with an error beyond ``max_patterns``; documents do not. The place of the cut
    in a pattern's order comes from sums of at most 65,536 hash bins and then from the rows of one bin, so a pattern
    with a third of all rows is never ordered in one task. The order depends on seed and key only: reruns agree.

    A null source is a source of its own. Documents without any source, null or non-positive sizes: never taken, 0
    rounds. Rows with one key stand at one place of the order, with one number of rounds each. A source without
    documents takes nothing, one without quota gives nothing. An empty table gives an empty one.
    """
    h = F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 62) - 1))
    work = docs.select(F.array_sort(F.array_distinct(members)).alias("_pattern"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_size"), h.alias("_hash"))
    found = work.where("size(_pattern) > 0").groupBy("_pattern").agg(F.sum(F.greatest("_size", F.lit(0))).alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sizes = {tuple(r["_pattern"]): r["n"] for r in sorted(found, key=lambda r: str(r["_pattern"]))}
    wanted = quota(sizes) if callable(quota) else quota
    work, capacity = work.where("_size > 0 and size(_pattern) > 0"), {p: n for p, n in sizes.items() if n > 0}
    flow = route(capacity, wanted, passes)
    total = dict.fromkeys(capacity, 0.0)
    for (p, _), v in flow.items():
        total[p] += v
    full = {p: min(passes, int((total[p] + 1e-6) // capacity[p])) for p in capacity}
    rest = {p: total[p] - full[p] * capacity[p] for p in capacity}
    spark = docs.sparkSession
    pattern_type = work.schema["_pattern"].dataType.simpleString()

    def plan(rows, columns: str) -> DataFrame:
        return local_frame(spark, rows, f"_pattern {pattern_type}, {columns}")

    def same(df: DataFrame, side: DataFrame) -> DataFrame:
        return df.join(side.withColumnRenamed("_pattern", "_p"), F.col("_pattern").eqNullSafe(F.col("_p"))).drop("_p")

    cut: dict[tuple, int] = {}
    flipped: dict[tuple, list[int]] = {p: [] for p in capacity}
    parted = [(list(p), float(rest[p])) for p in capacity if rest[p] >= 1]
    if parted:
        work = fixed(work, "mix")
        bin_ = F.shiftright("_hash", 46).cast("int")
        sums = same(work.groupBy("_pattern", bin_.alias("_bin")).agg(F.sum("_size").alias("_s")), plan(parted, "_rest double"))
        before = Window.partitionBy("_pattern").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_upto", F.sum("_s").over(before))
        found = sums.where("_upto > _rest").groupBy("_pattern").agg(F.min_by(F.struct("_bin", (F.col("_rest") + F.col("_s") - F.col("_upto")).alias("left")), "_bin").alias("_e")).select(
            "_pattern", "_e.*").collect()
        edges = [(list(r["_pattern"]), r["_bin"], float(r["left"])) for r in found]
        rows = same(work.withColumn("_bin", bin_), plan(edges, "_edge int, _left double")).where("_bin = _edge")
        order = Window.partitionBy("_pattern").orderBy("_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = rows.withColumn("_upto", F.sum("_size").over(order)).where("_upto <= _left").groupBy("_pattern").agg(F.max("_hash").alias("h"))
        found_last = {tuple(r["_pattern"]): r["h"] for r in last.collect()}
        for p, b, _ in edges:
            cut[tuple(p)] = found_last.get(tuple(p), (b << 46) - 1)
        for p in (tuple(p) for p, _ in parted):
            cut.setdefault(p, (1 << 62) - 1)
        state = plan([(p, int(cut[tuple(p)]), r) for p, r in parted], "_cut bigint, _rest double")
        have = same(work, state).groupBy("_pattern", "_rest").agg(F.coalesce(F.sum(F.when(F.col("_hash") <= F.col("_cut"), F.col("_size"))), F.lit(0)).alias("h"))
        gap = {tuple(r["_pattern"]): r["_rest"] - r["h"] for r in have.collect()}
        for _ in range(flips):  # take or leave the one document that brings the sum nearest to the rest
            open_ = [(list(p), int(cut[p]), flipped[p], float(g)) for p, g in gap.items() if abs(g) >= 1]
            if not open_:
                break
            rows = same(work, plan(open_, "_cut bigint, _flipped array<bigint>, _gap double")).where(~F.array_contains("_flipped", F.col("_hash")))
            after = F.col("_gap") - F.when(F.col("_hash") <= F.col("_cut"), -F.col("_size")).otherwise(F.col("_size"))
            best = rows.where(F.abs(after) < F.abs("_gap")).groupBy("_pattern").agg(F.min(F.struct(F.abs(after).alias("off"), "_hash", after.alias("gap"))).alias("b")).collect()
            gap = {tuple(r["_pattern"]): r["b"]["gap"] for r in best}
            for r in best:
                flipped[tuple(r["_pattern"])].append(r["b"]["_hash"])
    state = plan([(list(p), full[p], int(cut.get(p, -1)), flipped[p]) for p in capacity], "_full int, _cut bigint, _flipped array<bigint>")
    marked = docs.withColumn("_rq_p", F.array_sort(F.array_distinct(members))).withColumn("_rq_h", h).withColumn("_rq_s", F.coalesce(size, F.lit(0)))
    more = ((F.col("_rq_h") <= F.col("_cut")) != F.array_contains("_flipped", F.col("_rq_h"))).cast("int")
    times = F.when(F.col("_rq_s") > 0, F.coalesce(F.least(F.col("_full") + more, F.lit(passes)), F.lit(0))).otherwise(F.lit(0))
    return marked.join(state, F.col("_rq_p").eqNullSafe(F.col("_pattern")), "left").select(
        *[marked[c] for c in docs.columns if c != rounds], times.cast("int").alias(rounds))
