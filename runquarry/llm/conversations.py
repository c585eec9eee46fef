"""Conversation structure repair: turns are aligned to the alternating grammar ``(s?(ua)+)?`` at the least cost."""

from __future__ import annotations

import hashlib
import os.path
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runquarry.llm.common import fixed, slices

# What an edit costs, and what a truncated turn costs that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_FAR = 1 << 40
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_LEGAL = frozenset(("su", "ua", "au"))
_NAMES = {"u": "user", "a": "assistant"}
# What has been said so far: nothing, the system turn only, last a user turn, last an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)


@dataclass
class Turns:
    """Some consecutive turns of a conversation: a row with ``copies`` > 1 stands there so often, one with 0 does not."""

    turn: list = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)


@dataclass
class Judged:
    """Faults and alignment items of some turns. Item i may be kept; ``gone[i]`` turns before it have to be deleted."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    first: str = ""
    last: str = ""
    rows: int = 0
    initials: list[str] = field(default_factory=list)
    extra: list[int] = field(default_factory=list)
    gone: list[int] = field(default_factory=lambda: [0])
    source: list[int] = field(default_factory=list)


def judge(turns: Turns, known: list[bool] | None = None) -> Judged:
    """Faults of each turn (the first that holds counts) and what is left to align.

    ``known``: whether each row repeats an earlier one; without it that is found among these turns.
    """
    out, seen, before = Judged(), set(), None
    for i, (turn, role, text, copies) in enumerate(zip(turns.turn, turns.role, turns.text, turns.copies)):
        if not copies:
            continue
        initial = role[:1]
        if before is None:
            out.first = initial
        elif before + initial not in _LEGAL:
            out.illegal += 1
        out.illegal += (copies - 1) * (initial + initial not in _LEGAL)
        before = out.last = initial
        out.rows += copies
        if turn is not None:
            out.distinct += turn != out.high
            out.low, out.high = turn if out.low is None else out.low, turn
        words = _WORD.findall(text[-64:]) or _WORD.findall(text)
        if not words:
            out.blank += copies
            out.gone[-1] += copies
            continue
        again = (role, text) in seen if known is None else known[i]
        seen.add((role, text))
        out.duplicate += copies - (not again)
        if again:
            out.gone[-1] += copies
            continue
        cut = words[-1] not in ".!?"
        out.truncated += cut
        out.initials.append(initial)
        out.extra.append(TRUNCATED * cut)
        out.source.append(i)
        out.gone.append(copies - 1)
    return out


class Alignment:
    """Wagner-Fischer tables of items against all strings of the grammar that end with ``last``, filled from the end.

    ``cost[i, q]`` is the least cost of items i and later against the last q letters; as the letters alternate, one table
    serves every length. ``led[i, q]`` is the same where a system turn is still to come before the q letters. With
    ``trailing`` letters may be inserted behind the last item. Cells are filled only in Ukkonen's band: within ``budget``
    (the cost of a known alignment) at most budget / 4 items can be deleted and budget / 3 letters inserted from there.
    """

    def __init__(self, items: Judged, last: str, trailing: bool, budget: int):
        self.items, self.m, self.other = items, len(items.initials), "u" if last == "a" else "a"
        self.last, m = last, self.m
        width = m + budget // INSERT + 2
        q = np.arange(width)
        wrong = {c: np.where((q % 2 == 1) == (c == last), 0, REROLE) for c in "ua"}
        wrong[""] = np.full(width, REROLE)
        cost = self.cost = np.full((m + 1, width), _FAR)
        if trailing:
            cost[m] = INSERT * q
        cost[:, 0] = DELETE * np.arange(m, -1, -1)
        for i in range(m - 1, -1, -1):
            low, high = max(1, m - i - budget // DELETE), min(width, m - i + budget // INSERT + 1)
            if low >= high:
                continue
            c = items.initials[i]
            take = cost[i + 1, low - 1:high - 1] + wrong[c if c in _NAMES else ""][low:high] + items.extra[i]
            here = np.minimum(cost[i + 1, low:high] + DELETE, take)
            ahead = min(cost[i, low - 1], _FAR) - INSERT * (low - 1)
            slope = INSERT * q[low:high]
            cost[i, low:high] = np.minimum(np.minimum.accumulate(here - slope), ahead) + slope
        self.led = np.full((m + 1, width), _FAR)
        if "s" in items.initials:
            for i in range(m - 1, -1, -1):
                self.led[i] = self.led[i + 1] + DELETE
                if items.initials[i] == "s":
                    self.led[i] = np.minimum(self.led[i], cost[i + 1] + items.extra[i])

    def letter(self, q: int) -> str:
        return self.last if q % 2 else self.other

    def audit(self, q: int, led: bool) -> str:
        """The least edit string of all cheapest alignments with q letters: at each cell the first in D, I, K, R that is
        on a cheapest path."""
        cost, items, i = self.cost, self.items, 0
        out = ["D" * items.gone[0]]
        while i < self.m or q:
            table = self.led if led else cost
            now = table[i, q]
            if i < self.m and table[i + 1, q] + DELETE == now:
                out.append("D")
            elif led:
                led = False
                out.append("K")
            elif q and cost[i, q - 1] + INSERT == now:
                out.append("I")
                q -= 1
                continue
            else:
                out.append("K" if items.initials[i] == self.letter(q) else "R")
                q -= 1
            i += 1
            out.append("D" * items.gone[i])
        return "".join(out)

    def best(self, lengths: np.ndarray, led: np.ndarray) -> tuple[int, str] | None:
        """(cost, audit) of the cheapest of some lengths, without and behind a system turn; of ties the least audit."""
        found = [(self.cost[0, lengths], False, lengths), (self.led[0, led], True, led)]
        least = min((int(c.min()) for c, _, n in found if len(n)), default=_FAR)
        if least >= _FAR:
            return None
        return least, min(self.audit(int(n), is_led) for c, is_led, ns in found for n in ns[c == least])


def straight(items: Judged, first: str, last: str) -> int:
    """Cost of one plain alignment from letter ``first`` to ``last``: item by item, with one inserted letter or one deleted
    item in front where the number of items is odd for it."""
    m = len(items.initials)
    fits = m and (m % 2 == 1) == (first == last)
    costs = []
    for skip, add in (((0, 0),) if fits else ((0, 1), (1, 0))):
        n = m - skip + add
        if n < 1 or skip > m:
            continue
        letters = (first + ("a" if first == "u" else "u")) * (n // 2 + 1)
        pairs = zip(items.initials[skip:], letters[add:n])
        costs.append(DELETE * skip + INSERT * add + sum(REROLE * (a != b) for a, b in pairs) + sum(items.extra[skip:]))
    return min(costs, default=INSERT)


def align(items: Judged) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    budget = min(DELETE * len(items.initials), straight(items, "u", "a"))
    a = Alignment(items, "a", True, budget)
    even = np.arange(0, a.cost.shape[1], 2)
    cost, audit = a.best(even, even[1:])
    return cost + DELETE * sum(items.gone), audit


def align_part(items: Judged) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of some turns within a conversation, for all states; letters are inserted
    only before an item, so that what stands between two parts belongs to the later one."""
    gone, found = DELETE * sum(items.gone), []
    budget = max(straight(items, a, b) for a in "ua" for b in "ua")
    for last, after in (("u", USER), ("a", ASSISTANT)):
        table = Alignment(items, last, False, budget)
        lengths = np.arange(1, table.cost.shape[1])
        from_user = lengths[lengths % 2 == (0 if last == "a" else 1)]  # the first letter is u
        from_assistant = lengths[lengths % 2 == (1 if last == "a" else 0)]
        for before, ns, led in ((START, from_user, from_user), (SYSTEM, from_user, lengths[:0]), (ASSISTANT, from_user, lengths[:0]), (USER, from_assistant, lengths[:0])):
            best = table.best(ns, led)
            if best:
                found.append((before, after, best[0] + gone, best[1]))
    none, zero = np.arange(0), np.arange(1)
    only = table.best(none, zero)
    if only:
        found.append((START, SYSTEM, only[0] + gone, only[1]))
    cost, audit = table.best(zero, none)
    found += [(state, state, cost + gone, audit) for state in range(4)]
    return [min(x for x in found if x[:2] == key) for key in sorted({x[:2] for x in found})]


def join_parts(parts: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its parts in order, as ``align`` gives it for the whole.

    No audit of equal cost between the same two states begins with another one, so the least of the parts make up the
    least of the whole. What all states have in common is set aside after every part.
    """
    done, states = [], {START: (0, "")}
    for part in parts:
        new: dict[int, tuple[int, str]] = {}
        for before, after, cost, audit in part:
            if before in states:
                so_far = states[before]
                there = so_far[0] + cost, so_far[1] + audit
                new[after] = min(new.get(after, there), there)
        common = os.path.commonprefix([a for _, a in new.values()])
        done.append(common)
        states = {s: (c, a[len(common):]) for s, (c, a) in new.items()}
    ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    cost, audit = min((c + INSERT * len(ends[s]), a + ends[s]) for s, (c, a) in states.items())
    return cost, "".join(done) + audit


def apply_audit(turns: Turns, audit: str, state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """((edit, role, text) of the repaired turns, the state behind them)."""
    rows = ((r, t) for r, t, n in zip(turns.role, turns.text, turns.copies) for _ in range(n))
    out = []
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and state == START and role[:1] == "s":
            state = SYSTEM
        else:
            letter = "a" if state == USER else "u"
            state = ASSISTANT if letter == "a" else USER
            role = role if edit == "K" else _NAMES[letter]
        out.append((edit, role, text))
    return out, state


def split_audit(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut at turns: the i-th piece deals with ``sizes[i]`` turns, inserted ones belong to the turn behind them."""
    pieces, at = [], 0
    for size in sizes:
        begin = at
        while size:
            size -= audit[at] != "I"
            at += 1
        pieces.append(audit[begin:at])
    if pieces:
        pieces[-1] += audit[at:]
    return pieces


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): each row harmed by crc32 of ``conv:turn`` modulo 20, nulls read as one space.

    0 drops the row (0 copies), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role ``user``.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn))) % 20
    return rows.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(plain(role)).alias(role),
                       F.when(kind == 1, "").when(kind == 2, F.translate(plain(text), ".!?", "")).otherwise(plain(text)).alias(text),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=24).digest()


def _hashed(turns: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in turns)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | Column | None = None,
                         keep_turns: bool = False, block_rows: int = 400, block_bytes: int = 1_000_000) -> tuple[DataFrame, DataFrame | None]:
    """Each conversation's faults and its cheapest repair, and with ``keep_turns`` the repaired turns.

    Turns are taken in order of ``turn`` (nulls first, rows of one turn by role and a hash of the text). A turn is blank without
    a character other than space and tab to carriage return, else duplicate if role and text were seen earlier, else
    truncated if its last such character is none of ``.!?``. Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (a must
    for blank and duplicate turns), Insert an empty user or assistant turn 3; 3 more for a truncated turn that stays.
    The edits' initials are the audit; of the cheapest repairs whose role initials give ``(s?(ua)+)?`` the ASCII-least stands.

    Result 1: conv, gaps (numbers missing between the least and the greatest turn), blank, duplicate, truncated, illegal
    (neighbours other than su, ua, au), cost, audit, repaired_sha256 (of ``role:text`` lines joined by line breaks). Result 2:
    conv, position, edit, role, text.

    ``copies``: how often each row stands there, 0 only names its conversation. Rows are dealt by ranges of (conv, turn),
    so a conversation of any length is spread over tasks. Most lie within one task and are repaired there. Others are cut
    to parts of at most ``block_rows`` rows: repeats across parts are found by hash joins, each part is aligned
    between all pairs of states, and one small row per part and pair of states is joined up to the audit, which
    the result holds as a single value anyway. The hash alone runs over a conversation's parts in order, one at a time.

    Null role or text: one space. Null conversations are one conversation, null turns come first and leave no gap. A
    conversation without turns has zeros, an empty audit and the hash of nothing. An empty table gives no rows.
    """
    count = F.lit(1) if copies is None else F.col(copies) if isinstance(copies, str) else copies
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("bigint").alias("t"), space(role).alias("r"), space(text).alias("x"),
                        count.cast("bigint").alias("n"))
    # equal rows may go to several partitions; between them any order is the same
    rows = rows.withColumns({"h": F.xxhash64("x"), "e": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("c", "t", "r", "h", "e").sortWithinPartitions("c", "t", "r", "h", "e").drop("h", "e")
    kind = turns.schema[conv].dataType.simpleString()
    turn_type = "array<struct<edit:string,role:string,text:string>>"
    result = ", ".join(f"{x} bigint" for x in _COUNTS) + ", audit string, sha string" + f", kept {turn_type}" * keep_turns
    held = "t array<bigint>, r array<string>, x array<string>, n array<bigint>, d array<binary>"
    schema = f"c {kind}, part int, block int, open boolean, {result}, {held}"

    def repair(batches):
        from pyspark import TaskContext

        part, block, begun, first = TaskContext.get().partitionId(), 0, False, True
        now, buffer, size, out, key_type = None, Turns(), 0, [], None

        def done(items: Turns):
            judged = judge(items)
            cost, audit = align(judged)
            repaired, _ = apply_audit(items, audit)
            gaps = 0 if judged.low is None else judged.high - judged.low + 1 - judged.distinct
            row = [now, part, block, False, gaps, judged.blank, judged.duplicate, judged.truncated, judged.illegal, cost, audit,
                   hashlib.sha256(_hashed(repaired).encode()).hexdigest()]
            return row + [[dict(zip(("edit", "role", "text"), x)) for x in repaired]] * keep_turns + [None] * 5

        def cut(items: Turns):
            digests = [_digest(r, x) for r, x in zip(items.role, items.text)]
            return [now, part, block, True, *[None] * (8 + keep_turns), items.turn, items.role, items.text, items.copies, digests]

        def batch_of(some: list) -> pa.RecordBatch:
            types = [key_type, pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.list_(_TURN)] * keep_turns,
                     pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some), types)], names=names)

        names = ["c", "part", "block", "open", *_COUNTS, "audit", "sha", *["kept"] * keep_turns, "t", "r", "x", "n", "d"]
        for batch in batches:
            for some in slices(batch, "x", block_bytes):
                key_type = some.column("c").type
                for c, t, r, x, n in zip(*(some.column(k).to_pylist() for k in "ctrxn")):
                    if not begun:
                        now, begun = c, True
                    elif c != now:
                        # the first and the last conversation of a partition may go on in another one
                        out.append((cut if first else done)(buffer))
                        now, buffer, size, block, first = c, Turns(), 0, block + 1, False
                    elif len(buffer.turn) >= block_rows or size + len(x) > block_bytes:
                        out.append(cut(buffer))
                        buffer, size, block, first = Turns(), 0, block + 1, True
                    buffer.turn.append(t)
                    buffer.role.append(r)
                    buffer.text.append(x)
                    buffer.copies.append(n)
                    size += len(x)
                    if len(out) >= 1000 or out and size > block_bytes:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)
                    out = []
        if begun:
            yield batch_of([cut(buffer)])

    all_ = fixed(rows.mapInArrow(repair, schema), "conversations")
    whole = all_.where("not open").select("c", *_COUNTS, "audit", "sha", *["kept"] * keep_turns)
    opened = all_.where("open").select("c", "part", "block", "t", "r", "x", "n", "d")

    # repeats across parts: the first place of each (role, text) of a conversation
    places = opened.select("c", "part", "block", F.posexplode(F.arrays_zip("d", "n")).alias("i", "_z")).where("_z.n > 0")
    firsts = places.groupBy("c", F.col("_z.d").alias("d")).agg(F.min(F.struct("part", "block", "i")).alias("f"))
    firsts = firsts.groupBy(F.col("f.part").alias("part"), F.col("f.block").alias("block")).agg(F.collect_list("f.i").alias("new"))
    facts = [f.name for f in Judged.__dataclass_fields__.values() if f.name not in ("initials", "extra", "gone", "source", "first", "last")]

    def parts(batches):
        way = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        for batch in batches:
            types = [batch.column("c").type, pa.int32(), pa.int32(), *[pa.int64()] * len(facts), pa.string(), pa.string(), pa.list_(way)]
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                new = set(row["new"] or ())
                items = judge(Turns(row["t"], row["r"], row["x"], row["n"]), [k not in new for k in range(len(row["t"]))])
                ways = [dict(zip(("before", "after", "cost", "audit"), w)) for w in align_part(items)]
                found = [row["c"], row["part"], row["block"], *[getattr(items, f) for f in facts], items.first, items.last, ways]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(found, types)], names=["c", "part", "block", *facts, "first", "last", "ways"])

    fact_columns = ", ".join(f"{f} bigint" for f in facts)
    way_type = "array<struct<before:int,after:int,cost:bigint,audit:string>>"
    judged = opened.drop("d").join(firsts, ["part", "block"], "left").select("c", "part", "block", "t", "r", "x", "n", "new")
    judged = judged.mapInArrow(parts, f"c {kind}, part int, block int, {fact_columns}, first string, last string, ways {way_type}")

    def in_order(batches, one):
        """``one(key, rows)`` for the rows of each conversation, which come in order."""
        now, rows, key_type = None, [], None
        for batch in batches:
            key_type = batch.column("c").type
            for row in batch.to_pylist():
                if rows and row["c"] != now:
                    yield one(now, rows, key_type)
                    rows = []
                now = row["c"]
                rows.append(row)
        if rows:
            yield one(now, rows, key_type)

    def joined(batches):
        def one(key, rows, key_type):
            cost, audit = join_parts([[(w["before"], w["after"], w["cost"], w["audit"]) for w in row["ways"]] for row in rows])
            totals = {f: sum(row[f] for row in rows) for f in ("blank", "duplicate", "truncated", "illegal", "distinct")}
            high, last = None, None
            for row in rows:
                if row["low"] is not None:
                    totals["distinct"] -= row["low"] == high
                    high = row["high"]
                if row["rows"]:
                    totals["illegal"] += last is not None and last + row["first"] not in _LEGAL
                    last = row["last"]
            low = next((row["low"] for row in rows if row["low"] is not None), None)
            gaps = 0 if low is None else high - low + 1 - totals["distinct"]
            counts = [gaps, totals["blank"], totals["duplicate"], totals["truncated"], totals["illegal"], cost]
            pieces = split_audit(audit, [row["rows"] for row in rows])
            table, state, position = [], START, 0
            for row, piece in zip(rows, pieces):
                # the counts and the whole audit stand once, in the row of the first part
                table.append([key, row["part"], row["block"], *(counts if not table else [None] * 6), None if table else audit, piece, state, position])
                # an edit string leads from a state to one other; the last part's may end with letters of no turn
                state = next((w["after"] for w in row["ways"] if w["before"] == state and w["audit"] == piece), None)
                position += len(piece) - piece.count("D")
            types = [key_type, pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*table), types)],
                                              names=["c", "part", "block", *_COUNTS, "audit", "piece", "state", "position"])

        yield from in_order(batches, one)

    piece_type = f"c {kind}, part int, block int, " + ", ".join(f"{x} bigint" for x in _COUNTS) + ", audit string, piece string, state int, position bigint"
    known = fixed(judged.repartition("c").sortWithinPartitions("c", "part", "block").mapInArrow(joined, piece_type), "audits")

    def edited(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                kept, _ = apply_audit(Turns(row["t"], row["r"], row["x"], row["n"]), row["piece"], row["state"])
                data = "\n".join(f"{r}:{x}" for _, r, x in kept) if kept else None
                columns = [pa.array([row["c"]], batch.column("c").type), pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([data], pa.string()),
                           pa.array([row["position"]], pa.int64()), pa.array([[dict(zip(("edit", "role", "text"), k)) for k in kept] if keep_turns else None], pa.list_(_TURN))]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "part", "block", "data", "position", "kept"])

    texts = opened.drop("c", "d").join(known.select("c", "part", "block", "piece", "state", "position"), ["part", "block"])
    texts = texts.select("c", "part", "block", "t", "r", "x", "n", "piece", "state", "position").mapInArrow(
        edited, f"c {kind}, part int, block int, data string, position bigint, kept {turn_type}")

    def hashes(batches):
        now, running, key_type, empty = None, None, None, True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([running.hexdigest()], pa.string())], names=["c", "sha"])

        for batch in batches:
            key_type = batch.column("c").type
            for c, data in zip(batch.column("c").to_pylist(), batch.column("data").to_pylist()):
                if running is None or c != now:
                    if running is not None:
                        yield row()
                    now, running, empty = c, hashlib.sha256(), True
                if data is not None:
                    running.update(data.encode() if empty else b"\n" + data.encode())
                    empty = False
        if running is not None:
            yield row()

    sums = texts.select("c", "part", "block", "data").repartition("c").sortWithinPartitions("c", "part", "block").select("c", "data").mapInArrow(hashes, f"c {kind}, sha string")
    totals = known.where("audit is not null").select("c", *_COUNTS, "audit")
    same = totals["c"].eqNullSafe(sums["c"])
    long_ones = totals.join(sums, same).select(totals["c"], *_COUNTS, "audit", "sha")
    summary = whole.select("c", *_COUNTS, "audit", "sha").unionByName(long_ones)
    summary = summary.select(F.col("c").alias(conv), *_COUNTS, "audit", F.col("sha").alias("repaired_sha256"))
    if not keep_turns:
        return summary, None
    every = whole.select("c", F.lit(0).cast("bigint").alias("p"), "kept").unionByName(texts.select("c", F.col("position").alias("p"), "kept"))
    every = every.select("c", "p", F.posexplode("kept").alias("i", "k"))
    return summary, every.select(F.col("c").alias(conv), (F.col("p") + F.col("i")).alias("position"), "k.edit", "k.role", "k.text")
