"""Conversation repair against plain searches over the grammar."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from runquarry.llm import conversations as C, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Plain search over states: the least (cost, audit), the counts and the hash of one conversation in order."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        words = WORD.findall(text)
        kinds.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        if words:
            seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    n = len(rows)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    end = {"": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (3, "I", ("assistant:",)), "a": (0, "", ())}

    best = {s: end[s] for s in end}  # cost, audit and lines from here on, before an item
    for i in range(n - 1, -1, -1):
        _, _, role, text = rows[i]
        extra = 3 * (kinds[i] == "t")
        use = {}
        for s in end:
            found = [(best[s][0] + 4, "D" + best[s][1], best[s][2])]
            if kinds[i] not in ("b", "d"):
                for letter in after[s]:
                    if role[:1] == letter:
                        c, a, lines = best[letter]
                        found.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                    if letter != "s":
                        c, a, lines = best[letter]
                        found.append((c + extra + 3, "R" + a, (f"{names[letter]}:{text}", *lines)))
            use[s] = min(found)
        for _ in range(3):  # an insertion leads on to another state before the same item
            for s in end:
                for letter in after[s]:
                    if letter != "s":
                        c, a, lines = use[letter]
                        use[s] = min(use[s], (c + 3, "I" + a, (f"{names[letter]}:", *lines)))
        best = use
    cost, audit, lines = best[""]
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def grouped(rows):
    """Rows by conversation in the operator's order; conversations without rows too."""
    out = {}
    for r in rows:
        out.setdefault(r[0], [])
    for r in sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0)):
        out[r[0]].append(r)
    return {c: repaired(v) for c, v in out.items()}


def result(df, **how):
    rows = C.repair_conversations(C.damage(df), copies="copies", **how)[0].collect()
    found = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(found) == len(rows)
    return found


def invented(n_conv, seed, longest=30, roles=("user", "assistant", "system", "tool", None, "", "ass", "sys")):
    rng, rows = random.Random(seed), []
    for c in range(n_conv):
        for t in range(rng.randrange(1, longest)):
            text = rng.choice(["Yes.", "No!", "cut", "", " \t", None, "Why?", "a longer one", f"unique {rng.random()}.", f"unique {rng.random()}"])
            rows.append((c if c else None, rng.choice([t, t, t, t + 5 * (t > 3)]) if t or c % 3 else None, rng.choice(roles[:2] * 6 + roles), text))
    return [r for _, r in sorted({(r[0], r[1]): r for r in rows}.items(), key=str)]  # one row a turn, so that the order is fixed


def items(initials, extra, gone=None):
    j = C.Judged()
    j.initials, j.extra, j.gone = list(initials), list(extra), gone or [0] * (len(initials) + 1)
    return j


def test_alignment_equals_trying_every_edit_string():
    def tries(initials, extra):
        m, best = len(initials), None
        for size in range(m, m + 6):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in audit) != m:
                    continue

                def walk(k, i, state, cost):
                    nonlocal best
                    if best and cost > best[0]:
                        return
                    if k == size:
                        if state in ("", "a"):
                            best = min(best or (cost, audit), (cost, audit))
                        return
                    e = audit[k]
                    if e == "D":
                        walk(k + 1, i + 1, state, cost + 4)
                    elif e == "I":
                        walk(k + 1, i, "a" if state == "u" else "u", cost + 3)
                    elif e == "R":
                        walk(k + 1, i + 1, "a" if state == "u" else "u", cost + 3 + extra[i])
                    elif initials[i] == "s" and state == "":
                        walk(k + 1, i + 1, "s", cost + extra[i])
                    elif initials[i] == ("a" if state == "u" else "u"):
                        walk(k + 1, i + 1, initials[i], cost + extra[i])

                walk(0, 0, "", 0)
        return best[0], "".join(best[1])

    cases = [(i, e) for m in range(3) for i in itertools.product("suax", repeat=m) for e in itertools.product((0, 3), repeat=m)]
    cases += [(tuple(i), (0, 3, 0)) for i in ("sua", "suu", "uss", "asu", "xus", "aau")]
    for initials, extra in cases:
        assert C.align(items(initials, extra)) == tries(initials, extra), (initials, extra)


def test_parts_join_to_the_whole():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randrange(0, 40)
        initials, extra = [rng.choice("suauaxua") for _ in range(n)], [rng.choice((0, 0, 3)) for _ in range(n)]
        gone = [rng.choice((0, 0, 0, 1, 2)) for _ in range(n + 1)]
        whole = C.align(items(initials, extra, gone))
        cuts = sorted(rng.randrange(n + 1) for _ in range(rng.randrange(4)))
        parts = []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
            parts.append(C.align_part(items(initials[a:b], extra[a:b], [0 if k else gone[0], *gone[a + 1:b + 1]])))
        assert C.join_parts(parts) == whole


def test_invented_conversations(spark):
    rows = invented(150, 1)
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, c int")
    want = grouped(rows)
    assert result(df) == want
    assert result(df, block_rows=4) == want  # nearly every conversation is cut to parts
    assert result(df.repartition(7), block_rows=1) == want
    assert result(df.limit(0)) == {}


def test_long_conversations(spark):
    rows = invented(3, 2, longest=1500)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = grouped(rows)
    assert result(df) == want and max(len(w[6]) for w in want.values()) > 300
    assert result(df, block_rows=50) == want


def test_one_conversation_of_copies(spark):
    rows = [(1, 0, "user", "same text.")] * 3000 + [(1, 5, "assistant", "fine.")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(8)
    found, _ = C.repair_conversations(df, block_rows=100)
    r = found.first()
    assert (r["gaps"], r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (4, 3000, 3000, 12000, "K" + "D" * 2999 + "KD")
    assert r["repaired_sha256"] == hashlib.sha256(b"user:same text.\nassistant:fine.").hexdigest()


@pytest.mark.parametrize("block_rows", [400, 3])
def test_repaired_turns(spark, block_rows):
    rows = invented(40, 5)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    summary, turns = C.repair_conversations(C.damage(df), copies="copies", keep_turns=True, block_rows=block_rows)
    lines = {}
    for r in turns.collect():
        lines.setdefault(r["conv_id"], {})[r["position"]] = r
    for r in summary.collect():
        kept = lines.get(r["conv_id"], {})
        assert sorted(kept) == list(range(len(r["audit"].replace("D", ""))))
        kept = [kept[i] for i in range(len(kept))]
        assert "".join(k["edit"] for k in kept) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{k['role']}:{k['text']}" for k in kept).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(k["role"][0] for k in kept))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == grouped(rows)
