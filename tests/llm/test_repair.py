"""Repair of conversations against all edits of short ones, and against plain folds of long ones."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from strandlake.llm import entries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost int, path string, run int"
WORDS = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        body = WORDS.findall(text)
        yield "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))


def all_edits(rows):
    """The least (cost, audit) of all sequences of edits, with what they leave; none costs more than to delete everything."""
    marks, best = list(faults(rows)), []

    def go(i, cost, audit, roles, lines):
        if cost > 2 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best.append((cost, audit, "\n".join(lines)))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", roles + role[0], [*lines, f"{role}:"])
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", roles, lines)
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                if role:  # an empty role is no role
                    go(i + 1, cost + more, audit + "K", roles + role[0], [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", roles + new[0], [*lines, f"{new}:{text}"])

    go(0, 0, "", "", [])
    return min(best)


def folded(rows):
    """The same by a plain fold over single turns."""
    state = {"": (0, "", [])}
    for (_, _, role, text), mark in zip(rows, faults(rows), strict=True):
        new = collections.defaultdict(list)
        for at, (cost, audit, lines) in state.items():
            new[at].append((cost + 2, audit + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            more = 5 * (mark == "truncated")
            ways = [(at, cost, audit, lines)]
            need = "assistant" if at == "u" else "user"
            ways.append((need[0], cost + 5, audit + "I", [*lines, f"{need}:"]))
            for here, c, a, kept in ways:
                need = "assistant" if here == "u" else "user"
                if role[:1] == need[0]:
                    new[need[0]].append((c + more, a + "K", [*kept, f"{role}:{text}"]))
                else:
                    new[need[0]].append((c + more + 1, a + "R", [*kept, f"{need}:{text}"]))
                if role[:1] == "s" and here == "":
                    new["s"].append((c + more, a + "K", [*kept, f"{role}:{text}"]))
        state = {k: min(v) for k, v in new.items()}
    ends = [state.get(k) for k in ("", "a") if k in state]
    if "u" in state:
        c, a, lines = state["u"]
        ends.append((c + 5, a + "I", [*lines, "assistant:"]))
    return min(ends)


def want(rows, repaired):
    out = {}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, own in by.items():
        left = after_damage(own)
        marks = collections.Counter(faults(left))
        turns = [r[1] for r in left if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        cost, audit, text = repaired(left)
        text = text if isinstance(text, str) else "\n".join(text)
        out[conv] = (gaps, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    found = repair.repaired_after_damage(frame).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def odd(rng, convs, turns):
    texts = ["Yes.", "No!", "cut off", "", " \t", "a\nb?", "end. ", None, "é ü."]
    roles = ["user", "assistant", "system", "tool", "", None]
    return [(c, rng.choice([None, *range(turns)]), rng.choices(roles, (6, 6, 2, 1, 1, 1))[0], rng.choice(texts)) for c in [*range(convs), None] for _ in range(rng.randint(1, turns))]


def test_all_edits_of_short_conversations(spark):
    rows = odd(random.Random(3), 120, 5)
    assert got(spark, rows) == want(rows, all_edits)


def test_runs_compose(spark, monkeypatch):
    """Long conversations, cut into runs of four turns and groups of four runs, and texts that several buckets of turns hold."""
    monkeypatch.setattr(repair, "RUN_BITS", 2)
    monkeypatch.setattr(repair, "BUCKET_TURNS", 16)
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"text {t}.", f"cut {t}", "Yes.", f"Well {t % 9}!"])) for c, n in ((1, 150), (2, 3), (3, 70)) for t in range(n)]
    rows += rows[:40]  # repeated rows are copies
    assert got(spark, rows) == want(rows, folded)


def test_one_insertion_is_dearer_than_a_deletion_but_defined():
    """A fold over single states gives the edits that the contract names also where nothing but an insertion would do."""
    assert all_edits([(1, 0, "user", "Hi.")])[:2] == (2, "D")


def test_dropped_empty_and_hot(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, [(gone, 0, "user", "x.")]) == {gone: nothing}
    assert repair.repaired_after_damage(spark.createDataFrame([], SCHEMA)).count() == 0
    hot = [(7, 1, "user", "Same.")] * 3000 + [(7, 2, "assistant", "y" * 2_000_000 + ".")]
    assert got(spark, hot) == want(hot, folded)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    rows = {tuple(r) for r in entries.queries()["op13_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert rows == set(con.sql(entries.oracle_sql()["op13_repair"]).fetchall()) and len(rows) == 100
    odd_rows = [(*r, 1, "x", 2) for r in odd(random.Random(9), 200, 7)]
    frame = spark.createDataFrame(odd_rows, SCHEMA)
    con.register("conversations_py", frame.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    con.execute("create or replace view conversations as select * from conversations_py")
    assert {tuple(r) for r in repair.repaired_after_damage(frame).collect()} == set(con.sql(entries.oracle_sql()["op13_repair"]).fetchall())


@pytest.mark.parametrize("text,last", [("a.\r\n", False), ("a. ", True), ("a.\x1c", True)])
def test_white_space_is_ascii(spark, text, last):
    keep = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    assert got(spark, [(keep, 0, "user", text)])[keep][3] == int(last)
