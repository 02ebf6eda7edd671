"""Repair of conversations' structure: the cheapest edits that make the turns alternate, as a fold in Spark SQL.

A conversation is legal if its roles' initials read (s?(ua)+)?, so reading it takes four states: nothing yet, a
system turn, a user turn, an assistant turn. A fold over the sorted turns carries for each state the least
(cost, edits) that reach it. Costs add up and edits are appended, so folds compose: a run of turns is a table of 16
such pairs, from each state to each, and tables of runs are folded again. So a conversation is cut into
runs of RUN turns, the runs into groups of as many, and no array grows with a conversation.

Letters of edits, within this module: D delete, I insert a user turn, J insert an assistant turn, K keep, R rerole
to user, S rerole to assistant, d delete one more copy of the same turn. Written, J is I, S is R and d is D. Their
order is the written order: where two strings first differ they have the same state and turn, in which only one of
I and J, and only one of R and S, can follow, and copies stand in the same places of both.
Inserted turns come as late as they can, since D sorts before I.

Texts go through no fold: turns are known there by the MD5 of their text. Only those that stay are joined with
their text, once; a conversation's digest needs its text in one value, which Spark bounds at 2 GB.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import kept

#: Turns in a run, and runs in a group: 2**RUN_BITS.
RUN_BITS = 8
#: Turns of a bucket, within which copies of a text are found by a window.
BUCKET_TURNS = 1024
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: More than any repair can cost: what can't be reached.
NEVER = 1 << 40
STATES = ("nothing", "system", "user", "assistant")
SPACE = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns (conv, turn, role, text, n) after the damage that the hash of conversation and turn names; n is 2 for a repeated turn.

    Nulls are one space in the hash, the role and the text. One in 20 hashes each drops a turn, empties its text, removes the
    ends of its sentences, repeats it, or makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.where("fate <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, n) as one row for each distinct turn, without text: its digest, n copies, blank, again, truncated.

    again: an earlier turn has this role and text. A window finds it among turns of one bucket; a text that several buckets
    hold is new in the first of them only. Null turns come first, turns that are equal in order of role and digest.
    """
    end = F.rtrim("text", F.lit(SPACE))
    few = rows.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "n", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    few = few.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.sum("n").alias("n"))
    few = few.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS).cast("long"), F.lit(-(1 << 62))))
    seen = F.row_number().over(W.partitionBy("conv", "role", "digest", "bucket").orderBy(F.asc_nulls_first("turn"))) > 1
    spread = few.groupBy("conv", "role", "digest").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last")).where("first < last").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = few.withColumn("seen", seen)
    same = marked["conv"].eqNullSafe(spread["c"]) & (marked["role"] == spread["r"]) & (marked["digest"] == spread["d"])
    again = F.col("seen") | F.coalesce(F.col("bucket") > F.col("first"), F.lit(False))
    return marked.join(spread, same, "left").select("conv", "turn", "role", "digest", "n", "blank", again.alias("again"), "truncated")


def _pair(cost, edits) -> Column:
    return F.struct(cost.cast("long").alias("cost"), edits.alias("edits"))


def _with(pair: Column, cost, edits) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _pair(pair["cost"] + lit(cost), F.concat(pair["edits"], lit(edits)))


def _after(v: Column, row: Column) -> Column:
    """The four pairs after one more turn: deleted from any state, or kept or reroled as what the state needs, if need be after an insertion."""
    z, s, u, a = (v[x] for x in STATES)
    as_user = lambda p, cost=0, edits="": _with(p, row["user_cost"] + cost, F.concat(F.lit(edits), row["user_edit"]))
    as_assistant = lambda p, cost=0, edits="": _with(p, row["assistant_cost"] + cost, F.concat(F.lit(edits), row["assistant_edit"]))
    gone = lambda p: _with(p, DELETE * row["n"], row["gone_edit"])
    return F.struct(
        gone(z).alias("nothing"),
        F.least(gone(s), _with(z, row["system_cost"], row["keep_edit"])).alias("system"),
        F.least(gone(u), as_user(z), as_user(s), as_user(a), as_user(u, INSERT, "J")).alias("user"),
        F.least(gone(a), as_assistant(u), *(as_assistant(p, INSERT, "I") for p in (z, s, a))).alias("assistant"),
    )


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of at most 2**RUN_BITS sorted turns: turns, the pairs from each state to each, and what is counted.

    Range partitions cut large conversations too; places in the order come from the sorted partitions.
    """
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    stays = ~(F.col("blank") | F.col("again"))
    initial = F.left("role", F.lit(1))
    copies = F.repeat(F.lit("d"), (F.col("n") - 1).cast("int"))
    # the first copy stays at its cost, the others go
    cost = lambda of: (F.when(stays, of + F.when(F.col("truncated"), TRUNCATED).otherwise(0) + DELETE * (F.col("n") - 1)).otherwise(NEVER)).cast("long")
    rerole = lambda x: F.when(initial == x, 0).otherwise(REROLE)
    turn = F.struct(
        "at", "turn", "role", "digest", "n", initial.alias("initial"),
        cost(rerole("u")).alias("user_cost"), F.concat(F.when(initial == "u", "K").otherwise("R"), copies).alias("user_edit"),
        cost(rerole("a")).alias("assistant_cost"), F.concat(F.when(initial == "a", "K").otherwise("S"), copies).alias("assistant_edit"),
        cost(F.when(initial == "s", 0).otherwise(NEVER)).alias("system_cost"), F.concat(F.lit("K"), copies).alias("keep_edit"), F.concat(F.lit("D"), copies).alias("gone_edit"),
    )
    blank, again = F.col("blank"), F.col("again")
    runs = placed.groupBy("conv", F.shiftright("at", RUN_BITS).alias("run")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(again, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum((~blank & ~again & F.col("truncated")).cast("long")).alias("truncated"),
        F.sum(F.col("n") - 1).alias("copies"),
    )
    start = F.array(*(F.struct(*(_pair(F.lit(0 if i == j else NEVER), F.lit("")).alias(x) for j, x in enumerate(STATES))) for i in range(4)))
    table = F.aggregate("turns", start, lambda v, row: F.transform(v, lambda x: _after(x, row)))
    path = lambda v, i: F.struct(*(F.struct(v[x]["cost"], v[x]["edits"], i.cast("string").alias("path")).alias(x) for x in STATES))
    ends = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    size = F.size("turns")
    pairs = F.zip_with(F.slice("turns", F.lit(1), size - 1), F.slice("turns", F.lit(2), size - 1), lambda a, b: ends(a["initial"], b["initial"]))
    illegal = F.aggregate(pairs, F.col("copies"), operator.add)
    return runs.select("conv", "run", "turns", F.transform(table, path).alias("table"), F.get("turns", F.lit(0))["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"), "blank", "duplicate", "truncated", illegal.alias("illegal"))


def _joined(parts: DataFrame, group: list) -> DataFrame:
    """The parts of each group, in order of run, as one part: tables composed, counts added, and the seams between them looked at."""
    counts = ("blank", "duplicate", "truncated")
    listed = parts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("run", "table", "first", "last", "illegal"))).alias("parts"), *(F.sum(c).alias(c) for c in counts))

    def via(v: Column, table: Column) -> Column:
        step = lambda i, x, y: F.struct((v[x]["cost"] + table[i][y]["cost"]).alias("cost"), F.concat(v[x]["edits"], table[i][y]["edits"]).alias("edits"), F.concat(v[x]["path"], table[i][y]["path"]).alias("path"))
        return F.struct(*(F.least(*(step(i, x, y) for i, x in enumerate(STATES))).alias(y) for y in STATES))

    def grown(acc: Column, part: Column) -> Column:
        seam = (~F.concat(acc["last"], part["first"]).isin("su", "ua", "au")).cast("long")
        table = F.transform(acc["table"], lambda v: via(v, part["table"]))
        return F.struct(acc["run"].alias("run"), table.alias("table"), acc["first"].alias("first"), part["last"].alias("last"), (acc["illegal"] + part["illegal"] + seam).alias("illegal"))

    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    names = [c for c in ("conv", "group") if c in listed.columns]
    return listed.select(*names, F.aggregate(rest, F.get("parts", F.lit(0)), grown).alias("whole"), *counts).select(*names, "whole.*", *counts)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, n) to one row for each conv: blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by turn, nulls first, equal ones by role and the text's MD5; n says how often a row stands there, and
    rows that repeat are copies of each other. A null conv is a conversation. A role counts by its first character; an
    empty one can only be reroled or deleted. Texts may be empty (blank) or very long; null roles and texts aren't
    expected (`damaged` makes them a space). No rows give no rows.
    """
    runs = kept(_runs(flagged(rows)))
    groups = _joined(runs, ["conv", F.shiftright("run", RUN_BITS).alias("group")])
    whole = _joined(groups, ["conv"])
    start = F.col("table")[0]
    ended = lambda x, cost, edits, k: F.struct((start[x]["cost"] + cost).alias("cost"), F.concat(start[x]["edits"], F.lit(edits)).alias("edits"), F.concat(start[x]["path"], F.lit(str(k))).alias("path"), F.lit(edits).alias("tail"))
    best = F.least(ended("nothing", 0, "", 0), ended("assistant", 0, "", 3), ended("user", INSERT, "J", 2), ended("system", 2 * INSERT, "IJ", 1))
    whole = kept(whole.select("conv", "blank", "duplicate", "truncated", "illegal", best.alias("best")))
    # each run's states before and after give its edits, and these its turns' places
    order = runs.groupBy("conv").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    ways = whole.select(F.col("conv").alias("c"), F.col("best.path").alias("path")).join(order, F.col("c").eqNullSafe(order["conv"])).select("c", "path", F.posexplode("runs").alias("k", "r"))
    state = lambda k: F.substring("path", k, F.lit(1)).cast("int")
    ways = ways.select("c", "r", state(F.col("k") + 1).alias("before"), state(F.col("k") + 2).alias("after"))
    done = runs.join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    row = F.get("table", F.col("before"))
    edits = reduce(lambda e, k: e.when(F.col("after") == k, row[STATES[k]]["edits"]), range(1, 4), F.when(F.col("after") == 0, row[STATES[0]]["edits"]))
    tokens = F.regexp_extract_all(edits, F.lit("([IJ]*[DKRS]d*)"), F.lit(1))
    each = done.select("conv", F.explode(F.arrays_zip(F.col("turns").alias("turns"), tokens.alias("tokens"))).alias("x")).select(F.col("conv").alias("c"), "x.turns.at", F.col("x.turns.turn").alias("t"), F.col("x.turns.role").alias("r"), F.col("x.turns.digest").alias("d"), F.col("x.tokens").alias("token"))
    each = each.where("token rlike '[KRS]'")
    texts = rows.select("conv", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    same = texts["conv"].eqNullSafe(each["c"]) & texts["turn"].eqNullSafe(each["t"]) & (texts["role"] == each["r"]) & (texts["digest"] == each["d"])
    token = F.col("token")
    role = F.when(token.contains("R"), "user").when(token.contains("S"), "assistant").otherwise(F.col("role"))
    line = F.concat(F.when(token.startswith("I"), "user:\n").when(token.startswith("J"), "assistant:\n").otherwise(""), role, F.lit(":"), F.col("text"))
    lines = texts.join(each, same).groupBy("conv").agg(F.sort_array(F.collect_set(F.struct("at", line.alias("line")))).alias("lines")).select(F.col("conv").alias("c"), "lines")
    joined = whole.join(lines, whole["conv"].eqNullSafe(lines["c"]), "left")
    tail = F.when(F.col("best.tail") == "J", F.array(F.lit("assistant:"))).when(F.col("best.tail") == "IJ", F.array(F.lit("user:"), F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>")), tail), "\n")
    return joined.select("conv", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate("best.edits", "JSd", "IRD").alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


def repaired_after_damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every conversation of turns, damaged (see damaged) and repaired (see repair_conversations), with the gaps among its turns.

    One row for each value of conv_col, null included, also where the damage leaves no turn: then counts are 0, the audit is empty and
    the digest that of no text. Repeated rows are copies. Columns beyond the four don't matter, whatever their names. An
    empty table gives no rows.
    """
    rows = damaged(turns, conv_col, turn_col, role_col, text_col)
    repaired = repair_conversations(rows)
    span = rows.where("turn is not null").groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.countDistinct("turn").alias("distinct")).select(F.col("conv").alias("g"), (F.col("high") - F.col("low") + 1 - F.col("distinct")).alias("gaps"))
    every = turns.select(F.col(f"`{conv_col}`").alias("id")).distinct()
    out = every.join(span, F.col("id").eqNullSafe(F.col("g")), "left").join(repaired, F.col("id").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(conv_col), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
