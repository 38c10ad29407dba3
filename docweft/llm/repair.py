"""Conversation structure repair: the cheapest edits that make roles read system?, (user, assistant)+, with a letter for each edit.

The graph has a node for each place between rows and each state of the wanted order (nothing yet, after system, after user, after
assistant); its edges keep, rerole or delete the next row, or insert an empty one. The value of a node is one integer: the high digits are the
cost of the cheapest way to the end, the low digits, three bits each and as many as a way can have letters, are the letters of its audit
from the front, with zeros behind the end. So the smaller integer is the cheaper way, and of equally cheap ones that with the ASCII-least audit, and
the least integer at each node, from the last to the first, is all there is to decide.

Rows are read as a sorted stream, twice: first in a byte a row, for the audits; then with their texts, each conversation's audit before
its rows. So of one conversation no more than a byte a row is held, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.common import cut, table

#: The costs of edits and the order of their letters.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LETTERS = "DIKR"
D, I, K, R = range(1, 5)
#: A row in a byte: its role's initial (0 to 2 of INITIALS, else 3), then whether it must go and whether it is truncated.
INITIALS = "sua"
MUST_GO, CUT_OFF = 4, 8
#: States, by the last role so far: none, s, u, a. The next state by the next role's initial, None where it can't follow.
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ((AFTER_S, AFTER_U, None), (None, AFTER_U, None), (None, None, AFTER_A), (None, AFTER_U, None))
#: What an inserted or reroled row becomes in a state, and the state after it.
NEEDED = ((1, AFTER_U), (1, AFTER_U), (2, AFTER_A), (1, AFTER_U))
NAMES = ("system", "user", "assistant")
WHITE = " \t\n\x0b\f\r"
#: Over so many rows, integers as long as the audit cost more than they decide: costs are found by themselves, letters front to back.
LONG = 4_096
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def ways(row: int, state: int) -> Iterator[tuple[int, int, int]]:
    """(letter, cost, state after it) of the edits of a row."""
    yield D, DELETE, state
    if not row & MUST_GO:
        more = TRUNCATED if row & CUT_OFF else 0
        initial = row & 3
        if initial < 3 and NEXT[state][initial] is not None:
            yield K, more, NEXT[state][initial]
        yield R, RENAME + more, NEEDED[state][1]


def solve(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation's rows (see INITIALS), of equally cheap ones those with the ASCII-least audit."""
    return _long(rows) if len(rows) > LONG else _by_integers(rows)


def _by_integers(rows: bytes) -> tuple[int, str]:
    letters = len(rows) + DELETE * len(rows) // INSERT + 3  # deleting all rows is cheaper than more inserts
    low = 3 * letters
    mask = (1 << low) - 1
    # In front of a way: its letters move one digit down, the new one comes first, its cost is added to the high digits.
    weight = {(letter, cost): (cost << low) + (letter << low - 3) for letter, cost in [(D, DELETE), (I, INSERT), (K, 0), (K, TRUNCATED), (R, RENAME), (R, RENAME + TRUNCATED)]}
    never = 1 << low + 40 + letters.bit_length()

    def before(value: int, letter: int, cost: int) -> int:
        tail = value & mask
        return value - tail + (tail >> 3) + weight[letter, cost]

    def with_inserts(values: list[int]) -> list[int]:
        best = values
        for _ in range(2):  # more than two in a row would hold a pair that could be left out
            best = [min(values[s], before(best[NEEDED[s][1]], I, INSERT)) for s in range(4)]
        return best

    values = with_inserts([0, never, never, 0])
    for row in reversed(rows):
        values = with_inserts([min(before(values[to], letter, cost) for letter, cost, to in ways(row, s)) for s in range(4)])
    digits, audit = values[NONE] & mask, []
    for place in range(low - 3, -1, -3):
        if not (digit := digits >> place & 7):
            break
        audit.append(LETTERS[digit - 1])
    return values[NONE] >> low, "".join(audit)


def _long(rows: bytes) -> tuple[int, str]:
    """The same from costs alone: of the cheapest ways, all places that the least audit so far can lead to are followed at once."""
    never = 1 << 60

    def with_inserts(costs):
        best = costs
        for _ in range(2):
            best = [min(costs[s], best[NEEDED[s][1]] + INSERT) for s in range(4)]
        return best

    costs = [with_inserts([0, never, never, 0])]
    for row in reversed(rows):
        after = costs[-1]
        costs.append(with_inserts([min(cost + after[to] for _, cost, to in ways(row, s)) for s in range(4)]))
    costs.reverse()
    at, audit, n = {(0, NONE)}, [], len(rows)
    while not any(i == n and costs[n][s] == 0 and s in (NONE, AFTER_A) for i, s in at):
        found: dict[int, set] = {}
        for i, s in at:
            to = NEEDED[s][1]
            if costs[i][s] == INSERT + costs[i][to]:
                found.setdefault(I, set()).add((i, to))
            if i < n:
                for letter, cost, to in ways(rows[i], s):
                    if costs[i][s] == cost + costs[i + 1][to]:
                        found.setdefault(letter, set()).add((i + 1, to))
        least = min(found)
        audit.append(LETTERS[least - 1])
        at = found[least]
    return costs[0][NONE], "".join(audit)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text; nulls in role and text become one space) after the damage that crc32(`conv_id:turn`) mod 20 names, and gone.

    0 drops a row: it stays in the table with gone = true, so that its conversation isn't lost. 1 empties the text, 2 takes `[.!?]` out of it, 3
    repeats the row, 4 makes it the user's. order_role and order_text place rows of one turn: by role, then by a hash of the text, as they were.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.col("role").alias("order_role"), F.xxhash64("text").alias("order_text"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"),
    )


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; nulls in role and text become one space) as damage() returns them, undamaged."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role").alias("role"), filled("text").alias("text"))
    return rows.select("conv_id", "turn", F.col("role").alias("order_role"), F.xxhash64("text").alias("order_text"), "role", "text", F.lit(False).alias("gone"), F.lit(1).alias("copy"))


def in_order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), *[F.asc_nulls_first(c) for c in ("turn", "order_role", "order_text", "copy")]]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, code (see INITIALS; null for rows that are gone), fault (0 none, 1 blank, 2 duplicate, 3 truncated), in conversations' order within partitions by conv_id."""
    blank = F.trim(F.col("text"), F.lit(WHITE)) == ""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    each = rows.select("conv_id", "turn", "order_role", "order_text", "copy", "gone", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    # Rows are dealt by conversation once; the window's finer groups lie within.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "h", "h2", "gone").orderBy(*in_order()[1:])) > 1
    fault = F.when(F.col("blank"), 1).when(seen, 2).when(F.col("open"), 3).otherwise(0)
    marked = each.repartition("conv_id").withColumn("fault", fault)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((F.length("role") == 0) | (initial < 0), 3).otherwise(initial)
    code = initial + F.when(F.col("fault").isin(1, 2), MUST_GO).otherwise(0) + F.when(F.col("fault") == 3, CUT_OFF).otherwise(0)
    return marked.select("conv_id", "turn", "order_role", "order_text", "copy", F.when(~F.col("gone"), code).cast("int").alias("code"), "fault").sortWithinPartitions(*in_order()).select("conv_id", "turn", "code", "fault")


def audits(rows: DataFrame) -> DataFrame:
    """SUMMARY: for each conversation its gaps in turns, numbers of faults and illegal neighbours, and the cost and audit of its repair. rows as from damage() or ordered()."""
    legal = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def summary(conv, codes: bytearray, counts: list[int], turns: list) -> tuple:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        initials = [c & 3 for c in codes]
        return conv, gaps, *counts[1:], sum(x not in legal for x in zip(initials, initials[1:])), *solve(bytes(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, counts, turns, begun, out = None, bytearray(), [0] * 4, [], False, []
        for batch in batches:
            for conv, turn, code, fault in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if not begun or conv != now:
                    if begun:
                        out.append(summary(now, codes, counts, turns))
                    now, codes, counts, turns, begun = conv, bytearray(), [0] * 4, [], True
                if code is None:
                    continue
                codes.append(code)
                counts[fault] += 1
                if turn is not None:  # turns come in order
                    if not turns:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns = [turns[0], turn, turns[2] + 1]
            if len(out) >= 1000:
                yield _batch(out, names)
                out = []
        if begun:
            out.append(summary(now, codes, counts, turns))
        if out:
            yield _batch(out, names)

    return faults(rows).mapInArrow(run, SUMMARY)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, pos, edit, role, text of the repaired conversations' rows, in order within partitions by conv_id; pos 0 is a row of its own before each
    conversation's first, whose text is empty and whose edit is null. rows as from damage() or ordered(), plans as from audits() of them."""
    kind = "conv_id long, turn long, order_role string, order_text long, copy int, role string, text string, audit string"
    heads = plans.select("conv_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in kind.split(", ")[1:-1]], "audit", F.lit(0).alias("row"))
    both = heads.unionByName(rows.filter("not gone").select(*[c.split()[0] for c in kind.split(", ")[:-1]], F.lit(None).cast("string").alias("audit"), F.lit(1).alias("row")))
    stream = both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "row", *in_order()[1:]).select("conv_id", "role", "text", "audit")
    schema = "conv_id long, pos long, edit string, role string, text string"
    names, kinds = ["conv_id", "pos", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, place, state, pos = None, "", 0, NONE, 0

        def inserted() -> Iterator[tuple]:
            nonlocal place, state, pos
            while place < len(audit) and audit[place] == "I":
                role, state = NEEDED[state]
                place, pos = place + 1, pos + 1
                yield conv, pos, "I", NAMES[role], ""

        for batch in batches:
            out = []
            for c, role, text, plan in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if plan is not None:
                    conv, audit, place, state, pos = c, plan, 0, NONE, 0
                    out.append((c, 0, None, "", ""))
                else:
                    letter = audit[place]
                    place += 1
                    if letter == "K":
                        state, pos = NEXT[state][INITIALS.index(role[0])], pos + 1
                        out.append((c, pos, "K", role, text))
                    elif letter == "R":
                        new, state = NEEDED[state]
                        pos += 1
                        out.append((c, pos, "R", NAMES[new], text))
                out.extend(inserted())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return stream.mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), edit, role, text of the repaired conversations: rows that are blank or repeat an earlier role and text go, roles are made to read system?, (user, assistant)+.

    A null role or text counts as one space; a role that is empty or begins with none of s, u, a can't be kept. Rows without a turn come first; rows of one turn
    go by role, then by a hash of the text; other columns are not looked at. All rows with a null conv_id are one conversation. An empty table gives an empty result.
    """
    rows = ordered(conversations)
    return repaired(rows, cut(audits(rows))).filter("pos > 0")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines joined by LF. lines as from repaired(), read in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun = None, None, False
        for batch in batches:
            out = []
            for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if pos == 0:
                    if begun:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, begun = c, hashlib.sha256(), True
                else:
                    digest.update(("\n" * (pos > 1) + f"{role}:{text}").encode())
            if out:
                yield _pairs(out)
        if begun:
            yield _pairs([(conv, digest.hexdigest())])

    return lines.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])


def repair_report(rows: DataFrame) -> DataFrame:
    """SUMMARY and repaired_sha256 of each conversation, those all of whose rows are gone included. rows as from damage() or ordered()."""
    plans = cut(audits(rows))
    found = digests(repaired(rows, plans)).select(F.col("conv_id").alias("of"), "repaired_sha256")
    return plans.join(found, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))
