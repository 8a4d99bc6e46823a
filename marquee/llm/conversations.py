"""Repair of conversations by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn; a task reads its conversations one after the
other in Arrow batches and keeps a few numbers between batches. A dynamic program over the edits
runs along: a state is what the repaired conversation so far ends with (nothing, a system turn, a
user turn, an assistant turn), and each state knows its least cost and where the edits of its best
way rank among those of the other states. Prefixes of equal length in rows never begin one another,
for inserts belong to the row behind them, so ranks decide all ties as whole strings would.

What a row does to costs (less their minimum) and ranks is one of a few dozen steps; the number of
its step is all that a row leaves behind, two bytes. A conversation whose numbers exceed SPILL writes
them to the shared folder in blocks and reads these backwards once its end is known. Texts take no
part in this: a first pass moves faults and digests, a second one, sorted alike, meets the edits of
a conversation before its rows and applies them as it reads.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import BROADCAST_ROWS, cut, shared_dir, tuned

#: Step numbers of a conversation that a task holds before it writes them to the shared folder.
SPILL = 4 << 20
#: Costs of edits, and what a truncated row costs that stays.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What must be inserted behind a state so that a repaired conversation may end.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class Steps:
    """Steps of the dynamic program, each numbered when it is first met.

    A step takes the costs and ranks of the four states over one row. It is found by (costs, ranks,
    initial, fault), its costs relative to the least, and holds the rise of that least, the new
    costs and ranks, and for each new state where its best way came from and by which edits.
    """

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.made: list[tuple] = []

    def number(self, costs: tuple, ranks: tuple, initial: str, fault: str) -> int:
        key = costs, ranks, initial, fault
        if key not in self.numbers:
            self.numbers[key] = len(self.made)
            self.made.append(self._step(*key))
        return self.numbers[key]

    def _step(self, costs: tuple, ranks: tuple, initial: str, fault: str) -> tuple:
        ways: list[list[tuple]] = [[(costs[s] + DELETE, ranks[s], "D", s)] for s in range(4)]
        if fault not in ("blank", "duplicate"):
            stay = TRUNCATED * (fault == "truncated")
            for name, to, before, other in (("u", USER, (NOTHING, SYSTEM, ASSISTANT), (USER,)), ("a", ASSISTANT, (USER,), (NOTHING, SYSTEM, ASSISTANT))):
                edit, cost = ("K", stay) if initial == name else ("R", stay + RELABEL)
                ways[to] += [(costs[s] + cost, ranks[s], edit, s) for s in before]
                ways[to] += [(costs[s] + cost + INSERT, ranks[s], "I" + edit, s) for s in other]
            if initial == "s":
                ways[SYSTEM].append((costs[NOTHING] + stay, ranks[NOTHING], "K", NOTHING))
        best = [min(w) for w in ways]
        least = min(b[0] for b in best)
        order = sorted(range(4), key=lambda s: (best[s][0] == math.inf, best[s][1:3]))
        return least, tuple(b[0] - least for b in best), tuple(order.index(s) for s in range(4)), [(b[3], b[2]) for b in best]


class Trail:
    """The step numbers of one conversation, in memory and, beyond a limit, in shared files."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit, self.numbers, self.blocks = path, limit, array("H"), []

    def add(self, number: int) -> None:
        self.numbers.append(number)
        if len(self.numbers) >= self.limit:
            files, path = fs.FileSystem.from_uri(f"{self.path}/{uuid.uuid4().hex}")
            files.create_dir(path.rpartition("/")[0], recursive=True)
            with files.open_output_stream(path, compression=None) as f:
                f.write(self.numbers.tobytes())
            self.blocks.append((files, path))
            self.numbers = array("H")

    def backwards(self) -> Iterator[array]:
        """Blocks of numbers, the last first; files go as they are read."""
        yield self.numbers
        for files, path in reversed(self.blocks):
            numbers = array("H")
            with files.open_input_stream(path) as f:
                numbers.frombytes(f.read())
            files.delete_file(path)
            yield numbers


class Conversation:
    """Counts and costs of the rows of one conversation so far."""

    def __init__(self, steps: Steps, trail: Trail):
        self.steps, self.trail = steps, trail
        self.base, self.costs, self.ranks = 0, (0, math.inf, math.inf, math.inf), (0, 1, 2, 3)
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first, self.turn, self.row, self.initial = 0, 0, None, None, None, None

    def add(self, turn: int | None, role: str, digest: str, initial: str, fault: str) -> None:
        # rows that are equal in all but faults lie next to each other
        if fault != "blank" and self.row == (turn, role, digest):
            fault = "duplicate"
        self.row = turn, role, digest
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.turn = turn
        number = self.steps.number(self.costs, self.ranks, initial, fault)
        least, self.costs, self.ranks, _ = self.steps.made[number]
        self.base += least
        self.trail.add(number)

    def result(self) -> dict:
        extra = {s: INSERT * len(e) for s, e in ENDING.items()}
        state = min(range(4), key=lambda s: (self.costs[s] + extra[s], self.ranks[s]))
        cost, audit = self.base + self.costs[state] + extra[state], [ENDING[state]]
        for numbers in self.trail.backwards():
            part = []
            for number in reversed(numbers):
                state, edits = self.steps.made[number][3][state]
                part.append(edits)
            audit.append("".join(reversed(part)))
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return {"gaps": min(gaps, (1 << 63) - 1), **self.faults, "illegal": self.illegal, "cost": int(cost), "audit": "".join(reversed(audit))}


def audits(path: str, limit: int) -> Callable:
    """Rows (conv, turn, role, digest, initial, fault, there), sorted, to a row for each
    conversation; a row that is not there only names its conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, at, now = Steps(), None, None
        for batch in batches:
            done = []
            for conv, turn, role, digest, initial, fault, there in zip(*(batch[c] for c in ("conv", "turn", "role", "digest", "initial", "fault", "there")), strict=True):
                if now is None or conv != at:
                    if now:
                        done.append({"conv": at, **now.result()})
                    at, now = conv, Conversation(steps, Trail(path, limit))
                if there:
                    now.add(None if turn is None else int(turn), role, digest, initial, fault)
            yield pd.DataFrame(done, columns=AUDIT)
        if now:
            yield pd.DataFrame([{"conv": at, **now.result()}], columns=AUDIT)

    return run


AUDIT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_AUDIT_TYPES = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def applied(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, list[tuple[str, str]], bool]]:
    """Rows (conv, audit, role, text), each conversation's audit first and then its rows in order,
    to (conv, repaired rows, whether the conversation begins)."""
    conv, audit, place, last = None, None, 0, ""

    def turned() -> str:
        return "assistant" if last == "u" else "user"

    def inserted() -> list[tuple[str, str]]:
        nonlocal place, last
        out = []
        while audit is not None and place < len(audit) and audit[place] == "I":
            out.append((role := turned(), ""))
            place, last = place + 1, role[0]
        return out

    for batch in batches:
        for c, a, role, text in zip(batch["conv"], batch["audit"], batch["role"], batch["text"], strict=True):
            if a is not None:
                if audit is not None:
                    yield conv, inserted(), False
                conv, audit, place, last = c, a, 0, ""
                yield conv, [], True
                continue
            out = inserted()
            edit, place = audit[place], place + 1
            if edit != "D":
                kept = role if edit == "K" else turned()
                out.append((kept, text))
                last = kept[0]
            yield conv, out, False
    if audit is not None:
        yield conv, inserted(), False


def repaired_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, place = [], 0
    for conv, rows, begins in applied(batches):
        place = 0 if begins else place
        for role, text in rows:
            out.append((conv, place, role, text))
            place += 1
        if len(out) >= 1_000:
            yield pd.DataFrame(out, columns=["conv", "place", "role", "text"])
            out = []
    yield pd.DataFrame(out, columns=["conv", "place", "role", "text"])


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each repaired conversation, of role:text joined by newlines."""
    out, at, sha, between = [], None, None, b""
    for conv, rows, begins in chain(applied(batches), [(None, [], True)]):
        if begins:
            if sha:
                out.append((at, sha.hexdigest()))
            at, sha, between = conv, hashlib.sha256(), b""
        for role, text in rows:
            sha.update(between + role.encode() + b":" + text.encode())
            between = b"\n"
        if len(out) >= 1_000:
            yield pd.DataFrame(out, columns=["conv", "sha"])
            out = []
    yield pd.DataFrame(out, columns=["conv", "sha"])


class Repair:
    """The repair of the conversations in rows (see audit, repaired and digest).

    A row's first fault counts: blank (nothing but ASCII blanks), duplicate (role and text stand in
    an earlier row), truncated (its last other character is none of .!?). Edits keep a row (K, free),
    give it the role user or assistant (R), delete it (D, which blank and duplicate rows must be) or
    insert an empty turn of either role (I); truncated rows that stay cost more. The result reads, by
    initials of its roles, as an optional system turn before pairs of user and assistant, or is
    empty. Of the cheapest edits the ASCII-least string of their initials is taken.

    Rows go by turn, null turns first, then by role and by the SHA-256 of the text. Null roles and
    texts count as one space; a role without a first character has no initial and is not kept. Null
    conversations are one conversation. Rows where present is not true only name their conversation,
    which has an empty repair if no other row is in it. Repeated rows are duplicates; no rows, no
    conversations. Further columns are ignored.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, spill: int = SPILL):
        self.spark, self.spill = tuned(rows.sparkSession), spill
        self.conv_col, self.conv_type = conv_col, rows.schema[conv_col].dataType
        text, there = F.coalesce(F.col(text_col), F.lit(" ")), F.lit(True) if present is None else F.coalesce(present, F.lit(False))
        self.rows = rows.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"), there.alias("there"))
        self._audit = None

    def audit(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation, in a
        written table."""
        if self._audit is not None:
            return self._audit
        # the first turn of what stands at several turns of a conversation
        groups = self.rows.filter("there").groupBy("conv", "role", "digest").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("n"), F.count(F.lit(1)).alias("all"))
        again = cut(groups.filter("least < most OR (n > 0 AND n < all)").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.when(F.col("n") == F.col("all"), F.col("least")).alias("first")), "again")
        last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        seen = F.col("d").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
        fault = F.when(last == "", "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
        known = again.count()
        joined = self.rows.join(F.broadcast(again) if known <= BROADCAST_ROWS else again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
        narrow = joined.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "there")
        # a row that is not there tells its conversation's name alone
        ordered = narrow.repartition("conv").sortWithinPartitions("conv", F.desc("there"), F.asc_nulls_first("turn"), "role", "digest")
        ordered = ordered.withColumn("turn", F.col("turn").cast("string"))
        self._audit = cut(ordered.mapInPandas(audits(shared_dir(self.spark, "trails"), self.spill), _AUDIT_TYPES), "audits")
        return self._audit

    def _stream(self) -> DataFrame:
        none = F.lit(None).cast("string")
        edits = self.audit().select("conv", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("digest"))
        rows = self.rows.filter("there").select("conv", none.alias("audit"), "turn", "role", "text", "digest")
        both = edits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest")
        return both.select("conv", "audit", "role", "text")

    def _named(self, found: DataFrame) -> DataFrame:
        return found.select(F.col("conv").cast(self.conv_type).alias(self.conv_col), *[c for c in found.columns if c != "conv"])

    def repaired(self) -> DataFrame:
        """The repaired conversations: (conversation, place, role, text)."""
        return self._named(self._stream().mapInPandas(repaired_rows, "conv string, place long, role string, text string"))

    def digest(self) -> DataFrame:
        """Counts, cost and audit of each conversation, and the SHA-256 of its repaired rows."""
        found = self._stream().mapInPandas(digests, "conv string, sha string")
        both = self.audit().join(found.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
        return self._named(both.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of conv_id:turn modulo 20: 0 marks a row as gone (column
    present), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 makes its role user. Nulls are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy"))


def _oracle() -> str:
    def to(x: str, edits: str, cost: str, body: str, when: str = "NOT must") -> str:
        return f"CASE WHEN p.{x} IS NOT NULL AND {when} THEN {{'cost': p.{x}.cost + {cost}, 'audit': p.{x}.audit || {edits}, 'body': p.{x}.body || {body}}} END"

    def take(x: str, initial: str, role: str, before: str = "") -> str:
        edits = f"(CASE WHEN initial = '{initial}' THEN '{'I' * bool(before)}K' ELSE '{'I' * bool(before)}R' END)"
        put = f"chr(10) || '{before}:' || " if before else ""
        return to(x, edits, f"pen + (initial <> '{initial}')::INT + {5 * bool(before)}", f"{put}chr(10) || (CASE WHEN initial = '{initial}' THEN role ELSE '{role}' END) || ':' || text")

    def gone(x: str) -> str:
        return to(x, "'D'", "2", "''", "true")

    e = gone("e")
    s = f"list_min([{gone('s')}, {to('e', chr(39) + 'K' + chr(39), 'pen', 'chr(10) || role || ' + chr(39) + ':' + chr(39) + ' || text', 'NOT must AND initial = ' + chr(39) + 's' + chr(39))}])"
    u = f"list_min([{gone('u')}, {', '.join(take(x, 'u', 'user') for x in 'esa')}, {take('u', 'u', 'user', 'assistant')}])"
    a = f"list_min([{gone('a')}, {take('u', 'a', 'assistant')}, {', '.join(take(x, 'a', 'assistant', 'user') for x in 'esa')}])"
    state = "STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR)"
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT src.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, crc),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT hit.*, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM hit) WHERE kind <> 0),
num AS (SELECT *, row_number() OVER w AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, substr(role, 1, 1) AS initial
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
copied AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS copy FROM num),
judged AS MATERIALIZED (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM copied),
facts AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS pen FROM judged),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {{'cost': 0::BIGINT, 'audit': '', 'body': ''}}::{state} AS e, NULL::{state} AS s, NULL::{state} AS u, NULL::{state} AS a
  FROM (SELECT DISTINCT conv_id FROM src)
  UNION ALL
  SELECT p.conv_id, f.n, {e}, {s}, {u}, {a} FROM walk p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1),
ends AS (SELECT conv_id, list_min([e, a, CASE WHEN s IS NOT NULL THEN {{'cost': s.cost + 10, 'audit': s.audit || 'II', 'body': s.body || chr(10) || 'user:' || chr(10) || 'assistant:'}} END,
    CASE WHEN u IS NOT NULL THEN {{'cost': u.cost + 5, 'audit': u.audit || 'I', 'body': u.body || chr(10) || 'assistant:'}} END]) AS best
  FROM walk QUALIFY n = max(n) OVER (PARTITION BY conv_id)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank,
    count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(substr(best.body, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL = _oracle()


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return Repair(rows, present=F.col("present")).digest()
