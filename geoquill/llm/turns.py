"""Repair of the order of roles in conversations, at least cost.

Rows are dealt to partitions by a hash of their conversation and sorted there by turn. Each partition is read as a
stream, in batches of a bounded number of rows; within a batch conversations are cut into segments of a bounded number
of turns. A recursive query in DuckDB advances all segments of a batch by one turn in each recursion and keeps, by
state of the grammar, the least cost and the least audit. The grammar `(s?(ua)+)?` has four states: nothing yet, after
s, after u, after a; the next role is known from the state, so an audit tells the repaired conversation. Of two audits
of one cost that end in the same state after the same rows neither begins the other (the insertions that would follow
cost more), so the least one stays least, whatever comes. Segments of a conversation are joined in order, from state to
state. Only a conversation that goes beyond a batch has anything carried on: for each state its cost, audit and the
state of the digest of its repaired text, and 16 bytes for each different row (to tell duplicates).

Edge cases: null roles and texts count as one space, and so do null keys and turns in the key of the damage. Rows of a
null key are one conversation. Equal turns are taken by role, then text; copies of a row are duplicates. Roles are told
by their first character alone; other than s, u, a (the empty role too) they can be deleted or changed, not kept. An
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after each role that may follow a state.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every row after damage: conv, turn, role, text, `live` (false for rows that are dropped: they only tell that
    the conversation is there), what is wrong with it alone, and a digest of role and text."""
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(key), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select(quoted(key).alias("conv"), quoted("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    out = out.withColumns({
        "text": F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "live": F.col("kind") != 0, "times": F.when(F.col("kind") == 3, 2).otherwise(1),
    })
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "kind")
    seen = F.rtrim("text", F.lit(SPACES))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return out.withColumns({"blank": seen == "", "open": ~F.substring(seen, -1, 1).isin(".", "!", "?"), "initial": F.substring("role", 1, 1), "same": same})


@cache
def moves() -> pa.Table:
    """What a row can become: from a state by insertions and one edit to another, by the row's initial."""
    out = []
    for origin in range(4):
        state, inserted = origin, ""
        while True:
            cost = INSERT * len(inserted)
            for initial in "sua-":
                out.append((origin, initial, state, cost + DELETE, inserted + "D", True))
                for role, to in NEXT[state].items():
                    if role == initial:
                        out.append((origin, initial, to, cost + KEEP, inserted + "K", False))
                    elif role in ROLES:
                        out.append((origin, initial, to, cost + REROLE, inserted + "R", False))
            if len(inserted) == 2:  # a third one comes back to an earlier state
                break
            role = next(r for r in NEXT[state] if r in ROLES)
            state, inserted = NEXT[state][role], inserted + "I"
    names = ("state", "initial", "next", "price", "piece", "deleted")
    return pa.table({n: pa.array(c) for n, c in zip(names, zip(*out, strict=True), strict=True)})


#: One batch: rows of segments with their faults, then turn by turn the best path by segment, origin and state.
FAULTS = """
CREATE OR REPLACE TEMP TABLE faults AS
SELECT seg, i, turn, initial, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND open AS truncated,
  NOT coalesce(before || initial IN ('su', 'ua', 'au'), true) AS illegal
FROM (SELECT *, row_number() OVER (PARTITION BY conv, same ORDER BY place) > 1 OR carried AS again, lag(initial) OVER (PARTITION BY conv ORDER BY place) AS before FROM batch)
"""
PATHS = """
WITH RECURSIVE step AS (
  SELECT seg, CAST(0 AS BIGINT) AS i, origin, origin AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM origins
  UNION ALL
  SELECT seg, i, origin, state, best.cost AS cost, best.audit AS audit FROM (
    SELECT s.seg, s.i + 1 AS i, s.origin, m.next AS state,
      min({'cost': s.cost + m.price + CASE WHEN f.truncated AND NOT m.deleted THEN $truncated ELSE 0 END, 'audit': s.audit || m.piece}) AS best
    FROM step s JOIN faults f ON f.seg = s.seg AND f.i = s.i + 1
      JOIN moves m ON m.state = s.state AND m.initial = CASE WHEN f.initial IN ('s', 'u', 'a') THEN f.initial ELSE '-' END AND (m.deleted OR NOT (f.blank OR f.duplicate))
    GROUP BY s.seg, s.i, s.origin, m.next)
)
SELECT seg, origin, state, cost, audit FROM step SEMI JOIN (SELECT seg, max(i) AS i FROM faults GROUP BY seg) USING (seg, i)
"""
COUNTS = """
SELECT seg, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal,
  count(DISTINCT turn) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(initial, i) AS first_initial, arg_max(initial, i) AS last_initial
FROM faults GROUP BY seg
"""


def written(digest, count: int, state: int, rows: list[tuple[str, str]], audit: str) -> int:
    """Puts the repaired rows into the digest; count tells how many it has, and the new count is returned."""
    row = 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        fits = next(r for r in NEXT[state] if r in ROLES)
        if edit == "I":
            line = ROLES[fits] + ":"
        else:
            role, text = rows[row]
            row += 1
            if edit == "K":
                fits = role[:1]
            line = (role if edit == "K" else ROLES[fits]) + ":" + text
        state = NEXT[state][fits]
        digest.update((("\n" if count else "") + line).encode("utf-8", "surrogatepass"))
        count += 1
    return count


class Open:
    """A conversation that is being read: what its segments so far have come to, by state. The last segment is kept
    back, since of a conversation that ends with it only one path is ever written out."""

    def __init__(self):
        self.paths = {START: (0, "", hashlib.sha256(), 0)}
        self.last: tuple[list[tuple[str, str]], list[tuple[int, int, int, str]]] | None = None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = None
        self.initial: str | None = None

    def _best(self) -> dict[int, tuple[int, str, int, str]]:
        """By state: cost, audit, and of the last segment its origin and its own part of the audit."""
        out: dict[int, tuple[int, str, int, str]] = {}
        for origin, state, cost, audit in self.last[1] if self.last else [(s, s, 0, "") for s in self.paths]:
            if origin in self.paths:
                before = self.paths[origin]
                made = (before[0] + cost, before[1] + audit, origin, audit)
                if state not in out or made[:2] < out[state][:2]:
                    out[state] = made
        return out

    def add(self, rows: list[tuple[str, str]], paths: list[tuple[int, int, int, str]], counts: dict) -> None:
        if self.last:
            after = {}
            for state, (cost, audit, origin, part) in self._best().items():
                digest = self.paths[origin][2].copy()
                after[state] = (cost, audit, digest, written(digest, self.paths[origin][3], origin, self.last[0], part))
            self.paths = after
        self.last = rows, paths
        for k in self.counts:
            self.counts[k] += counts[k]
        if counts["first_turn"] is not None:
            self.counts["turns"] -= self.high is not None and self.high == counts["first_turn"]  # turns are in order
            self.low = counts["first_turn"] if self.low is None else self.low
            self.high = counts["last_turn"]
        self.initial = counts["last_initial"]

    def result(self) -> tuple:
        ends = []
        for state, (cost, audit, origin, part) in self._best().items():
            more = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
            ends.append((cost + INSERT * more, audit + "I" * more, origin, part + "I" * more))
        cost, audit, origin, part = min(ends)
        digest = self.paths[origin][2].copy()
        written(digest, self.paths[origin][3], origin, self.last[0] if self.last else [], part)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return gaps, *(self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit, digest.hexdigest()


def repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType, rows: int, turns: int) -> Iterator[pa.RecordBatch]:
    """The conversations of a partition, sorted by conversation and turn."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    db.register("moves", moves())
    names = ["conv_id", *(c.split()[0] for c in RESULT.split(", "))]
    types = [kind, *(pa.int64() if c.endswith(" long") else pa.string() for c in RESULT.split(", "))]
    state: Open | None = None
    conv, at, seen = None, 0, set()
    for batch in batches:
        for start in range(0, len(batch), rows):
            part = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.slice(start, rows).columns, strict=True)}
            done, begun, segments, known, last = [], [], {}, seen, None
            table = {n: [] for n in ("conv", "seg", "i", "place", "turn", "initial", "blank", "open", "same", "carried")}
            number = 0
            for k, own in enumerate(part["conv"]):
                if state is None or (own != conv and (own == own or conv == conv)):  # not a number is one key
                    if state is not None:
                        begun.append((conv, state))
                    state, conv, at, number, seen, last = Open(), own, 0, number + 1, set(), None
                if not part["live"][k]:
                    continue
                if last is None or len(segments[last][2]) == turns:
                    last = len(segments)
                    segments[last] = (state, at == 0, [])
                segments[last][2].append((part["role"][k], part["text"][k]))
                same = bytes.fromhex(part["same"][k])
                values = (number, last, len(segments[last][2]), k, part["turn"][k], part["initial"][k], part["blank"][k], part["open"][k], part["same"][k], number == 0 and same in known)
                for n, v in zip(table, values, strict=True):
                    table[n].append(v)
                seen.add(same)
                at += 1
            if segments:
                types_in = {"turn": pa.int64(), "initial": pa.string(), "same": pa.string(), "blank": pa.bool_(), "open": pa.bool_(), "carried": pa.bool_()}
                db.register("batch", pa.table({n: pa.array(v, types_in.get(n, pa.int64())) for n, v in table.items()}))
                origins = [(s, o) for s, (_, first, _) in segments.items() for o in ((START,) if first else range(4))]
                db.register("origins", pa.table({"seg": pa.array([s for s, _ in origins], pa.int64()), "origin": pa.array([o for _, o in origins], pa.int64())}))
                db.execute(FAULTS)
                paths: dict[int, list] = {}
                for seg, *path in db.execute(PATHS, {"truncated": TRUNCATED}).fetchall():
                    paths.setdefault(seg, []).append(tuple(path))
                found = db.execute(COUNTS)
                heads = [c[0] for c in found.description]
                counts = {r[0]: dict(zip(heads, r, strict=True)) for r in found.fetchall()}
                first = True
                for s, (own, _, lines) in segments.items():
                    if first and own.initial is not None:  # the batch's own rows don't know what came before them
                        counts[s]["illegal"] += own.initial + counts[s]["first_initial"] not in ("su", "ua", "au")
                    first = False
                    own.add(lines, paths[s], counts[s])
            done += [(c, *o.result()) for c, o in begun]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, *state.result()), types, strict=True)], names=names)


def repair(conversations: DataFrame, key: str = "conv_id", rows: int = 10_000, turns: int = 128) -> DataFrame:
    """A row for each conversation: its key (as conv_id), what is wrong with it after damage, and its cheapest repair.
    A batch has `rows` rows at most, a segment `turns`."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema[key].dataType
    arrow = to_arrow_type(kind)
    order: list[str | Column] = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    sorted_ = damaged(conversations, key).repartition("conv").sortWithinPartitions(*order)
    columns = ("conv", "turn", "role", "text", "live", "blank", "open", "initial", "same")
    return sorted_.select(*columns).mapInArrow(lambda batches: repaired(batches, arrow, rows, turns), f"conv_id {kind.simpleString()}, {RESULT}")
