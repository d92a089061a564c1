"""Conversations repaired by an error-correcting Earley parse of their roles.

The grammar gives an optional system turn and then pairs of a user's and an assistant's turn, or nothing. Error productions
let a row be deleted or given another role, or a turn be inserted where none is; each has a cost, and an item of the chart
keeps the least (cost, audit), the audit being the initials of its edits in order. All productions are left-recursive, so every
item starts at the conversation's first row: items of earlier sets are never asked for again and a row costs the same
however long the conversation is. With each item travels the SHA-256 of the turns that it has repaired so far.

Rows of one conversation pass sorted through one task as a stream, because its SHA-256 is sequential; no row is held. What
repeats is told by the first place of each (conversation, role, text), aggregated before rows are sorted.

Cases. A null role or text is one space; a null turn comes first; null conv_ids are one conversation. Rows of one turn go by role,
the first 64 characters of the text, and the text's SHA-256; equal rows are interchangeable. A role without characters, or
of another initial than s, u and a, can't be kept. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize

WHITE = " \t\n\x0b\x0c\r"
#: Head of a production: its bodies. Terminals: s, u and a are turns of that initial, d is a deleted row.
GRAMMAR = {
    "repaired": [["none"], ["turns"]],
    "none": [[], ["none", "d"]],
    "lead": [["none", "s"], ["lead", "d"]],
    "ask": [["none", "u"], ["lead", "u"], ["turns", "u"], ["ask", "d"]],
    "turns": [["ask", "a"], ["turns", "d"]],
}
NAMES = {"u": b"user", "a": b"assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
_BLOCK = 1 << 10
_OUT = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_OUT_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_TURNS_DDL = "conv_id bigint, place bigint, turn bigint, role string, text string, edit string"
_ORDER = ["conv_id", "turn", "role", "head", "digest", "mark"]


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space."""
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows harmed by a checksum of their ids: dropped, emptied, without stops, repeated, or given to the user."""
    rows = plain(conversations)
    ids = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("kind", F.crc32(ids.cast("binary")) % 20).filter("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _marked(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows with their faults, a mark before the first row of each (conversation, role, text), and one for each conversation."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(2).alias("mark"), "text", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    first: Column = F.when(F.max(F.col("turn").isNull()), F.lit(None).cast("bigint")).otherwise(F.min("turn"))
    seen = rows.groupBy("conv_id", "role", "head", "digest").agg(first.alias("turn"))
    none = [F.lit(None).cast("string").alias("text"), F.lit(False).alias("blank"), F.lit(False).alias("cut")]
    seen = seen.select("conv_id", "turn", "role", "head", "digest", F.lit(1).alias("mark"), *none)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    every = every.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("mark"), *none)
    return every.unionByName(seen).unionByName(rows)


def _waiting() -> dict[str, list[tuple[str, str | None]]]:
    """For each completed head the items that it moves on: what they are to complete, and the terminal that they then expect."""
    out: dict[str, list[tuple[str, str | None]]] = {}
    for head, bodies in GRAMMAR.items():
        for body in bodies:
            if body:
                out.setdefault(body[0], []).append((head, body[1] if len(body) > 1 else None))
    return out


WAITING = _waiting()


class Chart:
    """The last set of an Earley chart. An entry is (cost, rank, letters, head, state): rank orders the audits as they were when
    the last row was read, letters are what came since. Audits of one rank can't be each other's beginnings, as all end
    with the same row's letter, so (rank, letters) orders audits."""

    def __init__(self) -> None:
        self.ready = self._complete([(0, 0, "", "none", ((None, ""), hashlib.sha256(), False, ()))])

    @staticmethod
    def _complete(found: list) -> dict:
        """Completes heads in order of (cost, audit), with the insert productions that need no row."""
        ready: dict[str, tuple] = {}
        heapq.heapify(found)
        while found:
            entry = heapq.heappop(found)
            cost, rank, letters, head, state = entry
            if head in ready:
                continue
            ready[head] = entry
            for to, terminal in WAITING.get(head, ()):
                if terminal is None and to not in ready:
                    heapq.heappush(found, (cost, rank, letters, to, state))
                elif terminal in NAMES and to not in ready:
                    heapq.heappush(found, (cost + INSERT, rank, letters + "I", to, (*state[:3], (*state[3], NAMES[terminal] + b":"))))
        return ready

    def read(self, role: str, text: str, dead: bool, cut: bool) -> None:
        """Moves all items over one row; dead rows can only be deleted."""
        initial, best = role[:1], {}
        for head, (cost, rank, letters, _, state) in self.ready.items():
            for to, terminal in WAITING.get(head, ()):
                if terminal == "d":
                    edit = (DELETE, "D", None)
                elif dead or terminal is None:
                    continue
                elif terminal == initial:
                    edit = (CUT * cut, "K", role.encode())
                elif terminal in NAMES:
                    edit = (REROLE + CUT * cut, "R", NAMES[terminal])
                else:
                    continue
                key = (cost + edit[0], rank, letters + edit[1])
                if to not in best or key < best[to][0]:
                    best[to] = (key, state, edit[2])
        order = {k: n for n, k in enumerate(sorted({x[0][1:] for x in best.values()}))}
        data, found = None, []
        for to, (key, ((node, tail), digest, begun, pending), name) in best.items():
            tail += key[2]
            audit = ((node, tail), "") if len(tail) > _BLOCK else (node, tail)
            pieces = list(pending)
            if name is not None:
                data = text.encode() if data is None else data
                pieces.append(name + b":" + data)
            if pieces:
                digest = digest.copy()
                for p in pieces:
                    if begun:
                        digest.update(b"\n")
                    digest.update(p)
                    begun = True
            found.append((key[0], order[key[1:]], "", to, (audit, digest, begun, ())))
        self.ready = self._complete(found)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and the SHA-256 of the repaired turns, of the completed chart."""
        cost, _, letters, _, (audit, digest, begun, pending) = self.ready["repaired"]
        parts, (node, tail) = [letters], audit
        parts.append(tail)
        while node is not None:
            node, tail = node
            parts.append(tail)
        digest = digest.copy()
        for p in pending:
            digest.update((b"\n" if begun else b"") + p)
            begun = True
        return cost, "".join(reversed(parts)), digest.hexdigest()


class _Conversation:
    """Faults and chart of one conversation, row by row."""

    def __init__(self) -> None:
        self.chart, self.last, self.new, self.before = Chart(), None, False, None
        self.blank = self.duplicate = self.cut = self.illegal = self.turns = 0
        self.low = self.high = None

    def first(self) -> None:
        self.new = True

    def row(self, turn: int | None, role: str, text: str, blank: bool, cut: bool) -> None:
        again, self.new = not self.new, False
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.blank, self.duplicate, self.cut = self.blank + blank, self.duplicate + (again and not blank), self.cut + (cut and not again and not blank)
        self.chart.read(role, text, blank or again, cut)

    def result(self) -> tuple:
        return (0 if self.low is None else self.high - self.low + 1 - self.turns, self.blank, self.duplicate, self.cut, self.illegal, *self.chart.result())


def audit(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """For each conv_id of conversations (default: of rows): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in batches:
            out = {f.name: [] for f in _OUT}

            def close(out: dict = out) -> None:
                if own is not None:
                    for name, value in zip(out, (at, *own.result()), strict=True):
                        out[name].append(value)

            for conv, turn, role, text, mark, blank, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if mark == 0:
                    close()
                    at, own = conv, _Conversation()
                elif mark == 1:
                    own.first()
                else:
                    own.row(turn, role, text, blank, cut)
            yield batch(out, _OUT)
        if own is not None:
            yield batch({n: [v] for n, v in zip(_OUT.names, (at, *own.result()), strict=True)}, _OUT)

    marked = _marked(plain(rows), rows if conversations is None else conversations)
    dealt = marked.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return dealt.select("conv_id", "turn", "role", "text", "mark", "blank", "cut").mapInArrow(parse, _OUT_DDL)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), turn (null where inserted), role, text, edit (K, R or I)."""
    rows = plain(rows)
    plans = materialize(audit(rows).select("conv_id", "audit"), "op13-audits")
    head, digest = F.substring("text", 1, 64), F.unhex(F.sha2("text", 256))
    some = rows.select("conv_id", "turn", "role", head.alias("head"), digest.alias("digest"), F.lit(2).alias("mark"), "text")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("head", "string"), ("digest", "binary"))]
    both = plans.select("conv_id", *none, F.lit(0).alias("mark"), F.col("audit").alias("text")).unionByName(some)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, edits, k, place, last = None, "", 0, 0, ""
        for b in batches:
            out = {f.name: [] for f in _TURNS}

            def emit(turn: int | None, role: str, text: str, edit: str, out: dict = out) -> None:
                nonlocal place, last
                for name, value in zip(out, (at, place, turn, role, text, edit), strict=True):
                    out[name].append(value)
                place, last = place + 1, role[:1]

            def due() -> str:
                return "assistant" if last == "u" else "user"

            def inserts() -> None:
                nonlocal k
                while edits[k : k + 1] == "I":
                    emit(None, due(), "", "I")
                    k += 1

            for conv, turn, role, text, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if mark == 0:
                    at, edits, k, place, last = conv, text, 0, 0, ""
                    inserts()
                    continue
                edit, k = edits[k], k + 1
                if edit != "D":
                    emit(turn, role if edit == "K" else due(), text, edit)
                inserts()
            yield batch(out, _TURNS)

    dealt = both.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return dealt.select("conv_id", "turn", "role", "text", "mark").mapInArrow(apply, _TURNS_DDL)


def report(conversations: DataFrame) -> DataFrame:
    """The audit of the damaged conversations, for every conv_id of the whole ones."""
    return audit(damage(conversations), conversations)
