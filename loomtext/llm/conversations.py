"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

The order of roles is right if it is empty, or user and assistant in turn to the end, after at most one system turn.
A turn is kept (0), given another role (1) or deleted (2, required of blank and repeated ones); an empty user or assistant
turn may be inserted anywhere (5), and an undeleted turn that breaks off adds 5.

A dynamic programme runs over the turns that stay. Its states are the initial of the last one: none, s, u, a. What the
turns before turn j cost if turn i is the last that stays is cost(i) plus the deletions between, a difference of prefix
sums; so for each state the running minimum of cost minus prefix sum is enough, and the pair of states tells what must
be inserted. Of equally cheap edits the audit, a letter for each edit (D, I, K, R), that comes first in ASCII wins: two
audits of the same turns differ before either ends, so the states' order by audit is carried along as ranks.

Edits are found from narrow rows; then the texts go through one sorted shuffle beside them. A conversation is read as a
stream: for each of its rows a task holds some bytes (a digest, four steps back and a letter), never the texts.

Defined cases: a null role or text is one space; rows of a conversation are in the order of turn (null first), role and
MD5 of text, so repeated rows are duplicates; null conv_ids are one conversation. A role other than s, u or a by its
initial can't be kept. A conversation without rows has no edits and the digest of no text. An empty table gives an
empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, BROKEN = 2, 5, 1, 5
#: By state (nothing yet, after s, after u, after a): turns to insert before a user or an assistant turn, and at the end.
_NONE, _S, _U, _A = range(4)
_BEFORE_USER, _BEFORE_ASSISTANT, _AT_END = (0, 0, 1, 0), (1, 1, 0, 1), (0, 2, 1, 0)
_ROLE = {_U: "user", _A: "assistant"}
_FAR = 1 << 60
_ALLOWED = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EDITS = "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def audit_of(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of turns (initial, must go, breaks off)."""
    least = [0, _FAR, _FAR, _FAR]  # running minima of cost minus prefix sum of deletions, by state
    rank = [0, 1, 2, 3]
    prefix = 0
    back: list[tuple[tuple[int, str], ...]] = []
    for initial, must_go, broken in turns:
        options: list[list[tuple[int, int, str, int]]] = [[(least[s], rank[s], "D", s)] for s in range(4)]
        if not must_go:
            base = prefix + (BROKEN if broken else 0)  # prefix sum before this turn
            after = prefix + DELETE
            if initial == "s":
                options[_S].append((least[_NONE] + base - after, rank[_NONE], "K", _NONE))
            for to, before, own in ((_U, _BEFORE_USER, "u"), (_A, _BEFORE_ASSISTANT, "a")):
                letter, price = ("K", 0) if initial == own else ("R", REROLE)
                for s in range(4):
                    options[to].append((least[s] + base - after + INSERT * before[s] + price, rank[s], "I" * before[s] + letter, s))
        prefix += DELETE
        best = [min(found) for found in options]
        order = sorted(range(4), key=lambda s: best[s][1:3])
        rank = [order.index(s) for s in range(4)]
        least = [b[0] for b in best]
        back.append(tuple((b[3], b[2]) for b in best))
    ends = []
    for s in range(4):
        if least[s] < _FAR // 2:
            ends.append((least[s] + prefix + INSERT * _AT_END[s], s))
    cheapest = min(cost for cost, _ in ends)
    audits = []
    for cost, s in ends:
        if cost == cheapest:
            letters, at = ["I" * _AT_END[s]], s
            for steps in reversed(back):
                at, letter = steps[at]
                letters.append(letter)
            audits.append("".join(reversed(letters)))
    return cheapest, min(audits)


def _initial(role: str) -> str:
    return role[:1]


def narrow(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, role_digest, digest, blank, broken, gone) of rows (conv_id, turn, role, text, gone)."""
    visible = r"[^\x20\x09-\x0D]"
    text = F.coalesce("text", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    role = F.coalesce("role", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        (~text.rlike(visible)).alias("blank"), (~last.isin(".", "!", "?")).alias("broken"), F.col("gone").alias("gone"),
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(whether a new conversation begins, row) for rows that come sorted by conv_id."""
    held: tuple = ()
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["conv_id"],) != held, row
            held = (row["conv_id"],)


class _Reading:
    """What is kept of a conversation while its rows pass by."""

    def __init__(self, conv_id: str | None):
        self.conv_id, self.turns, self.seen, self.before = conv_id, [], set(), None
        self.n = dict.fromkeys(COUNTS, 0)
        self.first = self.last = None
        self.distinct = 0

    def add(self, row: dict) -> None:
        if row["turn"] is not None and row["turn"] != self.last:
            self.first = row["turn"] if self.first is None else self.first
            self.last = row["turn"]
            self.distinct += 1
        key, initial = hashlib.md5(f"{row['digest']}{row['role']}".encode()).digest(), _initial(row["role"])
        fault = "blank" if row["blank"] else "duplicate" if key in self.seen else "truncated" if row["broken"] else None
        self.seen.add(key)
        if fault:
            self.n[fault] += 1
        if self.before is not None and self.before + initial not in _ALLOWED:
            self.n["illegal"] += 1
        self.before = initial
        self.turns.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def row(self) -> dict:
        if self.first is not None:
            self.n["gaps"] = self.last - self.first + 1 - self.distinct
        self.n["cost"], audit = audit_of(self.turns)
        return {"conv_id": self.conv_id, **self.n, "audit": audit}


_EDIT_TYPE = pa.schema([("conv_id", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])


def edits(rows: DataFrame) -> DataFrame:
    """EDITS for each conversation of rows (conv_id, turn, role, text, gone); those marked gone count as absent."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading, done = None, []
        for new, row in _conversations(batches):
            if new:
                if reading is not None:
                    done.append(reading.row())
                reading = _Reading(row["conv_id"])
            if not row["gone"]:
                reading.add(row)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, _EDIT_TYPE)
                done = []
        if reading is not None:
            yield pa.RecordBatch.from_pylist([*done, reading.row()], _EDIT_TYPE)

    by_conversation = narrow(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return by_conversation.mapInArrow(find, EDITS)


TURNS = "conv_id string, place long, edit string, role string, text string"
_TURN_TYPE = pa.schema([("conv_id", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Writing:
    """The repaired turns of a conversation, one after the other, as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, _NONE, 0

    def _turn(self, edit: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.state = {"s": _S, "u": _U, "a": _A}[role[0]]
        self.place += 1
        return self.place - 1, edit, role, text

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn("I", _ROLE[_A if self.state == _U else _U], "")

    def after(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        """What a row becomes, with the turns inserted before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._turn("K", role, text)
        elif edit == "R":
            yield self._turn("R", _ROLE[_A if self.state == _U else _U], text)


def _beside(rows: DataFrame, found: DataFrame, *carried: str) -> DataFrame:
    """Each conversation's edits followed by its rows, in the order in which edits were found."""
    none = [F.lit(None).cast("long").alias(c) for c in carried]
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    first = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), *carried)
    then = rows.where(~F.col("gone")).select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"), *none)
    return first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("digest", "turn")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """TURNS: the turns of every repaired conversation, by place, with the edit (K, R, I) that made each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held, writing = None, None
        turn = lambda t: dict(zip(("place", "edit", "role", "text"), t), conv_id=held)
        for new, row in _conversations(batches):
            if new:
                out.extend(map(turn, writing.inserted() if writing else ()))
                held, writing = row["conv_id"], _Writing(row["text"])
            else:
                out.extend(map(turn, writing.after(row["role"], row["text"])))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _TURN_TYPE)
                out = []
        out.extend(map(turn, writing.inserted() if writing else ()))
        yield pa.RecordBatch.from_pylist(out, _TURN_TYPE)

    return _beside(rows, found).mapInArrow(write, TURNS)


def summaries(rows: DataFrame, found: DataFrame) -> DataFrame:
    """EDITS and repaired_sha256, the digest of the repaired turns as `role:text` lines, hashed as they pass by."""
    schema = _EDIT_TYPE.append(pa.field("repaired_sha256", pa.string()))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        head, writing, sha = None, None, hashlib.sha256()

        def put(turns) -> None:
            for place, _, role, text in turns:
                sha.update(("\n" if place else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))

        def finish() -> None:
            put(writing.inserted())
            out.append({"conv_id": head["conv_id"], **{c: head[c] for c in COUNTS}, "audit": head["text"], "repaired_sha256": sha.hexdigest()})

        for new, row in _conversations(batches):
            if new:
                if writing:
                    finish()
                head, writing, sha = row, _Writing(row["text"]), hashlib.sha256()
            else:
                put(writing.after(row["role"], row["text"]))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if writing:
            finish()
        yield pa.RecordBatch.from_pylist(out, schema)

    return _beside(rows, found, *COUNTS).mapInArrow(digest, EDITS + ", repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults put in by a hash of `conv_id:turn`: in twenty, one each is dropped
    (marked gone), emptied, stripped of [.!?], repeated at its place, and given the role user. Nulls hash as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    changed = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return changed.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), again.alias("copy")).drop("copy")
