"""Cheapest repair of the role structure of conversations, with an audit of its edits.

A conversation shall read as `(s?(ua)+)?` in the first letters of its roles. A row may be kept, given another role
or deleted, and empty turns may be inserted anywhere; the audit is the string of the edits' first letters. A dynamic
program over four states (nothing yet, after s, after u, after a) keeps the cheapest audit of each state, of equally
cheap ones the least. Audits are nodes that share their beginnings: a node has the node before it, ancestors at
distances 1, 2, 4, ... and a rolling hash of its whole string, so two audits are compared by searching for their
longest common beginning. Equal hashes are trusted only after the letters were compared.

Rows are dealt by ranges of (conversation, turn), so a long conversation lies in several tasks. A task that may begin
inside a conversation runs the program from every state; the pieces of a conversation are put together by adding the
costs and joining the audits.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.tables import ready, stored

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: state -> role letter -> next state
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: what an inserted or renamed turn can be in a state
FILLED = ("u", "u", "a", "u")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: faults of a row, of which the first counts
SOUND, BLANK, DUPLICATE, CUT = range(4)

_MASK = (1 << 61) - 1
_BASE = 0x1F3A5C7D9B2E4681 % _MASK


class Audits:
    """Strings that grow at their end and share their beginnings. Node 0 is the empty string."""

    def __init__(self):
        self.letter, self.depth, self.hash = array("B", [0]), array("q", [0]), array("q", [0])
        #: ancestors at distances 1, 2, 4, ...; those of a node begin at its place in `first`
        self.up, self.first = array("q"), array("q", [0])

    def longer(self, node: int, letter: str) -> int:
        code, up = ord(letter), self.up
        self.letter.append(code)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + code) % _MASK)
        self.first.append(len(up))
        above, level = node, 0
        while True:
            up.append(above)
            if self.depth[above] < 1 << level:
                break
            above, level = up[self.first[above] + level], level + 1
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The beginning of this length."""
        while self.depth[node] > depth:
            level = (self.depth[node] - depth).bit_length() - 1
            node = self.up[self.first[node] + level]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal: by their hashes, and then letter by letter."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[self.first[a]], self.up[self.first[b]]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a comes before that of b."""
        if a == b:
            return False
        shorter = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, shorter), self.ancestor(b, shorter)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        # both climb to the shortest beginnings that differ
        level = shorter.bit_length()
        while level >= 0:
            if self.depth[x] >= 1 << level:
                p, q = (self.up[self.first[n] + level] for n in (x, y))
                if not self.same(p, q):
                    x, y = p, q
            level -= 1
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        letters = bytearray()
        while node:
            letters.append(self.letter[node])
            node = self.up[self.first[node]]
        return letters[::-1].decode()


class Repair:
    """The dynamic program from one state over a run of rows."""

    def __init__(self, start: int = START):
        self.audits = Audits()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[start] = (0, 0)

    def _offer(self, best: list, state: int, cost: int, node: int, letter: str) -> None:
        now = best[state]
        if now is None or cost <= now[0]:
            made = self.audits.longer(node, letter)
            if now is None or cost < now[0] or self.audits.less(made, now[1]):
                best[state] = (cost, made)

    def _insert(self) -> None:
        """Empty turns before the next row; two are enough, as three end in the state of one."""
        for _ in range(2):
            after = list(self.best)
            for state, found in enumerate(self.best):
                if found:
                    self._offer(after, NEXT[state][FILLED[state]], found[0] + INSERT, found[1], "I")
            if after == self.best:
                break
            self.best = after

    def row(self, initial: str, fault: int) -> None:
        self._insert()
        after: list[tuple[int, int] | None] = [None] * 4
        for state, found in enumerate(self.best):
            if not found:
                continue
            cost, node = found
            self._offer(after, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED if fault == CUT else 0
            if initial in NEXT[state]:
                self._offer(after, NEXT[state][initial], cost + more, node, "K")
            self._offer(after, NEXT[state][FILLED[state]], cost + REROLE + more, node, "R")
        self.best = after

    def end(self) -> tuple[int, str]:
        """The cheapest accepted (cost, audit)."""
        self._insert()
        return min((cost, self.audits.text(node)) for cost, node in (self.best[s] for s in ACCEPTED if self.best[s]))

    def piece(self, start: int) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, audit) of a run that others may follow."""
        return [(start, to, found[0], self.audits.text(found[1])) for to, found in enumerate(self.best) if found]


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The cheapest accepted (cost, audit) of consecutive pieces."""
    best = {START: (0, "")}
    for piece in pieces:
        after: dict[int, tuple[int, str]] = {}
        for begin, to, cost, audit in piece:
            if begin in best:
                made = (best[begin][0] + cost, best[begin][1] + audit)
                after[to] = min(made, after.get(to, made))
        best = after
    # empty turns at the end, as after the last row of a whole run
    for _ in range(2):
        for state, (cost, audit) in list(best.items()):
            to, made = NEXT[state][FILLED[state]], (cost + INSERT, audit + "I")
            best[to] = min(made, best.get(to, made))
    return min(best[s] for s in ACCEPTED if s in best)


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with nulls of role and text as one space and the planned damage done."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    plain = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    )


def _faults(text: Column, first: Column) -> Column:
    """The first fault of a row; `first` tells that no earlier row has its role and text."""
    ended = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~first, DUPLICATE).when(~ended, CUT).otherwise(SOUND)


#: turns in order, nulls first; equal turns by role and digest of the text, so that copies are neighbours
ORDER = ("conv", "turn", "role", "digest", "row")
LEGAL = ("su", "ua", "au")
#: pieces up to this length are looked up if the same letters and faults came before in the task
SHORT, LOOKED_UP = 24, 1 << 16

_PIECES = "conv string, part int, head string, tail string, illegal long, cost long, audit string, entries array<struct<begin: int, to: int, cost: long, audit: string>>"


def _run(rows: list[tuple[str, int]], start: int) -> Repair:
    program = Repair(start)
    for initial, fault in rows:
        program.row(initial, fault)
    return program


def _pieces(batches):
    """One row a conversation of a sorted range: its audit, or where a neighbouring range may hold more of it, the
    audits from and to every state."""
    part, known = TaskContext.get().partitionId(), {}

    def row(conv, rows, edge: bool, opens: bool) -> dict:
        initials = [initial for initial, _ in rows]
        made = {
            "conv": conv,
            "part": part,
            "head": initials[0],
            "tail": initials[-1],
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "cost": None,
            "audit": None,
            "entries": None,
        }
        if edge:
            found = [e for begin in (range(4) if opens else (START,)) for e in _run(rows, begin).piece(begin)]
            return made | {"entries": [dict(zip(("begin", "to", "cost", "audit"), e)) for e in found]}
        same = tuple(rows) if len(rows) <= SHORT else None
        found = known.get(same) or _run(rows, START).end()
        if same and len(known) < LOOKED_UP:
            known[same] = found
        return made | dict(zip(("cost", "audit"), found))

    current, rows, opens = None, [], True
    for batch in batches:
        made = []
        for conv, initial, fault in zip(batch["conv"], batch["initial"], batch["fault"]):
            if rows and conv != current:
                made.append(row(current, rows, opens, opens))
                rows, opens = [], False
            current = conv
            rows.append((initial, fault))
        if made:
            yield pd.DataFrame(made)
    if rows:
        yield pd.DataFrame([row(current, rows, True, opens)])


def _together(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation in their order."""
    pieces = pieces.sort_values("part")
    cost, audit = joined([[(e["begin"], e["to"], e["cost"], e["audit"]) for e in own] for own in pieces["entries"]])
    between = sum(a + b not in LEGAL for a, b in zip(pieces["tail"], pieces["head"][1:]))
    return pd.DataFrame({"conv": [pieces["conv"].iloc[0]], "illegal": [pieces["illegal"].sum() + between], "cost": [cost], "audit": [audit]})


def _digests(batches):
    """The hash of each repaired conversation; its audit comes before its rows, which are not held."""
    current, hashed, step = None, None, None

    def edits(audit: str, own):
        """Takes rows one by one, in between writing what they and the inserted turns add."""
        state, sep = START, b""

        def write(role: str, text: str):
            nonlocal state, sep
            own.update(sep + f"{role}:{text}".encode())
            state, sep = NEXT[state][role[:1]], b"\n"

        for edit in audit:
            if edit == "I":
                write(ROLES[FILLED[state]], "")
                continue
            role, text = yield
            if edit != "D":
                write(ROLES[FILLED[state]] if edit == "R" else role, text)
        yield

    for batch in batches:
        made = []
        for conv, audit, role, text in zip(batch["conv"], batch["audit"], batch["role"], batch["text"]):
            if audit is not None:
                if hashed is not None:
                    made.append((current, hashed.hexdigest()))
                current, hashed = conv, hashlib.sha256()
                step = edits(audit, hashed)
                next(step)
            else:
                step.send((role, text))
        if made:
            yield pd.DataFrame(made, columns=["conv", "repaired_sha256"])
    if hashed is not None:
        yield pd.DataFrame([(current, hashed.hexdigest())], columns=["conv", "repaired_sha256"])


def audits(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
    """(rows, judged, audits): the damaged rows, their order and faults without texts, and `conv, illegal, cost, audit` of each
    conversation that has rows."""
    named = ready(conversations).select(
        F.col(id_col).cast("string").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    content = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = damaged(named).withColumnRenamed("conv_id", "conv").withColumn("digest", F.unhex(F.sha2(content, 256)))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "turns")

    place = F.struct(F.col("turn").isNotNull(), "turn", "row")
    first = rows.groupBy("conv", "digest").agg(F.min(place).alias("at")).select(F.col("at.row").alias("row"), F.lit(True).alias("is_first"))
    plain = rows.select("conv", "turn", F.col("role"), "digest", "row", _faults(F.col("text"), F.lit(True)).alias("own"))
    judged = plain.join(first, "row", "left").withColumn("fault", F.when(F.col("own") == BLANK, BLANK).when(F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("own")))
    judged = stored(judged.select(*ORDER, F.substring("role", 1, 1).alias("initial"), "fault"), "faults")

    sorted_ = judged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv", "initial", "fault")
    pieces = stored(sorted_.mapInPandas(_pieces, _PIECES), "pieces")
    whole = pieces.where("audit is not null").select("conv", "illegal", "cost", "audit")
    edges = pieces.where("audit is null").groupBy("conv").applyInPandas(_together, "conv string, illegal long, cost long, audit string")
    return rows, judged, stored(whole.unionByName(edges), "audits")


def repairs(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256` of every conversation.

    Rows are damaged as planned by crc32(`conv_id:turn`) % 20, nulls in it, in roles and in texts being one space.
    The damaged rows of a conversation are taken by turn, nulls first; rows of one turn by role and a digest of role
    and text, so that copies are neighbours. The audit is the cheapest one, of equally cheap ones the least in ASCII,
    that makes the initials of the roles `(s?(ua)+)?`.

    Rows are small (no texts) where they are ordered and judged, and are dealt by ranges of conversation and turn; a
    piece of a conversation yields the audits between all pairs of states, and pieces are joined. Only the final
    hash, which runs over all text of a conversation from its start, reads a conversation in one task, as a stream.

    Null ids are one conversation; null turns come first and count for no gap. Empty and very long texts are rows as
    others; equal rows are copies, of which all but one are duplicates. A conversation without any row left has
    zeros, an empty audit and the hash of the empty string. An empty table gives no rows. Other columns are not read.
    """
    rows, judged, found = audits(conversations, id_col, turn_col, role_col, text_col)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    count = lambda fault, name: F.count(F.when(F.col("fault") == fault, 1)).alias(name)
    counts = judged.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(CUT, "truncated"))

    nothing = F.lit(None).cast("string")
    listed = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("row"), nothing.alias("text"), "audit")
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "row", "text", nothing.alias("audit"))
    ordered = listed.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:])
    hashes = ordered.select("conv", "audit", "role", "text").mapInPandas(_digests, "conv string, repaired_sha256 string")

    every = conversations.select(F.col(id_col).cast("string").alias("conv")).distinct()
    for more in (counts, found, hashes):
        more = more.withColumnRenamed("conv", "other")
        every = every.join(more, F.col("conv").eqNullSafe(F.col("other")), "left").drop("other")
    zero = F.lit(0).cast("long")
    return every.select(
        F.col("conv").cast("long").alias("conv_id"),
        *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
