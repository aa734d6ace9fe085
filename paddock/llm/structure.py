"""Repair of conversation structure: cheapest edits by a dynamic program with persistent audits.

The program reads a conversation turn by turn and keeps, for each state of the grammar
`(s?(ua)+)?` of role initials, the least cost and the audit (the string of edits) that reaches it. Audits are nodes
that share their prefixes. A node has its ancestors at powers of two and a rolling hash, so two audits of
equal cost are compared by a search for their longest common prefix; equal hashes are verified by walking
to the shared node. An audit that is a prefix of another over the same turns costs less, so the order of two
audits never changes by what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
START, SYSTEM, USER, ASSISTANT = range(4)
# the state after a role initial
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EDITED = [(s, t) for (s, initial), t in MOVES.items() if initial in "ua"]
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
REBASE = 512  # turns after which what all audits share is taken out of the nodes
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
FINDINGS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Audits:
    """Strings as nodes of a tree; node 0 is the empty one."""

    def __init__(self) -> None:
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... letters above
        self.letter, self.depth, self.hash = [""], [0], [0]

    def add(self, node: int, letter: str) -> int:
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(up)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        return len(self.up) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rise, k = self.depth[node] - depth, 0
        while rise:
            if rise & 1:
                node = self.up[node][k]
            rise, k = rise >> 1, k + 1
        return node

    def text(self, node: int, above: int = 0) -> str:
        letters = []
        while node != above:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of equal depth are the same string, letter by letter down to the node they share."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x comes before that of y."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hash[a] == self.hash[b]:
            return self.depth[x] < self.depth[y] if self.same(a, b) else self.text(x) < self.text(y)
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if self.same(self.up[a][0], self.up[b][0]):
            return self.letter[a] < self.letter[b]
        return self.text(x) < self.text(y)


class Repair:
    """The program for one conversation: `read` its turns in order, then `close`."""

    def __init__(self) -> None:
        self.audits, self.done, self.turns = Audits(), [], 0
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self._insert(self.best)

    def _offer(self, best: dict[int, tuple[int, int]], state: int, cost: int, node: int, letter: str) -> bool:
        if state in best and best[state][0] < cost:
            return False
        new = self.audits.add(node, letter)
        if state in best and best[state][0] == cost and not self.audits.less(new, best[state][1]):
            return False
        best[state] = (cost, new)
        return True

    def _insert(self, best: dict[int, tuple[int, int]]) -> None:
        changed = True
        while changed:
            changed = False
            for s, t in EDITED:
                if s in best:
                    changed |= self._offer(best, t, best[s][0] + COST[INSERT], best[s][1], INSERT)

    def read(self, initial: str, delete: bool, truncated: bool) -> None:
        best: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + COST[DELETE], node, DELETE)
            if not delete and (state, initial) in MOVES:
                self._offer(best, MOVES[state, initial], cost + COST[KEEP] + extra, node, KEEP)
        if not delete:
            for s, t in EDITED:
                if s in self.best:
                    self._offer(best, t, self.best[s][0] + COST[REROLE] + extra, self.best[s][1], REROLE)
        self._insert(best)
        if ASSISTANT in best:  # what follows from these states follows from this one for no more, or one deletion more
            for state, more in ((START, COST[DELETE]), (SYSTEM, 0)):
                if state in best and best[state][0] > best[ASSISTANT][0] + more:
                    del best[state]
        self.best = best
        self.turns += 1
        if self.turns % REBASE == 0:
            self._rebase()

    def _rebase(self) -> None:
        old, nodes = self.audits, [n for _, n in self.best.values()]
        depth = min(old.depth[n] for n in nodes)
        nodes = {old.ancestor(n, depth) for n in nodes}
        while len(nodes) > 1:
            nodes = {old.up[n][0] for n in nodes}
        shared = nodes.pop()
        self.done.append(old.text(shared))
        self.audits, moved = Audits(), {shared: 0}
        for state, (cost, node) in self.best.items():
            path = []
            while node not in moved:
                path.append(node)
                node = old.up[node][0]
            for n in reversed(path):
                moved[n] = self.audits.add(moved[node], old.letter[n])
                node = n
            self.best[state] = (cost, moved[node])

    def close(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair, of equal ones the first in ASCII order."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or c == cost and self.audits.less(n, node):
                cost, node = c, n
        return cost, "".join(self.done) + self.audits.text(node)


class _Findings:
    """Faults and repair of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair, self.seen, self.last = conv_id, Repair(), set(), None
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def read(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high, self.turns, self.turn = turn, self.turns + (turn != self.turn), turn
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        shown = text.strip(SPACE)
        blank, duplicate = not shown, bool(shown) and key in self.seen
        truncated = not blank and not duplicate and shown[-1] not in ".!?"
        self.seen.add(key)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        self.repair.read(role[:1], blank or duplicate, truncated)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.close())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FINDINGS.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
    state = None
    for batch in batches:
        out = []
        for conv_id, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if state is None or state.conv_id != conv_id:
                if state is not None:
                    out.append(state.row())
                state = _Findings(conv_id)
            state.read(turn, role, text)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, state.row()))], schema=schema)


def _plain(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))


def find_repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its faults, and cost and audit of the cheapest repair.

    Turns are read by number, nulls first, then role and text. Null roles and texts are one space; turns
    without a conv_id are one conversation. A conversation is read as a stream by one task, which keeps 16 bytes a turn and the
    audit's nodes since the last common one, no texts. An empty table gives no rows; other columns are not looked at.
    """
    ordered = _plain(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_find, FINDINGS)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation after its audit: the repaired rows in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    audit, at, position, first = "", 0, 0, 0

    def role() -> str:
        return ("assistant", "user")[(position + first) % 2]

    def insertions(conv_id: int | None) -> Iterator[tuple]:
        nonlocal at, position
        while at < len(audit) and audit[at] == INSERT:
            yield (conv_id, position, role(), "")
            at, position = at + 1, position + 1

    for batch in batches:
        out: list[tuple] = []
        for conv_id, found, own_role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if found is not None:
                audit, at, position = found, 0, 0
                first = (len(audit) - audit.count(DELETE) + 1) % 2  # a system turn comes before the pairs of an odd number
            else:
                edit, at = audit[at], at + 1
                if edit != DELETE:
                    out.append((conv_id, position, own_role if edit == KEEP else role(), text))
                    position += 1
            out += insertions(conv_id)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)


def apply_repairs(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired turns; those of a conversation lie together in order.

    `repairs` is the result of `find_repairs` for the same turns.
    """
    rows = _plain(turns).withColumn("audit", F.lit(None).cast("string"))
    heads = repairs.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.unionByName(heads).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text").select("conv_id", "audit", "role", "text")
    return ordered.mapInArrow(_edits, "conv_id bigint, position bigint, role string, text string")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    current, digest = None, None
    for batch in batches:
        out = []
        for conv_id, position, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if position == 0:
                if digest is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (current, digest.hexdigest())))], schema=schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the result of `apply_repairs`, which it follows directly."""
    return repaired.mapInArrow(_hash, "conv_id bigint, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Turns with every fault that a repair meets, by crc32 of `conv_id:turn` modulo 20: 0 drops a turn, 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls become one space."""
    plain = _plain(turns)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("kind")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = plain.select("*", kind).where("kind <> 0")
    hit = hit.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return hit.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("copy", "kind")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """One row per conversation of the undamaged turns: what `damage` did to it and its repair."""
    damaged = damage(turns)
    found = find_repairs(damaged)
    hashes = digests(apply_repairs(damaged, found))
    known = turns.select(F.col("conv_id").cast("bigint").alias("known")).distinct()
    both = found.join(hashes.withColumnRenamed("conv_id", "hashed"), F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return known.join(both, F.col("known").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("known").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
