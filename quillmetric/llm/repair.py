"""Repair of conversation structure: the cheapest edits that give an optional system turn and then user and assistant in turn.

The cheapest audit (the string of edits) is found by dynamic programming over the turns with a cell per state of the grammar. Audits are
persistent: cells point at nodes of a tree of edits, share their prefixes, and a node knows its ancestors 1, 2, 4, ... edits back and a
rolling hash of its whole string. Equal costs are decided by the longest common prefix, searched by jumps over ancestors with equal hashes; the
prefix that this finds is verified edit by edit, so a collision of hashes changes nothing.

A conversation streams through one task in order of its turns. Edits that all cells share are settled, written and forgotten, so a task holds
the turns and edits that are still open and one letter per edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.llm.work import Workspace

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
BLANKS = " \t\n\v\f\r"
ENDS = ".!?"
# states: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
SETTLE_NODES = 4096
OUT = ("conv_id long, position long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, "
       "cost long, audit string, repaired_sha256 string")
_NAMES = [f.split()[0] for f in OUT.split(", ")]
_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in OUT.split(", ")])


class Prefixes:
    """A tree of edit strings; node 0 is the empty one."""

    def __init__(self, base: int = 257, modulus: int = (1 << 61) - 1) -> None:
        self.base, self.modulus = base, modulus
        self.edit, self.depth, self.hash, self.back = [""], [0], [0], [[]]
        self._known: dict[tuple[int, str], int] = {}

    def __len__(self) -> int:
        return len(self.edit)

    def add(self, node: int, edit: str) -> int:
        known = self._known.get((node, edit))
        if known is not None:
            return known
        back = [node]
        while len(self.back[back[-1]]) >= len(back):
            back.append(self.back[back[-1]][len(back) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(edit)) % self.modulus)
        self.back.append(back)
        self._known[node, edit] = len(self.edit) - 1
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            gap = self.depth[node] - depth
            node = self.back[node][min(gap.bit_length(), len(self.back[node])) - 1]
        return node

    def _difference(self, x: int, y: int) -> tuple[str, str] | None:
        """The first edits in which two nodes of the same depth differ."""
        a, b = x, y
        if self.hash[a] != self.hash[b]:
            for k in range(len(self.back[a]) - 1, -1, -1):
                if k < len(self.back[a]) and self.hash[self.back[a][k]] != self.hash[self.back[b][k]]:
                    a, b = self.back[a][k], self.back[b][k]
            found = (self.edit[a], self.edit[b])
            a, b = self.back[a][0], self.back[b][0]
        else:
            found = None
        while a != b:  # equal hashes: verify
            if self.edit[a] != self.edit[b]:
                found = (self.edit[a], self.edit[b])
            a, b = self.back[a][0], self.back[b][0]
        return found

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x sorts before that of y."""
        depth = min(self.depth[x], self.depth[y])
        found = self._difference(self.ancestor(x, depth), self.ancestor(y, depth))
        return self.depth[x] < self.depth[y] if found is None else found[0] < found[1]

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that is an ancestor of all, or one of them."""
        depth = min(self.depth[n] for n in nodes)
        nodes = list({self.ancestor(n, depth) for n in nodes})
        while len(nodes) > 1:
            nodes = list({self.back[n][0] for n in nodes})
        return nodes[0]

    def string(self, node: int, above: int = 0) -> str:
        """The edits of a node after those of its ancestor ``above``."""
        edits = []
        while node != above:
            edits.append(self.edit[node])
            node = self.back[node][0]
        return "".join(reversed(edits))


class Repair:
    """The cheapest audits of one conversation whose turns arrive in order."""

    def __init__(self) -> None:
        self.prefixes = Prefixes()
        self.limit = SETTLE_NODES
        self.cells: dict[int, tuple[int, int]] = {}
        self._offer(self.cells, START, 0, 0)
        self._insert(self.cells)

    def _offer(self, cells: dict[int, tuple[int, int]], state: int, cost: int, node: int) -> None:
        held = cells.get(state)
        if held is None or cost < held[0] or (cost == held[0] and node != held[1] and self.prefixes.less(node, held[1])):
            cells[state] = (cost, node)

    def _insert(self, cells: dict[int, tuple[int, int]]) -> None:
        """Turns put in before the next one: a user turn, an assistant turn, or both after a system turn."""
        for before, after in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if before in cells and (after not in cells or cells[before][0] + INSERT_COST <= cells[after][0]):
                cost, node = cells[before]
                self._offer(cells, after, cost + INSERT_COST, self.prefixes.add(node, INSERT))
        # cells that another one, doing the same from here on, undercuts whatever follows; of equal costs both stay
        for loser, winner, more in ((SYSTEM, START, 0), (SYSTEM, ASSISTANT, 0), (ASSISTANT, START, 0), (USER, START, INSERT_COST),
                                    (START, ASSISTANT, DELETE_COST)):
            if loser in cells and winner in cells and cells[loser][0] > cells[winner][0] + more:
                del cells[loser]

    def turn(self, initial: str, truncated: bool, unwanted: bool) -> None:
        after: dict[int, tuple[int, int]] = {}
        more = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.cells.items():
            options = [(state, cost + DELETE_COST, DELETE)]
            if not unwanted:
                if (state, initial) in KEPT:
                    options.append((KEPT[state, initial], cost + more, KEEP))
                options.append((ASSISTANT if state == USER else USER, cost + REROLE_COST + more, REROLE))
            for to, price, edit in options:
                if to not in after or price <= after[to][0]:
                    self._offer(after, to, price, self.prefixes.add(node, edit))
        self._insert(after)
        self.cells = after

    def settled(self) -> str:
        """Edits that all cells share, once enough have gathered; they are forgotten here."""
        if len(self.prefixes) < self.limit:
            return ""
        live = [node for _, node in self.cells.values()]
        shared = self.prefixes.shared(live)
        done = self.prefixes.string(shared)
        rest = {state: (cost, self.prefixes.string(node, shared)) for state, (cost, node) in self.cells.items()}
        self.prefixes = Prefixes(self.prefixes.base, self.prefixes.modulus)
        for state, (cost, edits) in rest.items():
            node = 0
            for edit in edits:
                node = self.prefixes.add(node, edit)
            self.cells[state] = (cost, node)
        self.limit = max(SETTLE_NODES, 2 * len(self.prefixes))
        return done

    def finish(self) -> tuple[int, str]:
        """The least cost, and the edits that are not settled yet."""
        ends: dict[int, tuple[int, int]] = {}
        for state in (START, ASSISTANT):
            if state in self.cells:
                self._offer(ends, START, *self.cells[state])
        cost, node = ends[START]
        return cost, self.prefixes.string(node)


class _Conversation:
    """One conversation on its way: counts of faults, open turns, what has been repaired."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.previous = 0, None
        self.least = self.last = None
        self.n_turns = 0
        self.open: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.seen_before: set[tuple[str, bytes]] = set()
        self.seen_turn: int | None = None
        self.written, self.after_user, self.sha = 0, False, hashlib.sha256()

    def repeated(self, turn: int, role: str, digest: bytes) -> None:
        """The role and text stand in an earlier turn as well."""
        if turn != self.seen_turn:
            self.seen_before, self.seen_turn = set(), turn
        self.seen_before.add((role, digest))

    def add(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None and turn != self.last:
            self.n_turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        now = (turn, role, text)
        body = text.rstrip(BLANKS)
        fault = None
        if not body:
            fault = "blank"
        elif now == self.previous or (self.seen_before and turn == self.seen_turn
                                      and (role, hashlib.sha256(text.encode()).digest()) in self.seen_before):
            fault = "duplicate"
        elif body[-1] not in ENDS:
            fault = "truncated"
        if fault:
            self.faults[fault] += 1
        if self.previous is not None:
            self.illegal += self.previous[1][:1] + role[:1] not in ("su", "ua", "au")
        self.previous = now
        self.open.append((role, text))
        self.repair.turn(role[:1], fault == "truncated", fault in ("blank", "duplicate"))
        yield from self._apply(self.repair.settled())

    def _apply(self, edits: str) -> Iterator[tuple]:
        if not edits:
            return
        self.audit.append(edits)
        at = 0
        for edit in edits:
            role, text = ("", "") if edit == INSERT else self.open[at]
            at += edit != INSERT
            if edit == DELETE:
                continue
            if edit != KEEP:
                role = "assistant" if self.after_user else "user"
            self.after_user = role[:1] == "u"
            self.sha.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            yield (self.conv_id, self.written, role, text, *[None] * 8)
            self.written += 1
        del self.open[:at]

    def end(self) -> Iterator[tuple]:
        cost, edits = self.repair.finish()
        yield from self._apply(edits)
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.n_turns
        yield (self.conv_id, None, None, None, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


def _repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    current, done = None, []
    for batch in batches:
        for conv_id, turn, kind, role, text, digest in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.extend(current.end())
                current = _Conversation(conv_id)
            if kind == "repeat":
                current.repeated(turn, role, digest)
            elif kind == "row":
                done.extend(current.add(turn, role, text))
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
    if current is not None:
        done.extend(current.end())
    if done:
        yield batch_of(done)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one blank).

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats the row, 4 makes it the user's.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                known("role").alias("role"), known("text").alias("text"), fate.alias("fate"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("fate") == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def repaired(rows: DataFrame, work: Workspace) -> DataFrame:
    """The repaired turns and the audits of ``rows(conv_id, turn, role, text, dropped)``, written.

    Turns have a ``position`` (from 0), role and text; every conversation has one more row with a null position: its faults, the cost and
    audit of its repair, and the digest of the turns. Conversations all of whose rows are dropped keep that row. Rows without a conv_id form
    a conversation. Turns are ordered by number, nulls first, then role and text; extra columns are ignored; no rows give no rows.
    Whether a text stands in an earlier turn is found by slim rows, dealt by conversation, role and digest; texts are shuffled once.
    """
    present = rows.filter("NOT dropped")
    slim = present.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"))
    number = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = (slim.groupBy("conv_id", "role", "digest").agg(F.min(number).alias("first"), F.max(number).alias("final"))
               .filter("final > first").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"))
    repeats = slim.distinct().join(
        several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    ).filter(number > F.col("first"))
    columns = ["conv_id", "turn", "kind", "role", "text", "digest"]
    no_text, no_digest = F.lit(None).cast("string"), F.lit(None).cast("binary")
    stream = (rows.withColumn("kind", F.when(F.col("dropped"), "dropped").otherwise("row")).withColumn("digest", no_digest)
              .withColumn("text", F.when(~F.col("dropped"), F.col("text"))).select(*columns)
              .unionByName(repeats.withColumn("kind", F.lit("repeat")).withColumn("text", no_text).select(*columns)))
    # "repeat" sorts before "row"
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "kind", "role", "text")
    return work.table(ordered.mapInArrow(_repair_stream, OUT), "repaired")


def audits(repaired_rows: DataFrame) -> DataFrame:
    return repaired_rows.filter("position IS NULL").select("conv_id", *_NAMES[4:])
