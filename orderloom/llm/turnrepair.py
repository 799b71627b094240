"""Repair of conversation structure by generalised LR parsing with weighted edits.

A conversation's roles must follow a grammar: an optional system turn, then pairs of a user and an
assistant turn. An LR automaton is built from the grammar. Its stacks form a graph: stacks that
differ in their tops only share the nodes below. Every row may be kept, reroled or deleted, and rows
may be inserted anywhere; each edit forks the stacks. Equal stack tops merge by the smallest
(cost, audit), so a conversation keeps as many stacks as the grammar has different ones, whatever
its length. Each of them carries the digest of the text that it has repaired so far, so texts pass
through once and are not held.

Spark deals conversations to tasks once, and numbers the copies of equal turns and puts rows in
order there, spilling to disk where a conversation is large; rows then stream through the parser.
A digest of a whole conversation is sequential by its nature, so one conversation is one stream of
bounded memory, apart from its audit, one letter a row.

Defined cases. Null role or text: one space, so the text is blank. Null turn: first. Null conv_id: a
conversation of its own. Equal turns: in order of role and text. Empty table: empty result. Texts of
any length: whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import BLANKS, batches, map_batches

GRAMMAR = (("chat", ()), ("chat", ("turns",)), ("turns", ("turns", "pair")), ("turns", ("pair",)),
           ("turns", ("s", "pair")), ("pair", ("u", "a")))
NAMES = {"u": "user", "a": "assistant"}          # roles that edits may give
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5   # costs
BLANK, REPEATED, CUT = 1, 2, 3                   # faults of a row
SLACK = 2 * INSERT + DELETE                      # what another stack can cost more and still become the best
SETTLED = 256                                    # letters of an audit after which its agreed start is put away


class Automaton:
    """LR(0) states of a grammar with one-symbol look-ahead for reductions, and its stacks as a graph."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...] = GRAMMAR):
        self.rules = (("", (rules[0][0],)), *rules)
        self.inner = {left for left, _ in self.rules}
        self.follow = self._follow()
        first = self._closure({(0, 0)})
        self.states, self.moves, waiting = {first: 0}, [], [first]
        while waiting:
            items = waiting.pop(0)
            row = {}
            for symbol in sorted({self.rules[r][1][k] for r, k in items if k < len(self.rules[r][1])}):
                to = self._closure({(r, k + 1) for r, k in items if self.rules[r][1][k : k + 1] == (symbol,)})
                if to not in self.states:
                    self.states[to] = len(self.states)
                    waiting.append(to)
                row[symbol] = self.states[to]
            self.moves.append(row)
        self.ends = [[r for r, k in items if k == len(self.rules[r][1])] for items in self.states]
        self.nodes: dict[tuple[int, int], int] = {}      # (state, node below) -> node
        self.stack: list[tuple[int, int]] = []
        self.start = self._node(0, -1)
        self.shifted: dict[tuple[int, str], tuple[int, ...]] = {}
        self.accepted: dict[int, bool] = {}

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items, size = set(items), 0
        while len(items) > size:
            size = len(items)
            wanted = {self.rules[r][1][k] for r, k in items if k < len(self.rules[r][1])}
            items |= {(r, 0) for r, (left, _) in enumerate(self.rules) if left in wanted}
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        empty: set[str] = set()
        first = {left: set() for left in self.inner}
        follow = {left: {"$"} if left == "" else set() for left in self.inner}
        before = None
        while before != (before := (len(empty), *map(len, first.values()), *map(len, follow.values()))):
            for left, right in self.rules:
                for symbol in right:
                    first[left] |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                else:
                    empty.add(left)
                for k, symbol in enumerate(right):
                    if symbol in self.inner:
                        for after in right[k + 1 :]:
                            follow[symbol] |= first.get(after, {after})
                            if after not in empty:
                                break
                        else:
                            follow[symbol] |= follow[left]
        return follow

    def _node(self, state: int, below: int) -> int:
        found = self.nodes.get((state, below))
        if found is None:
            found = self.nodes[state, below] = len(self.stack)
            self.stack.append((state, below))
        return found

    def _reduced(self, tops: Iterable[int], ahead: str | None) -> list[int]:
        """``tops`` and all that reductions make of them; without look-ahead, only where nothing else can follow."""
        seen, waiting = {}, list(tops)
        while waiting:
            top = waiting.pop()
            if top in seen:
                continue
            state = self.stack[top][0]
            certain = not self.moves[state] and len(self.ends[state]) == 1
            seen[top] = not (ahead is None and certain and self.ends[state][0])
            for r in self.ends[state]:
                left, right = self.rules[r]
                if r and (certain if ahead is None else ahead in self.follow[left]):
                    node = top
                    for _ in right:
                        node = self.stack[node][1]
                    waiting.append(self._node(self.moves[self.stack[node][0]][left], node))
        return [t for t, kept in seen.items() if kept]

    def shift(self, top: int, symbol: str) -> tuple[int, ...]:
        """The tops after ``symbol`` on ``top``, reduced as far as is certain."""
        found = self.shifted.get((top, symbol))
        if found is None:
            moved = [self._node(self.moves[s][symbol], t) for t in self._reduced([top], symbol)
                     if symbol in self.moves[s := self.stack[t][0]]]
            found = self.shifted[top, symbol] = tuple(sorted(self._reduced(moved, None)))
        return found

    def complete(self, top: int) -> bool:
        found = self.accepted.get(top)
        if found is None:
            found = self.accepted[top] = any(0 in self.ends[self.stack[t][0]] for t in self._reduced([top], "$"))
        return found


class Repair:
    """The cheapest repair of one conversation, row by row."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.settled: list[str] = []
        # Stack top -> (cost, audit, digest so far, whether a row stands in it).
        self.tops = {automaton.start: (0, "", hashlib.sha256(), False)}

    @staticmethod
    def _with(digest, begun: bool, line: bytes):
        longer = digest.copy()
        longer.update(b"\n" + line if begun else line)
        return longer

    def _insert(self) -> None:
        """Inserted rows in front of the next one, as long as they make a stack cheaper."""
        changed = list(self.tops)
        while changed:
            offers = {}
            for top in changed:
                cost, audit, digest, begun = self.tops[top]
                for symbol, name in NAMES.items():
                    for to in self.automaton.shift(top, symbol):
                        offer = (cost + INSERT, audit + "I")
                        if to not in offers or offer < offers[to][:2]:
                            offers[to] = (*offer, digest, begun, f"{name}:".encode())
            changed = []
            for to, (cost, audit, digest, begun, line) in offers.items():
                if to not in self.tops or (cost, audit) < self.tops[to][:2]:
                    self.tops[to] = (cost, audit, self._with(digest, begun, line), True)
                    changed.append(to)

    def row(self, role: str, text: str, fault: int) -> None:
        self._insert()
        extra = TRUNCATED if fault == CUT else 0
        found: dict[int, tuple] = {}

        def offer(to: int, cost: int, audit: str, digest, begun: bool, name: str | None) -> None:
            held = found.get(to)
            if held is None or (cost, audit) < held[:2]:
                found[to] = (cost, audit, digest, begun, name)

        for top, (cost, audit, digest, begun) in self.tops.items():
            offer(top, cost + DELETE, audit + "D", digest, begun, None)
            if fault in (BLANK, REPEATED):
                continue
            for to in self.automaton.shift(top, role[:1]) if role else ():
                offer(to, cost + extra, audit + "K", digest, begun, role)
            for symbol, name in NAMES.items():
                for to in self.automaton.shift(top, symbol):
                    offer(to, cost + REROLE + extra, audit + "R", digest, begun, name)
        most = min(v[0] for v in found.values()) + SLACK
        self.tops = {
            to: (cost, audit, digest, begun) if name is None else
            (cost, audit, self._with(digest, begun, f"{name}:{text}".encode()), True)
            for to, (cost, audit, digest, begun, name) in found.items() if cost <= most}
        if min(len(v[1]) for v in self.tops.values()) > SETTLED:
            agreed = len(os.path.commonprefix([v[1] for v in self.tops.values()]))
            if agreed:
                self.settled.append(next(iter(self.tops.values()))[1][:agreed])
                self.tops = {t: (v[0], v[1][agreed:], *v[2:]) for t, v in self.tops.items()}

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired rows)."""
        self._insert()
        cost, audit, digest, _ = min((v for t, v in self.tops.items() if self.automaton.complete(t)), key=lambda v: v[:2])
        return cost, "".join(self.settled) + audit, digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: a fixed share of rows dropped (``gone``), emptied, cut, repeated or reroled."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20)).cast("int")
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    ).drop("_copy")


def fault_of(text: Column, earlier: Column) -> Column:
    """The first fault of a row: blank, repeated, cut off before the end of a sentence; 0: none."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\v\f\r")), -1, 1)
    return (F.when(~text.rlike(f"[^{BLANKS}]"), BLANK).when(earlier, REPEATED)
            .when(~last.isin(".", "!", "?"), CUT).otherwise(0))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of each conversation in one partition, in order, with their faults.

    One shuffle: the numbering of equal turns sorts within the same partitions.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first()))
    placed = rows.withColumn("gone", gone).repartition("conv_id").withColumn("copy", copy)
    return placed.select(
        "conv_id", "turn", "role", "text", "gone", "copy", fault_of(F.col("text"), F.col("copy") > 1).alias("fault")
    ).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")


RESULT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
COLUMNS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
LEGAL = {"su", "ua", "au"}


class Conversation:
    """Counts and repair of the rows of one conversation, in order."""

    def __init__(self, conv_id: int | None, automaton: Automaton):
        self.conv_id, self.repair = conv_id, Repair(automaton)
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.first = self.latest = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        if turn is not None and turn != self.latest:
            self.first = turn if self.first is None else self.first
            self.latest = turn
            self.turns += 1
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = self.latest - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, *self.repair.result())


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation: its gaps, faults, illegal neighbours, and the cheapest repair.

    ``rows``: conv_id, turn, role, text, and ``gone`` for rows that only name their conversation.
    """
    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def results() -> Iterable[tuple]:
            current = None
            for batch in source:
                for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                    if current is None or current.conv_id != conv_id:
                        if current is not None:
                            yield current.result()
                        current = Conversation(conv_id, automaton)
                    if not gone:
                        current.row(turn, role, text, fault)
            if current is not None:
                yield current.result()

        yield from batches(results(), RESULT)

    return map_batches(in_order(rows).select("conv_id", "turn", "role", "text", "gone", "fault"), step, COLUMNS, 2048)


def op13(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations))
