"""Structure repair of conversations as lightest derivations of a weighted deduction system.

A repaired conversation is an optional system turn and user and assistant turns in turn, or
nothing: the initials of its roles are ``(s?(ua)+)?``. Rows are edited to get there:

======  =========================================================  ====
edit    effect                                                     cost
======  =========================================================  ====
``K``   keep the row                                               0
``R``   keep it as user or assistant                               2
``D``   delete it; the only edit of blank and duplicate rows       3
``I``   insert a user or assistant turn without text, anywhere     2
======  =========================================================  ====

A truncated row that is not deleted costs 1 more. Of the cheapest ways the one whose edits,
written one after the other, come first in ASCII order is taken (the audit).

Items and deductions. An item ``(i, state)`` says that the first ``i`` rows are edited and the
turns so far led the grammar to ``state``; each edit deduces one item from another and is a
function on weights ``(cost, audit)``: it adds its cost and appends its letter. `lightest` is
Knuth's generalisation of Dijkstra's algorithm: items wait in an agenda, the smallest weight
is popped, and an item is final when it is popped first. That is right if the functions are
superior and monotone. Superior: an edit gives a larger weight, as the cost does not fall and
a word comes before its continuations. Monotone: of two weights of one item the smaller one
stays smaller. With unequal costs that is plain. With equal costs neither audit starts with
the other, as what the longer one has more would be insertions alone, which cost something;
so they differ at a letter, and go on differing there.

Long conversations run through in stretches of ``STRETCH`` rows. The final items of a stretch
(one for each state) are the axioms of the next one. One that costs over ``BEHIND`` more than
another is given up: whatever may follow it can follow the other, with at most one turn
inserted to come to its state and one system row deleted that it could have kept. Edits on
which the rest agree are settled: their rows are given out and forgotten, so a task holds no
more of a conversation than the rows on which the derivations still differ, however long it
is. Rows arrive sorted from Spark's spilling sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqwatch.llm import kernels

STRETCH = 256
BLANKS = "\t\n\x0b\x0c\r "

#: What the grammar allows: state -> {initial: next state}; states in which a conversation may end.
START, SYSTEM, ASKED, ANSWERED = range(4)
TURNS = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
ENDS = (START, ANSWERED)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
BEHIND = COST[INSERT] + COST[DELETE]

Weight = tuple[int, str]

#: Rows as one letter each: the initial, in upper case if truncated; others by these two.
OTHER, FORCED = "o", "-"
FAULTS = ("blank", "duplicate", "truncated")


def edits(row: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state."""
    yield DELETE, COST[DELETE], state
    if row == FORCED:
        return
    extra = TRUNCATED if row.isupper() else 0
    initial = row.lower()
    for turn, then in TURNS[state].items():
        if turn == initial:
            yield KEEP, COST[KEEP] + extra, then
        if turn in ROLES:
            yield REROLE, COST[REROLE] + extra, then


def insertion(state: int) -> tuple[str, int]:
    """The turn that may be inserted in a state, and the next state."""
    return next((turn, then) for turn, then in TURNS[state].items() if turn in ROLES)


def lightest(rows: str, axioms: dict[int, Weight], last: bool) -> dict[int, Weight]:
    """The lightest weights of the states after ``rows``, but for those too far behind.

    ``axioms`` are the weights before them. If these are the last rows, the search ends with the
    first state in which a conversation may end, and that alone is returned.
    """
    agenda: list[tuple[int, str, int, int]] = []
    for state, (cost, audit) in axioms.items():
        heappush(agenda, (cost, audit, 0, state))
    final, ends = set(), {}
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if ends and cost > min(ends.values())[0] + BEHIND:
            break
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if last and state in ENDS:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        else:
            for edit, more, then in edits(rows[i], state):
                if (i + 1, then) not in final:
                    heappush(agenda, (cost + more, audit + edit, i + 1, then))
        _, then = insertion(state)
        if (i, then) not in final:
            heappush(agenda, (cost + COST[INSERT], audit + INSERT, i, then))
    return ends


@lru_cache(maxsize=1 << 16)
def whole(rows: str) -> Weight:
    """The lightest repair of a conversation of one stretch; many have the same letters."""
    return next(iter(lightest(rows, {START: (0, "")}, True).values()))


def letter(role: str, fault: int) -> str:
    """A row for the deductions; ``fault`` is a place in ``FAULTS`` counted from 1, or 0."""
    if fault in (1, 2):
        return FORCED
    initial = role[:1] if role[:1] in ("s", "u", "a") else OTHER
    return initial.upper() if fault == 3 else initial


class Repair:
    """One conversation, fed row by row; ``give`` receives every settled edit with its turn."""

    def __init__(self, give: Callable[[str, int | None, str, str], None]) -> None:
        self.give = give
        self.state = START  # of the grammar, after the settled edits
        self.settled = 0
        self.open: dict[int, Weight] = {START: (0, "")}
        self.rows: list[tuple[int | None, str, str]] = []  # not settled yet
        self.letters: list[str] = []  # not searched yet
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows.append((turn, role, text))
        self.letters.append(letter(role, fault))
        if len(self.letters) == STRETCH + 1:
            self.open = lightest("".join(self.letters[:-1]), self.open, False)
            self.letters = self.letters[-1:]
            self.settle(commonprefix([audit for _, audit in self.open.values()]))

    def settle(self, edits_: str) -> None:
        taken = 0
        for edit in edits_:
            turn, role, text = (None, "", "") if edit == INSERT else self.rows[taken]
            taken += edit != INSERT
            if edit in (INSERT, REROLE):
                role = ROLES[insertion(self.state)[0]]
            if edit != DELETE:
                self.state = TURNS[self.state][role[:1]]
            self.give(edit, turn, role, text)
        del self.rows[:taken]
        self.audit.append(edits_)
        self.open = {s: (cost, audit[len(edits_) :]) for s, (cost, audit) in self.open.items()}

    def end(self) -> Weight:
        """Settle the rest: the cost and the whole audit."""
        rest = "".join(self.letters)
        if self.open == {START: (0, "")} and not self.audit:
            cost, audit = whole(rest)
        else:
            cost, audit = next(iter(lightest(rest, self.open, True).values()))
        self.settle(audit)
        return cost, "".join(self.audit)


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault_``: the place in ``FAULTS``, counted from 1, of a row's first fault, or 0.

    A duplicate has a role and text that the conversation has earlier; equal rows of one turn
    count one after the other. Rows of a conversation come to one partition, sorted; neither
    this nor what follows holds them together in memory.
    """
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    again = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    fault = (
        F.when(~F.col("present_"), 0)
        .when(text == "", 1)
        .when(F.row_number().over(again) > 1, 2)
        .when(~F.right(text, F.lit(1)).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    dealt = rows.repartition("conv_id")
    return dealt.withColumn("fault_", fault).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


SUMMARY = [
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
]
TURN_ROWS = [
    ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
]
ROWS_AT_ONCE = 4096
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """Counts and repair of one conversation, from its sorted rows."""

    def __init__(self, conv_id: int | None, turns: list[tuple]) -> None:
        self.conv_id, self.turns = conv_id, turns
        self.low = self.high = None
        self.distinct = self.illegal = self.place = 0
        self.faults = [0] * 4
        self.before = None
        self.hash, self.first = hashlib.sha256(), True
        self.repair = Repair(self.take)

    def take(self, edit: str, turn: int | None, role: str, text: str) -> None:
        if edit != DELETE:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
        self.turns.append((self.conv_id, self.place, edit, turn, role, text))
        self.place += 1

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self.repair.add(turn, role, text, fault)

    def summary(self) -> tuple:
        cost, audit = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit, self.hash.hexdigest()


def _run(rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    batch_of = kernels.record_batches(TURN_ROWS if rows else SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, out = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "present_", "turn", "role", "text", "fault_"))
            for conv_id, present, turn, role, text, fault in zip(*columns):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.summary())
                    now = _Conversation(conv_id, turns)
                if present:
                    now.add(turn, role, text, fault)
                if not rows:
                    turns.clear()
                found = turns if rows else out
                if len(found) >= ROWS_AT_ONCE:
                    yield batch_of(*zip(*found))
                    found.clear()
                    out.clear()
        if now is not None:
            out.append(now.summary())
        found = turns if rows else out
        if found:
            yield batch_of(*zip(*found))

    return run


def _prepared(conversations: DataFrame, present: Column | None) -> DataFrame:
    text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text, here.alias("present_"))
    return faults(rows)


def audits(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation of ``conv_id, turn, role, text``: faults, and the cheapest repair.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows
    are taken by turn, nulls first, then by role and text. A row has one fault, the first of
    blank, duplicate, truncated. ``gaps`` are turns missing between the first and the last;
    ``illegal`` are neighbours whose roles cannot follow each other. The hash is that of the
    repaired ``role:text``, joined by newlines. Null role and text are one space, rows with a
    null conv_id one conversation; other columns are ignored. Conversations without rows for
    which ``present`` holds have zeros, an empty audit and the hash of nothing.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _prepared(conversations, present).mapInArrow(_run(False), schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """Every edit as a row: ``conv_id, place, edit, turn, role, text``; the repaired turns are
    those whose edit is not ``D``, by place. Rows, nulls and ties are taken as in `audits`."""
    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    return _prepared(conversations, None).mapInArrow(_run(True), schema)
