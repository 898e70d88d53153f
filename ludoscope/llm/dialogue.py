"""Repair of conversations by generalised LR parsing with weighted edits.

Roles of a conversation must spell ``(s?(ua)+)?`` by their initials. A table of LR states is
made from the grammar below; a graph-structured stack follows all edits at once. Stacks share
what lies under their tops, and of stacks with equal tops the one of the least (cost, audit)
stays, since what may follow depends on the top alone: under every ``u`` the same may come after
its ``a``. Costs of equal letters are equal, so of two audits of equal cost neither begins the
other, and the least one stays the least whatever follows.

A conversation's rows come to one task in order and aren't kept: the task holds four tops, each
with the running digest of its repaired text and the audit's letters since the tops last
agreed. Since the digest of a whole text can't be put together from parts, a conversation isn't
dealt to several tasks; a long one takes time there, not memory.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The role grammar: what each symbol may stand for; ``$`` ends the input.
GRAMMAR = (("S", "D"), ("D", ""), ("D", "P"), ("D", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))
START = "S"
#: What edits cost. Blank and duplicate rows can't be kept; a truncated one costs more unless deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: A top that costs more than this above the cheapest is let go: from any top two inserts at most
#: lead to one after which the same may come, but for an ``s``, which can be deleted.
BEHIND = 2 * INSERT + DELETE
SPACE = " \t\n\x0b\x0c\r"

Item = tuple[int, int]
Stack = tuple[int, ...]


# -- the LR table ---------------------------------------------------------------------------


def _first_and_follow() -> dict[str, set[str]]:
    """Terminals that may follow each symbol that stands for others."""
    heads = {h for h, _ in GRAMMAR}
    empty, first, follow = set(), {h: set() for h in heads}, {h: set() for h in heads}
    follow[START].add("$")
    before = None
    while before != (before := repr((sorted(empty), [sorted(first[h]) for h in sorted(heads)], [sorted(follow[h]) for h in sorted(heads)]))):
        for head, body in GRAMMAR:
            if all(x in empty for x in body):
                empty.add(head)
            for x in body:
                first[head] |= first.get(x, {x})
                if x not in empty:
                    break
            after = set(follow[head])
            for x in reversed(body):
                if x in heads:
                    follow[x] |= after
                    after = first[x] | (after if x in empty else set())
                else:
                    after = {x}
    return follow


class Table:
    """States as sets of rules read up to a place, what they shift and what they reduce."""

    def __init__(self) -> None:
        follow = _first_and_follow()
        self.go: list[dict[str, int]] = []
        self.reduce: list[dict[str, int]] = []
        states: dict[frozenset[Item], int] = {}
        todo: list[frozenset[Item]] = []

        def number(kernel: set[Item]) -> int:
            items = set(kernel)
            while True:
                ahead = {GRAMMAR[r][1][k] for r, k in items if k < len(GRAMMAR[r][1])}
                more = {(r, 0) for r, (head, _) in enumerate(GRAMMAR) if head in ahead}
                if more <= items:
                    break
                items |= more
            key = frozenset(items)
            if key not in states:
                states[key] = len(states)
                todo.append(key)
                self.go.append({})
                self.reduce.append({})
            return states[key]

        number({(0, 0)})
        while todo:
            items = todo.pop()
            here = states[items]
            for r, k in items:
                if k == len(GRAMMAR[r][1]):
                    self.reduce[here].update({t: r for t in follow[GRAMMAR[r][0]]})
            for x in {GRAMMAR[r][1][k] for r, k in items if k < len(GRAMMAR[r][1])}:
                self.go[here][x] = number({(r, k + 1) for r, k in items if GRAMMAR[r][1][k : k + 1] == x})

    def reduced(self, stack: Stack, ahead: str) -> Stack:
        """The stack when no more rules can be reduced before ``ahead``."""
        while (r := self.reduce[stack[-1]].get(ahead)) is not None and r:
            head, body = GRAMMAR[r]
            stack = stack[: len(stack) - len(body)]
            stack = (*stack, self.go[stack[-1]][head])
        return stack


TABLE = Table()


@lru_cache(maxsize=None)  # stacks are at most four deep
def shifted(stack: Stack, terminal: str) -> Stack | None:
    """The stack after a terminal; None if it can't come there."""
    stack = TABLE.reduced(stack, terminal)
    to = TABLE.go[stack[-1]].get(terminal)
    return None if to is None else (*stack, to)


@lru_cache(maxsize=None)
def accepts(stack: Stack) -> bool:
    """Whether the conversation may end here."""
    return TABLE.reduce[TABLE.reduced(stack, "$")[-1]].get("$") == 0


# -- one conversation -----------------------------------------------------------------------


class Repair:
    """The cheapest edits of one conversation, whose rows come one by one."""

    #: Rows after which letters that all tops agree on are put away.
    EVERY = 64

    def __init__(self) -> None:
        self.tops: dict[int, tuple] = {0: (0, "", (0,), None)}  # by LR state: cost, audit, stack, digest
        self.agreed: list[str] = []
        self.rows = 0
        self._inserts()

    @staticmethod
    def _offer(into: dict[int, tuple], stack: Stack | None, cost: int, audit: str, digest, role: str | None, text: str) -> bool:
        """Keeps a stack if it is the best of its top so far."""
        if stack is None:
            return False
        old = into.get(stack[-1])
        if old is not None and (old[0], old[1]) <= (cost, audit):
            return False
        into[stack[-1]] = (cost, audit, stack, digest, role, text)
        return True

    @staticmethod
    def _settled(tops: dict[int, tuple]) -> dict[int, tuple]:
        """Adds what the chosen edits give out to the digests."""
        out = {}
        for state, top in tops.items():
            if len(top) == 6:
                cost, audit, stack, digest, role, text = top
                if role is not None:
                    digest, lead = (hashlib.sha256(), "") if digest is None else (digest.copy(), "\n")
                    digest.update(f"{lead}{role}:{text}".encode("utf-8", "surrogatepass"))
                top = (cost, audit, stack, digest)
            out[state] = top
        return out

    def _inserts(self) -> None:
        """Lets rows be inserted until that makes no top better."""
        changed = list(self.tops.values())
        while changed:
            better: dict[int, tuple] = dict(self.tops)
            states = set()
            for cost, audit, stack, digest in changed:
                for t, name in NAMES.items():
                    to = shifted(stack, t)
                    if self._offer(better, to, cost + INSERT, audit + "I", digest, name, ""):
                        states.add(to[-1])
            self.tops = self._settled(better)
            changed = [self.tops[s] for s in states]
        most = min(t[0] for t in self.tops.values()) + BEHIND
        self.tops = {s: t for s, t in self.tops.items() if t[0] <= most}

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """One more row."""
        new: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0
        initial = role[:1]
        for cost, audit, stack, digest in self.tops.values():
            self._offer(new, stack, cost + DELETE, audit + "D", digest, None, "")
            if must_go:
                continue
            if initial and initial in "sua":
                self._offer(new, shifted(stack, initial), cost + extra, audit + "K", digest, role, text)
            for t, name in NAMES.items():
                if t != initial:
                    self._offer(new, shifted(stack, t), cost + REROLE + extra, audit + "R", digest, name, text)
        self.tops = self._settled(new)
        self._inserts()
        self.rows += 1
        if self.rows % self.EVERY == 0:
            same = len(os.path.commonprefix([t[1] for t in self.tops.values()]))
            if same:
                self.agreed.append(next(iter(self.tops.values()))[1][:same])
                self.tops = {s: (t[0], t[1][same:], *t[2:]) for s, t in self.tops.items()}

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        cost, audit, _, digest = min((t for t in self.tops.values() if accepts(t[2])), key=lambda t: t[:2])
        return cost, "".join(self.agreed) + audit, (hashlib.sha256() if digest is None else digest).hexdigest()


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_truncated(text: str) -> bool:
    """Whether a text that isn't blank lacks its closing mark."""
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


class Report:
    """What is told of one conversation."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def row(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        blank = is_blank(text)
        duplicate = not blank and seen
        truncated = not blank and not duplicate and is_truncated(text)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def end(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


# -- all conversations ------------------------------------------------------------------------

_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _REPORT.split(", "))])


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations, a twentieth each dropped, emptied, without closing marks,
    repeated, or given to the user, by the crc32 of ``conv_id:turn``. Nulls in there, and null
    roles and texts, are one space. Dropped rows stay as ``gone``, so that their conversations do."""

    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(said("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


_ORDER = ("turn", "role", "text")


def _in_order(rows: DataFrame) -> DataFrame:
    """A conversation's rows in one task and in order, with ``seen``: whether an earlier row
    has the same role and text. The rows move once: both sorts are inside the tasks."""
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    marked = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    return marked.sortWithinPartitions("conv_id", *(F.asc_nulls_first(c) for c in _ORDER))


def repair(rows: DataFrame) -> DataFrame:
    """The faults and the cheapest repair of each conversation, from ``conv_id, turn, role,
    text, gone`` as :func:`damage` gives them (roles and texts not null).

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Rows come by turn, null turns first; of one turn by role and text. A null
    conv_id is a conversation of its own. One whose rows are all gone has zeros, an
    empty audit and the digest of an empty text. Rows of unknown roles can be reroled or
    deleted. Extra columns are left alone; an empty table gives no rows."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Report | None = None
        done: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    if now is not None:
                        done.append(now.end())
                    now = Report(r["conv_id"])
                if not r["gone"]:
                    now.row(r["turn"], r["role"], r["text"], r["seen"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _ARROW)], schema=_ARROW)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.end(), _ARROW)], schema=_ARROW)

    return _in_order(rows.select("conv_id", *_ORDER, "gone")).mapInArrow(told, _REPORT)


_FIXED = "conv_id long, place long, turn long, role string, text string, edit string"


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, place, turn, role, text, edit``, by the
    audits of :func:`repair` over the same rows. Inserted rows have no turn and an empty text.
    An audit comes before its conversation's rows and is followed while they pass."""
    own = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), *_ORDER, F.lit(None).cast("string").alias("audit"))
    none = F.lit(None)
    led = report.select("conv_id", F.lit(0), none.cast("long"), none.cast("string"), none.cast("string"), "audit")
    both = own.union(led).repartition("conv_id").sortWithinPartitions("conv_id", "part", *(F.asc_nulls_first(c) for c in _ORDER))

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, letters, at, place, wanted = None, "", 0, 0, ""
        schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _FIXED.split(", "))])
        for batch in batches:
            out: list[tuple] = []

            def give(turn, role: str | None, text: str, edit: str) -> None:
                """``wanted`` is the initial that comes next; only an ``s`` may come instead, first."""
                nonlocal place, wanted
                kept = edit == "K"
                out.append((conv_id, place, turn, role if kept else NAMES[wanted], text, edit))
                if not (kept and role[:1] == "s"):
                    wanted = "a" if wanted == "u" else "u"
                place += 1

            def inserts() -> None:
                nonlocal at
                while letters[at : at + 1] == "I":
                    give(None, None, "", "I")
                    at += 1

            for r in batch.to_pylist():
                if r["part"] == 0:
                    conv_id, letters, at, place, wanted = r["conv_id"], r["audit"], 0, 0, "u"
                else:
                    if letters[at] != "D":
                        give(r["turn"], r["role"], r["text"], letters[at])
                    at += 1
                inserts()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return both.mapInArrow(fixed, _FIXED)
