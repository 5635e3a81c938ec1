"""Conversation structure repair: the cheapest edits that leave `system? (user assistant)+`, or nothing.

Every row of a conversation is kept, given another role (rerole) or deleted, and rows with an empty text are inserted. A
program over the retained rows, from the last to the first, prices them: a gap between two retained rows costs the
difference of the prefix sums of deletions, and the pair of their roles says which rows must be inserted. For each role a
running minimum over the rows after holds the best continuation, so a row costs constant time. Among continuations of
equal cost the one whose edits read least (delete < insert < keep < rerole) is taken: a longer gap begins with another
deletion, and what begins at the same row differs in its first edit, so no strings are compared.

A conversation is read twice in order: first light rows (fault, first letter of the role), for which some bytes a row stay
in memory until the program has run, then the rows with their texts, which stream through. Nothing else grows with a
conversation, but its edits and its hash are one value each. Sorting is Spark's, and spills.

Null role and text count as one space. Null conversations are one conversation. Rows come by turn, nulls first; rows of
one turn by role, hash of the text, and copies after their original. Empty and very long texts are like any other. Extra
columns go. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import WORD

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What an undeleted truncated row costs.
CUT = 5
#: Faults of a row; one has the first that applies.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Rows that must stand between two retained roles; "" is the conversation's beginning or end. Pairs that aren't here cannot follow each other.
BETWEEN = {
    ("", ""): "", ("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("s", ""): "ua",
    ("u", "a"): "", ("u", "u"): "a", ("u", ""): "a", ("a", "u"): "", ("a", "a"): "u", ("a", ""): "",
}
#: White space that ends a text.
SPACE = " \t\n\x0b\x0c\r"
#: A conversation's first row only names it; then come the light rows, then the rows with texts.
ORDER = ["conv", "kind", "turn", "role", "digest", "copy"]


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows dropped, emptied, stripped of full stops, repeated or given to the user by a hash of their place."""
    spelled = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(spelled.cast("binary")), F.lit(20))
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = df.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), changed.alias("text"), copies.alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, copy, fault of each row, without its text. A row is a duplicate if its role and text were seen earlier."""
    blank = ~F.col("text").rlike(WORD)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    light = rows.select("conv", "turn", "role", "digest", "copy", blank.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    seen = Window.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")
    # dealt by conversation, which also does for the window, so that the rows move once
    again = F.row_number().over(seen) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    return light.repartition("conv").withColumn("again", again).select("conv", "turn", "role", "digest", "copy", fault.alias("fault"))


class Retained:
    """The program over one conversation's rows: initials of the roles, and their faults."""

    def __init__(self, initials: str, faults: bytes):
        n = len(initials)
        self.initials = initials
        deletions = array("q", [0]) * (n + 1)
        for i in range(n):
            deletions[i + 1] = deletions[i] + DELETE
        # by role retained before: the least cost from here on plus the deletions up to the row it goes on with, that row and role
        best = {r: (INSERT * len(BETWEEN[r, ""]) + deletions[n], n, "") for r in ("", "s", "u", "a")}
        self.next = {r: array("q", [0]) * n for r in "sua"}
        self.then = {r: bytearray(n) for r in "sua"}
        for i in range(n - 1, -1, -1):
            if faults[i] in (BLANK, DUPLICATE):
                continue
            extra, own = CUT if faults[i] == TRUNCATED else 0, initials[i]
            costs = {}
            for role in "sua":
                if role == own or role != "s":
                    rest, self.next[role][i], then = best[role]
                    self.then[role][i] = ord(then or " ")
                    costs[role] = (KEEP if role == own else REROLE) + extra + rest - deletions[i + 1]
            for before, (cost, at, then) in best.items():
                # of equal costs the one found first stays: a deletion, then an insertion, then what keeps its role
                for missing in (1, 0):
                    for role in sorted(costs, key=lambda r: r != own):
                        if len(BETWEEN.get((before, role), "  ")) == missing and costs[role] + INSERT * missing + deletions[i] < cost:
                            cost, at, then = costs[role] + INSERT * missing + deletions[i], i, role
                best[before] = cost, at, then
        self.cost, self.first, self.role = best[""]

    def edits(self) -> Iterator[tuple[str, str]]:
        """(edit, role) in order: D, I, K, R."""
        before, at, i, role = "", 0, self.first, self.role
        n = len(self.initials)
        while True:
            yield from (("D", "") for _ in range(at, i))
            yield from (("I", r) for r in BETWEEN[before, role])
            if i == n:
                return
            yield ("K" if role == self.initials[i] else "R"), role
            before, at = role, i + 1
            i, role = self.next[before][i], chr(self.then[before][i]).strip()


class Conversation:
    """What is known of one conversation while its rows stream by."""

    def __init__(self):
        self.initials, self.faults, self.counts = [], bytearray(), [0, 0, 0, 0]
        self.illegal, self.least, self.most, self.turns, self.turn = 0, None, None, 0, None
        self.plan = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)
        self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.least, self.most, self.turns, self.turn = turn if self.least is None else self.least, turn, self.turns + 1, turn

    def solve(self) -> None:
        self.plan = Retained([x if x and x in "sua" else "-" for x in self.initials], bytes(self.faults))
        self.pending = self.plan.edits()

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


REPORT = [(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", "string"), ("repaired_sha256", "string")]
ROWS = [("place", "bigint"), ("edit", "string"), ("role", "string"), ("text", "string")]


def prepared(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Light rows, rows with texts and one row for each original conversation, in the order in which they are read."""
    keyed = rows.select(F.struct("conv_id").alias("conv"), "turn", "role", "text", "copy", F.unhex(F.sha2("text", 256)).alias("digest"))
    light = faults(keyed).select("conv", F.lit(1).alias("kind"), "turn", "role", F.lit(None).cast("string").alias("text"), "copy", "digest", "fault")
    full = keyed.select("conv", F.lit(2).alias("kind"), "turn", "role", "text", "copy", "digest", F.lit(None).cast("int").alias("fault"))
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("role", "string"), ("text", "string"), ("copy", "int"), ("digest", "binary"), ("fault", "int"))]
    first = originals.select(F.struct("conv_id").alias("conv")).distinct().select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *empty)
    both = first.unionByName(light).unionByName(full).repartition("conv").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ORDER])
    return both.select(F.col("conv.conv_id").alias("conv_id"), "kind", "turn", "role", "text", "fault")


def stream(batches: Iterator[pa.RecordBatch], out: Out) -> Iterator[pa.RecordBatch]:
    """Feed the rows to `out` conversation by conversation; what it has made goes out with each batch."""
    now = None
    for batch in batches:
        for conv, kind, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                if now is not None:
                    out.end(now)
                now = Conversation()
                now.id, now.place, now.written = conv, 0, []
                out.begin(now)
            elif kind == 1:
                now.add(turn, role, fault)
            else:
                if now.plan is None:
                    now.solve()
                for edit, new in now.pending:
                    now.written.append(edit)
                    if edit == "I":
                        out.row(now, edit, NAMES[new], "")
                        continue
                    if edit != "D":
                        out.row(now, edit, role if edit == "K" else NAMES[new], text)
                    break
        if made := out.take():
            yield made
    if now is not None:
        out.end(now)
        if made := out.take():
            yield made


class Out:
    """Base of what is made of a stream of conversations."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.rows = names, kinds, []

    def begin(self, conv: Conversation) -> None: ...

    def row(self, conv: Conversation, edit: str, role: str, text: str) -> None: ...

    def end(self, conv: Conversation) -> None:
        """Rows inserted after the last one."""
        if conv.plan is None:
            conv.solve()
        for edit, new in conv.pending:
            conv.written.append(edit)
            self.row(conv, edit, NAMES[new], "")

    def take(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns, self.rows = list(zip(*self.rows, strict=True)), []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)], names=self.names)


class Reports(Out):
    def begin(self, conv: Conversation) -> None:
        conv.hash = hashlib.sha256()

    def row(self, conv: Conversation, edit: str, role: str, text: str) -> None:
        conv.hash.update(f"{chr(10) if conv.place else ''}{role}:{text}".encode())
        conv.place += 1

    def end(self, conv: Conversation) -> None:
        super().end(conv)
        blank, duplicate, truncated = conv.counts[1:]
        self.rows.append((conv.id, conv.gaps, blank, duplicate, truncated, conv.illegal, conv.plan.cost, "".join(conv.written), conv.hash.hexdigest()))


class Repaired(Out):
    def row(self, conv: Conversation, edit: str, role: str, text: str) -> None:
        self.rows.append((conv.id, conv.place, edit, role, text))
        conv.place += 1


def run(df: DataFrame, damage: bool, kind: type[Out], more: list[tuple[str, str]]) -> DataFrame:
    text, role = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("text", "role"))
    rows = damaged(df) if damage else df.select("conv_id", "turn", role, text, F.lit(0).alias("copy"))
    fields = [("conv_id", df.schema["conv_id"].dataType.simpleString()), *more]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, kinds = [n for n, _ in fields], [arrow[k] for _, k in fields]
    return prepared(rows, df).mapInArrow(lambda batches: stream(batches, kind(names, kinds)), ", ".join(f"{n} {k}" for n, k in fields))


def report(df: DataFrame, damage: bool = False) -> DataFrame:
    """One row for each conversation: gaps in its turns, faults, illegal neighbours, cost and edits of the repair, and the repaired rows' hash. With `damage`, of the damaged rows."""
    return run(df, damage, Reports, REPORT)


def repair(df: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, place, edit, role, text: the rows of the repaired conversations in order of place."""
    return run(df, damage, Repaired, ROWS)
