"""MySQL dumps as tables, read through Spark's own file system.

    read_dump(spark, "s3a://bucket/dump.sql", "wp_posts")

A dump is read as lines, in splits that begin anywhere: inside a statement over many lines, or inside a quoted literal. So a
first pass finds for each split how its quotes end if it begins outside a literal, and if inside; run over the splits of a
file in order, that gives each split's beginning. The second pass parses the statements that lie whole inside a split. What
hangs over at its edges is put together, statement by statement, and parsed by itself. A statement must fit into memory, as MySQL has it too.

Numbers are numbers by their column's type, other values strings, NULL null. `_corrupt` is true for a tuple whose number of
values isn't the number of columns, of which the values are null. Lines of comments are left out outside of literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.scratch import Scratch

#: Types of columns, and those that are numbers.
WHOLE, BROKEN = "bigint|int|integer|smallint|tinyint|mediumint|year", "float|double|decimal"
TYPES = f"{WHOLE}|{BROKEN}|varchar|char|text|tinytext|mediumtext|longtext|date|datetime|timestamp|time|blob|tinyblob|mediumblob|longblob|enum|set|json|bit|binary|varbinary"
COLUMN = re.compile(rf"^\s*`([^`]+)`\s+({TYPES})\b", re.IGNORECASE)
DEFINES = re.compile(r"^\s*(`|PRIMARY|KEY|UNIQUE|CONSTRAINT|FULLTEXT|INDEX)")
STARTS = re.compile(r"^\s*((INSERT|REPLACE|CREATE|DROP|ALTER|LOCK|UNLOCK|SET|USE|START|COMMIT|BEGIN|DELETE|UPDATE|DELIMITER)\b)", re.IGNORECASE)
COMMENT = re.compile(r"^\s*(--(\s|$)|#|/\*)")
#: Escapes inside quoted literals. Any other escaped character stands for itself.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a"}
LEXEME = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()'\s][^,()']*)|([,()])", re.DOTALL)


def literal(quoted: str | None, bare: str | None) -> str | None:
    if quoted is not None:
        return re.sub(r"\\(.)|''", lambda m: ESCAPES.get(m[1], m[1]) if m[1] else "'", quoted, flags=re.DOTALL)
    return None if bare.strip().upper() == "NULL" else bare.strip()


def tuples(values: str) -> Iterator[list[str | None]]:
    """The tuples of a VALUES list, as read by a lexer of quoted and bare literals."""
    row: list[str | None] | None = None
    depth, pending = 0, False
    for m in LEXEME.finditer(values):
        mark = m[3]
        if mark == "(":
            depth += 1
            if depth == 1:
                row, pending = [], False
        elif mark == ")":
            depth -= 1
            if depth == 0 and row is not None:
                yield row
                row = None
        elif mark == ",":
            pending = False
        elif row is not None and depth == 1 and not pending:
            row.append(literal(m[1], m[2]))
            pending = True


def columns_of(lines: list[str]) -> list[tuple[str, str]]:
    """Names and Spark types of the columns that the lines of a CREATE TABLE define; keys don't count."""
    found = {m[1]: m[2].lower() for line in reversed(lines) if (m := COLUMN.match(line))}
    kind = lambda t: "bigint" if t in WHOLE.split("|") else "double" if t in BROKEN.split("|") else "string"
    return [(c, kind(t)) for c, t in reversed(found.items())]


def insert_values(statement: str, table: str) -> str | None:
    m = re.match(rf"\s*(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+`{re.escape(table)}`\s*(?:\([^)]*\)\s*)?VALUES\s*(.*?);?\s*$", statement, re.DOTALL | re.IGNORECASE)
    return m[1] if m else None


def quoted_after(line: str, quoted: int) -> int:
    """Whether a literal is open after the line, if it is (1) or isn't (0) before."""
    if not quoted and COMMENT.match(line):
        return 0
    return (quoted + (re.sub(r"\\.", "", line).count("'") if "'" in line else 0)) & 1


class Survey:
    """How a split's quotes end for either beginning, and what it holds of the table's definition."""

    def __init__(self, table: str):
        self.mark, self.ends, self.head, self.create, self.open = f"CREATE TABLE `{table}`", [0, 1], [], None, True

    def feed(self, line: str) -> None:
        self.ends = [quoted_after(line, q) for q in self.ends]
        if self.open and self.create is None:  # a definition that began in the split before
            self.open = bool(DEFINES.match(line))
            if self.open:
                self.head.append(line)
        if line.startswith(self.mark):
            self.create, self.open = [], True
        elif self.create is not None and self.open:
            self.open = not line.startswith(")")
            if self.open:
                self.create.append(line)

    def rows(self) -> list[tuple]:
        return [(self.ends[0], self.ends[1], self.head, self.create, self.open)]


class Statements:
    """Tuples of the statements that lie whole inside a split, and what hangs over at its edges."""

    def __init__(self, table: str, quoted: int):
        self.table, self.begun, self.quoted = table, quoted, quoted
        self.made: list[list[str | None]] = []
        self.head: str | None = None
        self.lines: list[str] | None = None
        self.in_head: bool | None = None

    def feed(self, line: str) -> None:
        if not self.quoted and COMMENT.match(line):
            return
        if self.in_head is None and (self.quoted or line.strip()):  # a blank line tells nothing of where the split begins
            self.in_head = bool(self.quoted) or not STARTS.match(line)
            self.lines = [] if self.in_head else None
        begins = not self.quoted and self.lines is None and re.match(rf"\s*(INSERT|REPLACE)\b[^`]*`{re.escape(self.table)}`", line, re.IGNORECASE)
        self.quoted = quoted_after(line, self.quoted)
        if begins:
            self.lines = []
        if self.lines is None:
            return
        self.lines.append(line)
        if not self.quoted and line.rstrip().endswith(";"):
            statement = "\n".join(self.lines)
            if self.in_head:
                self.head, self.in_head = statement, False
            elif (values := insert_values(statement, self.table)) is not None:
                self.made += tuples(values)
            self.lines = None

    def rows(self) -> list[tuple]:
        rest = None if self.lines is None else "\n".join(self.lines)
        # a split without a telling line is inside whatever it is inside
        tail, whole = (None, rest or "") if self.in_head or self.in_head is None else (rest, None)
        made = [(self.begun, m, None, None, None, False) for m in self.made]
        return [*made, (self.begun, None, self.head, tail, whole, True)]


def by_split(lines: DataFrame, make, schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows that machines make of the lines of each split, which come in order."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machines = None, []

        def done() -> pa.RecordBatch:
            rows = [(*now, *r) for m in machines for r in m.rows()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), *types], strict=True)], names=names)

        for batch in batches:
            for line, file, split in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (file, split):
                    if now is not None:
                        yield done()
                    now, machines = (file, split), make()
                for m in machines:
                    m.feed(line)
        if now is not None:
            yield done()

    return lines.mapInArrow(work, schema)


def beginnings(splits: pd.DataFrame) -> pd.DataFrame:
    """file, split, quoted: how each split of a file begins."""
    at, out = 0, []
    for r in splits.sort_values("split").itertuples():
        out.append((r.file, r.split, at))
        at = r.end1 if at else r.end0
    return pd.DataFrame(out, columns=["file", "split", "quoted"])


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table's rows with their columns' types, and `_corrupt`. The definition stands in the dump."""
    scratch = Scratch(spark, "dump")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    schema = "file string, split long, end0 int, end1 int, head array<string>, defined array<string>, open boolean"
    splits = scratch.save(by_split(lines, lambda: [Survey(table)], schema, [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]), "splits")
    first = splits.filter("defined is not null").orderBy("file", "split").first()
    if first is None:
        raise ValueError(f"{path} doesn't define {table}")
    definition = list(first.defined)
    if first.open:
        for r in splits.filter((F.col("file") == first.file) & (F.col("split") > first.split)).orderBy("split").select("head", "open").toLocalIterator():
            definition += r.head
            if not r.open:
                break
    columns = columns_of(definition)

    # a row for each split
    begin = scratch.save(splits.select("file", "split", "end0", "end1").groupBy("file").applyInPandas(lambda pdf: beginnings(pdf), "file string, split long, quoted int"), "beginnings")
    # a split that begins inside a literal is rare: only if there is any, both beginnings are tried, and the right one stays
    tried = (0,) if begin.filter("quoted = 1").isEmpty() else (0, 1)
    schema = "file string, split long, quoted int, made array<string>, head string, tail string, whole string, edge boolean"
    found = by_split(lines, lambda: [Statements(table, q) for q in tried], schema, [pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.bool_()])
    found = scratch.save(found if len(tried) == 1 else found.join(begin, ["file", "split", "quoted"], "left_semi"), "found")

    # what hangs over belongs to the last split before that ends otherwise than inside it
    edges = found.filter("edge")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("whole").isNull(), F.struct(F.col("split").alias("at"), F.col("tail").isNotNull().alias("tail"))), ignorenulls=True).over(before)
    hanging = edges.withColumn("opened", opened).filter("opened.tail and coalesce(head, whole) is not null").select("file", F.col("opened.at").alias("chain"), "split", F.coalesce("head", "whole").alias("text"))
    parts = edges.filter("tail is not null").select("file", F.col("split").alias("chain"), F.lit(-1).cast("long").alias("split"), F.col("tail").alias("text")).unionByName(hanging)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        values = insert_values("\n".join(pdf.sort_values("split")["text"]), table)
        return pd.DataFrame({"made": list(tuples(values)) if values is not None else []})

    rows = found.filter("not edge").select("made").unionByName(parts.groupBy("file", "chain").applyInPandas(joined, "made array<string>"))
    fits = F.size("made") == len(columns)
    return rows.select(*[F.when(fits, F.get("made", F.lit(i))).try_cast(k).alias(c) for i, (c, k) in enumerate(columns)], (~fits).alias("_corrupt"))
