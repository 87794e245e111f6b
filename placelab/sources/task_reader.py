"""Delimited files with quoted line breaks, read in splits.

Spark cuts files into ranges of whole lines. Whether a range starts inside a quoted
field depends on all text before it, so every range is parsed under both assumptions
until they agree, which is mostly within a line or two. The end of one range then
decides the start of the next, file by file; records that cross ranges are put
together from the pieces at their ends.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelab.operators.skew import join_per_key
from placelab.session import materialize, ship_package

MAX_PIECE, ROWS_PER_BATCH = 1 << 24, 8192
_RECORDS = "path string, start long, seq long, inside boolean, fields array<string>, head string, tail string, closed boolean, n long, problem string"
_FILES = "path string, start long, seq long, inside boolean, fields array<string>, n long, problem string"


class _Lines:
    """Lines for the csv reader; remembers which it has taken since the last record."""

    def __init__(self, lines: list[str], quoted: bool) -> None:
        self.lines, self.quoted, self.taken, self.begun, self.ended = lines, quoted, 0, 0, False

    def __iter__(self) -> _Lines:
        return self

    def __next__(self) -> str:
        if self.taken == len(self.lines):
            self.ended = True
            raise StopIteration
        line = self.lines[self.taken]
        self.taken += 1
        return '"' + line if self.quoted and self.taken == 1 else line


@dataclass
class _Parse:
    """A range under one assumption: records (first line, fields), and the pieces at its ends."""

    records: list[tuple[int, list[str]]] = field(default_factory=list)
    head: str = ""
    tail: str = ""
    closed: bool = True
    met: int | None = None
    problem: str | None = None


def _piece(lines: list[str]) -> str | None:
    return "".join(lines) if sum(map(len, lines)) <= MAX_PIECE else None


def parse_range(lines: list[str], sep: str, inside: bool, known: dict[int, int] | None = None) -> _Parse:
    """Records of a range; with ``known`` (first lines of records) only up to the first of these that is met.

    A record that is open at the end is no record of the range: its text is ``tail``. With
    ``inside``, the lines up to the end of the quoted record are ``head``; a range that
    never closes it is all head and not ``closed``.
    """
    feed, done = _Lines(lines, inside), _Parse()
    reader = csv.reader(feed, delimiter=sep)
    headed = not inside
    try:
        while True:
            begun = feed.taken
            if headed and known is not None and begun in known:
                done.met = begun
                return done
            fields = next(reader, None)
            if feed.ended:  # in the midst of a record, or at the end
                rest = lines[begun:]
                done.closed = not rest
                piece = _piece(rest)
                if headed:
                    done.tail = piece
                else:
                    done.head = piece
                if piece is None:
                    done.problem = f"a record of more than {MAX_PIECE} characters over the end of a split"
                return done
            if headed:
                done.records.append((begun, fields))
            else:
                done.head, headed = _piece(lines[: feed.taken]), True
                if done.head is None:
                    done.problem = f"a record of more than {MAX_PIECE} characters over the end of a split"
    except csv.Error as error:
        done.problem = f"{type(error).__name__}: {error}"
        return done


def range_rows(path: str, start: int, data: list[bytes], sep: str) -> Iterator[tuple]:
    """Rows of _RECORDS: records (``inside`` null: under both assumptions), then one summary (``n`` set) for each assumption."""
    try:
        text = "\n".join(x.decode("utf-8") for x in data) + "\n"
    except UnicodeDecodeError as error:
        for inside in (False, True):
            yield path, start, -1, inside, None, "", "", True, 0, f"{type(error).__name__}: {error}"
        return
    lines = list(io.StringIO(text.removeprefix("﻿") if start == 0 else text, newline=""))
    plain = parse_range(lines, sep, False)
    options = [(False, plain)]
    agree = 0
    if start:
        at = {begun: i for i, (begun, _) in enumerate(plain.records)}
        if plain.problem is None:
            at[len(lines) if plain.closed else len(lines) - len(io.StringIO(plain.tail, newline="").readlines())] = len(plain.records)
        other = parse_range(lines, sep, True, at)
        agree = len(plain.records)
        if other.met is not None:
            agree = at[other.met]
            other.tail, other.closed = plain.tail, plain.closed
        options.append((True, other))
        yield from ((path, start, line, True, fields, None, None, None, None, None) for line, fields in other.records if any(fields))
    for i, (line, fields) in enumerate(plain.records):
        if any(fields):
            yield path, start, line, False if i < agree else None, fields, None, None, None, None, None
    shared = plain.records[agree:]
    for inside, parse in options:
        mine = parse.records + (shared if inside and parse.met is not None else [])
        named = [(line, fields) for line, fields in mine if any(fields)]
        line, fields = named[0] if named else (-1, None)
        yield path, start, line, inside, fields, parse.head, parse.tail, parse.closed, len(named), parse.problem


def resolved(ranges: pd.DataFrame, sep: str) -> pd.DataFrame:
    """From the summaries of one file: how each range starts, the records between ranges, and (``start`` -1) the header.

    Records between ranges come with the number of the line after the last and ``n`` -1.
    """
    path = ranges["path"].iloc[0]
    by = {(r.start, bool(r.inside)): r for r in ranges.itertuples()}
    inside, carried, begun, out, header, total = False, "", 0, [], None, 0

    def between(text: str) -> None:
        nonlocal header, total
        fields = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])
        if any(fields):
            total += 1
            out.append((path, begun, 1 << 40, None, fields, -1, None))
            header = header or (begun, 1 << 40, fields)

    problem = None
    for start in sorted(set(ranges["start"])):
        r = by[(start, inside)]
        if r.problem is not None:
            problem = r.problem
            break
        out.append((path, start, -1, inside, None, r.n, None))
        if inside:
            carried += r.head
            if not r.closed and not r.tail:  # all of it is inside one record
                if len(carried) > MAX_PIECE:
                    problem = f"a record of more than {MAX_PIECE} characters over the end of a split"
                    break
                continue
            between(carried)
        if r.n:
            total += int(r.n)
            header = header or (start, int(r.seq), list(r.fields))
        carried, begun, inside = r.tail, start, not r.closed
    if problem is None and inside:
        between(carried)
    if problem is None and header is None:
        problem = "ValueError: no header"
    at, line, fields = header or (-1, -1, None)
    names: list[str] = []
    for name in fields if fields is not None and problem is None else ():
        names.append(name if name not in names else f"{name}.{names.count(name)}")
    out.append((path, -1, -1, None, names, total, problem))
    if header:
        out.append((path, at, line, None, None, -2, None))
    return pd.DataFrame(out, columns=["path", "start", "seq", "inside", "fields", "n", "problem"])


@dataclass(frozen=True)
class Records:
    """``rows``: (path, names, fields) of all records but headers; ``headers``: (path, names); ``skipped``: (path, reason)."""

    rows: DataFrame
    headers: DataFrame
    skipped: DataFrame


def read_records(spark: SparkSession, path: str, sep: str) -> Records:
    """All records of delimited files with a header each; no file is held by one task.

    A range of a file is held by one task, and so is a record that crosses ranges (at
    most MAX_PIECE characters in a range). A file with a broken range, without a header or
    with a row longer than its header is skipped as a whole, with the reason. Blank rows
    are left out; files of no bytes are not listed.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        schema = pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("inside", pa.bool_()),
            ("fields", pa.list_(pa.string())), ("head", pa.string()), ("tail", pa.string()), ("closed", pa.bool_()),
            ("n", pa.int64()), ("problem", pa.string())])

        def ranges() -> Iterator[tuple[str, int, list[bytes]]]:
            now, held = None, []
            for batch in batches:
                for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if (file, start) != now:
                        if now:
                            yield *now, held
                        now, held = (file, start), []
                    held.append(line)
            if now:
                yield *now, held

        kept = []
        for file, start, held in ranges():
            for row in range_rows(file, start, held, sep):
                kept.append(row)
                if len(kept) == ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
                    kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)

    ship_package(spark)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        plain.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    table = materialize(lines.mapInArrow(parse, _RECORDS))
    files = materialize(table.filter("n IS NOT NULL").groupBy("path").applyInPandas(lambda ranges: resolved(ranges, sep), _FILES))

    record = ["path", "start", "seq", "fields"]
    parsed = table.filter("n IS NULL")
    starts = files.filter("n >= 0 AND start >= 0").select("path", "start", "inside")
    rows = parsed.filter("inside IS NULL").select(record).unionByName(
        parsed.filter("inside IS NOT NULL").join(starts, ["path", "start", "inside"], "left_semi").select(record)
    ).unionByName(files.filter("n = -1").select(record))
    heads = files.filter("start = -1")
    at = files.filter("n = -2").select("path", F.col("start").alias("head_start"), F.col("seq").alias("head_seq"))
    named = heads.filter("problem IS NULL").select("path", F.col("fields").alias("names"), "n").join(at, "path")
    joined = join_per_key(rows, named, ["path"], "n").filter("start <> head_start OR seq <> head_seq")
    long = materialize(joined.filter("size(fields) > size(names)").groupBy("path").agg(
        F.min(F.struct("start", "seq", F.size("fields").alias("has"), F.size("names").alias("names"))).alias("r")).select(
        "path", F.format_string("ValueError: a row has %d fields, the header %d", "r.has", "r.names").alias("reason")))
    return Records(
        joined.join(long, "path", "left_anti").select("path", "names", "fields"),
        named.join(long, "path", "left_anti").select("path", "names"),
        heads.filter("problem IS NOT NULL").select("path", F.col("problem").alias("reason")).unionByName(long),
    )
