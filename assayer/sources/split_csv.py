"""Quoted CSV of any file size, read by as many tasks as the file has splits.

A cell in quotes may hold line breaks, so a split may begin inside a cell.  First every split says, for
either way it may begin, how it ends (inside a quoted cell or not).  Going through the splits of a file
in order then tells how each really begins: one bit per split.  With that, every split cuts its lines into
records.  What precedes its first record and what follows its last are pieces of records that other
splits share; they are put together by the split they begin in.

Quotes follow Python's ``csv`` module: doubled quotes are one, a quote inside a cell that does not begin
with one is a plain character, and a carriage return outside quotes ends a record.  Blank lines are left out.
A quoted cell that its file never closes ends without the file's last line break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.session import materialize
from assayer.sources.splitting import HEAD, PARTS, RECORD, TAIL, put_together, runs

_CELL_ENDS = re.compile(r"[,\r]")


def scan_line(line: str, inside: bool) -> tuple[bool, list[int]]:
    """Whether a line that begins inside a quoted cell or not ends inside one, and where records end within it."""
    cuts: list[int] = []
    if not inside and '"' not in line and "\r" not in line:
        return False, cuts
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                at += 1
            else:
                end = _CELL_ENDS.search(line, at)
                if end is None:
                    return False, cuts
                at = end.end()
                if end[0] == "\r" and at < len(line):
                    cuts.append(at)
                continue
        close = line.find('"', at)
        if close < 0:
            return True, cuts
        if line.startswith('"', close + 1):
            inside, at = True, close + 2
            continue
        # what follows a closing quote up to the next cell is plain
        inside = False
        end = _CELL_ENDS.search(line, close + 1)
        if end is None:
            return False, cuts
        at = end.end()
        if end[0] == "\r" and at < len(line):
            cuts.append(at)


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split: how it ends if it begins outside, and if it begins inside a quoted cell."""
    key, ends = None, [False, True]
    for path, block, lines in runs(batches):
        if key != (path, block):
            if key:
                yield pd.DataFrame([(*key, *ends)], columns=["path", "block", "outside", "inside"])
            key, ends = (path, block), [False, True]
        for line in lines:
            if line is not None:  # lines without a quote change nothing
                ends = [scan_line(line, e)[0] for e in ends] if ends[0] != ends[1] else [scan_line(line, ends[0])[0]] * 2
    if key:
        yield pd.DataFrame([(*key, *ends)], columns=["path", "block", "outside", "inside"])


def _begins(splits: pd.DataFrame) -> pd.DataFrame:
    """Splits of one file that begin inside a quoted cell."""
    out, inside = [], False
    for row in splits.sort_values("block").itertuples():
        if inside:
            out.append((row.path, row.block))
        inside = row.inside if inside else row.outside
    return pd.DataFrame(out, columns=["path", "block"])


def _cutter(begins_inside: set[tuple[str, int]]):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records that lie in one split (numbered), and the pieces at its ends."""
        key, inside, role, held, number, out = None, False, RECORD, [], 0, []

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame(out, columns=["path", "block", "role", "number", "record"])
            out.clear()
            return rows

        def end_split() -> None:
            if key and held:
                # an unfinished record, or a split that lies in a cell as a whole
                out.append((*key, HEAD if role == HEAD else TAIL, 0, "\n".join(held)))

        for path, block, lines in runs(batches):
            if key != (path, block):
                end_split()
                key, held, number = (path, block), [], 0
                inside = key in begins_inside
                role = HEAD if inside else RECORD
            for line in lines:
                inside, cuts = scan_line(line, inside)
                held.append(line)
                if cuts:
                    *before, last = held
                    whole = [last[a:b] for a, b in zip([0, *cuts], [*cuts, len(last)], strict=True)]
                    for piece in whole[:-1]:
                        text, before = "\n".join([*before, piece]), []
                        if role == HEAD or text.strip("\r"):
                            out.append((*key, role, number, text))
                            number += role == RECORD
                        role = RECORD
                    held = [whole[-1]]
                if not inside:
                    text = "\n".join(held)
                    if role == HEAD or text.strip("\r"):
                        out.append((*key, role, number, text))
                        number += role == RECORD
                    held, role = [], RECORD
                if len(out) >= 4096:
                    yield flush()
        end_split()
        yield flush()

    return cut


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``source_path``, ``source_row_id`` (place in its file, from 0) and ``record`` (its text, whole)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    marked = lines.withColumn("value", F.when(F.col("value").contains('"') | F.col("value").contains("\r"), F.col("value")))
    splits = marked.mapInPandas(_transitions, "path string, block long, outside boolean, inside boolean")
    inside = splits.groupBy("path").applyInPandas(_begins, "path string, block long")
    # at most one row per split
    known = {(r["path"], r["block"]) for r in inside.collect()}
    parts = lines.mapInPandas(_cutter(known), PARTS)
    rows = put_together(materialize(parts, "csv-records"), "\n")
    return rows.select(F.col("path").alias("source_path"), F.col("place").alias("source_row_id"),
                       F.regexp_replace("record", "\r$", "").alias("record"))
