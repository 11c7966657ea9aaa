"""Entries of one large JSON object, ``{id: {...}, ...}``, read by as many tasks as the file has splits.

The file is read as lines that end in a closing brace, so a line is never longer than an entry, whether or not
the document has line breaks.  Every split says, for either way it may begin (inside a text or not), how it
ends and by how much the depth changes; going through the splits of a file in order tells how each
really begins.  Then every split cuts out the entries: a brace that brings the depth back to one ends one.

Documents may follow each other in a file.  Values that are not objects are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.session import materialize
from assayer.sources.splitting import HEAD, PARTS, RECORD, TAIL, put_together, runs

_REST_OF_TEXT = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|\{', re.S)


def scan_piece(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece (without the brace that ends it) ends inside a text, and the change of depth, its brace counted."""
    at = 0
    if inside:
        rest = _REST_OF_TEXT.match(piece)
        if rest is None:
            return True, 0
        at = rest.end()
    depth = 0
    for token in _TOKEN.finditer(piece, at):
        if token[0] == "{":
            depth += 1
        elif not token[1] or token[0] == '"':
            return True, depth
    return False, depth - 1


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split, for both ways it may begin: whether it ends inside a text, and the change of depth."""
    names, key, ends = ["path", "block", "outside", "outside_depth", "inside", "inside_depth"], None, None

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*key, *ends[0], *ends[1])], columns=names)

    for path, block, pieces in runs(batches):
        if key != (path, block):
            if key:
                yield row()
            key, ends = (path, block), [(False, 0), (True, 0)]
        for piece in pieces:
            found = {e: scan_piece(piece, e) for e in {ends[0][0], ends[1][0]}}
            ends = [(found[e][0], depth + found[e][1]) for e, depth in ends]
    if key:
        yield row()


def _begins(splits: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins: inside a text, and at which depth."""
    out, inside, depth = [], False, 0
    for row in splits.sort_values("block").itertuples():
        out.append((row.path, row.block, inside, depth))
        depth += row.inside_depth if inside else row.outside_depth
        inside = row.inside if inside else row.outside
    return pd.DataFrame(out, columns=["path", "block", "inside", "depth"])


def _cutter(begins: dict[tuple[str, int], tuple[bool, int]]):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, depth, role, held, number, out = None, False, 0, RECORD, [], 0, []

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame(out, columns=["path", "block", "role", "number", "record"])
            out.clear()
            return rows

        def end_split() -> None:
            if key and held:
                out.append((*key, HEAD if role == HEAD else TAIL, 0, "}".join(held)))

        for path, block, pieces in runs(batches):
            if key != (path, block):
                end_split()
                key, held, number = (path, block), [], 0
                inside, depth = begins.get(key, (False, 0))
                # between entries (depth one, outside a text) nothing is shared with another split
                role = HEAD if inside or depth > 1 else RECORD
            for piece in pieces:
                inside, change = scan_piece(piece, inside)
                depth += change
                held.append(piece)
                if not inside and depth <= 1:
                    if depth == 1 or role == HEAD:
                        out.append((*key, role, number, "}".join(held)))
                        number += role == RECORD
                    held, role = [], RECORD
                    depth = max(depth, 0)
                if len(out) >= 4096:
                    yield flush()
        end_split()
        yield flush()

    return cut


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """``source_path`` and ``entry``: a JSON object with one entry, for every entry of the documents."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = pieces.mapInPandas(_transitions, "path string, block long, outside boolean, outside_depth long, "
                                              "inside boolean, inside_depth long")
    found = splits.groupBy("path").applyInPandas(_begins, "path string, block long, inside boolean, depth long")
    # one row per split
    begins = {(r["path"], r["block"]): (r["inside"], r["depth"]) for r in found.filter("inside OR depth <> 0").collect()}
    parts = materialize(pieces.mapInPandas(_cutter(begins), PARTS), "object-entries")
    rows = put_together(parts, "}")
    body = F.regexp_replace("record", r"^\s*[{,]?", "")
    # what follows the last entry of a document holds no object
    return rows.withColumn("entry", F.concat(F.lit("{"), body, F.lit("}}"))).filter(
        F.col("record").contains("{")).select(F.col("path").alias("source_path"), "entry")
