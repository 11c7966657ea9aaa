"""Near-duplicate vectors through spherical-cap filters.

A filter is a direction; it holds the vectors whose inner product with it exceeds ``cap`` (in
standard deviations of a random unit vector).  Directions are the codewords of random product codes:
rotated vectors are cut into two blocks, each block has its own set of random code vectors, and a
direction joins one of each; ``rotations`` such codes keep a vector's filters independent enough.  List decoding finds all directions above the cap without trying them
all: block scores are sorted and combinations are extended only while the best completion still
reaches the cap.  Vectors that share a filter are compared in double precision.

Inside a filter, rows are compared in tiles of bounded size as matrix products.  A pair is counted in
the first filter its vectors share and nowhere else; a tile gives the number of links per vector and
a spanning forest of its links, never its pairs.  Vectors of equal direction bytes are one from the
start and count with their multiplicity.

A vector is in about 35 filters.  Of 1,500 random pairs of cosine exactly 0.95 none was missed, and
1 % of the pairs of dense clusters between 0.95 and 0.96; pairs
that are compared are exact.  A random pair shares a filter with probability 0.014, so tables far
beyond 10 ** 7 vectors want a higher ``cap`` with more ``codes``.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of each length are searched among themselves; a null id is returned with null
component; rows that repeat an id are vectors of their own under it, each with its own result, and of
equal rows one is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm import words
from assayer.llm.graphs import components
from assayer.session import materialize

THRESHOLD = 0.95
ROTATIONS, CODES = 16, 128
CAP = 3.5
TILE = 1024


def _code(dim: int, codes: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and the code vectors of each of two blocks; together they have unit length."""
    r = np.random.default_rng(seed)
    rotation = np.linalg.qr(r.standard_normal((dim, dim)))[0]
    cut = (dim + 1) // 2
    blocks = []
    for size in (cut, dim - cut):
        c = r.standard_normal((codes, size)) if size else np.zeros((1, 0))
        blocks.append(c / np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True)) * math.sqrt(size / dim))
    return rotation, blocks


def fitted(dim: int, codes: int, cap: float) -> tuple[float, int]:
    """Least inner product, and code vectors per block.

    In few dimensions the cap would leave the sphere: it then ends at 0.75, with as many directions
    as keep a vector in a few dozen filters.
    """
    least = cap / math.sqrt(dim)
    if least <= 0.75:
        return least, codes
    share = 0.5 * (1 - 0.75 ** 2) ** ((dim - 1) / 2)
    return 0.75, max(2, min(codes, round(math.sqrt(4 / share))))


def list_decode(x: np.ndarray, rotation: np.ndarray, blocks: list[np.ndarray], least: float) -> Iterator[np.ndarray]:
    """Filter numbers of each unit vector."""
    turned = x @ rotation
    cut = blocks[0].shape[1]
    left, right = turned[:, :cut] @ blocks[0].T, turned[:, cut:] @ blocks[1].T
    order = np.argsort(-right, axis=1)
    for a, b, second in zip(left, right, order, strict=True):
        best = b[second]
        use = np.flatnonzero(a + best[0] >= least)
        counts = np.searchsorted(-best, a[use] - least, "right")
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        yield np.repeat(use * len(b), counts) + second[within]


def units(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def numbered_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (little-endian components, null where not usable) and row number ``uid`` of all rows.

    The numbers hold only once the table is written.
    """
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    fine = (F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
            & F.exists("v", lambda x: x != 0))

    def run(batches):
        for batch in batches:
            out = [np.asarray(v.values).astype(kind).tobytes() if v.is_valid else None for v in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "v"])

    source = rows.select(F.col(id_col).alias("id"), v.alias("v"))
    source = source.select("id", F.when(fine, F.col("v")).alias("v"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, v binary").withColumn(
        "uid", F.monotonically_increasing_id())


def filtered(classes: DataFrame, kind: str, rotations: int, codes: int, cap: float) -> DataFrame:
    """``classes`` with their ascending ``filters``, which vectors of one length share."""
    columns, width = classes.columns, int(kind[-1])

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            out: list = [None] * batch.num_rows
            raw = batch.column("v").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            for size in np.unique(sizes).tolist():
                dim = size // width
                if dim not in known:  # families of one length at a time
                    least, many = fitted(dim, codes, cap)
                    known = {dim: (least, many, [_code(dim, many, seed) for seed in range(rotations)])}
                least, many, families = known[dim]
                places = np.flatnonzero(sizes == size)
                for at in range(0, len(places), 512):
                    some = places[at:at + 512].tolist()
                    x = units([raw[i] for i in some], kind, dim)
                    each = [[f + k * many * many for f in list_decode(x, *family, least)]
                            for k, family in enumerate(families)]
                    for i, parts in zip(some, zip(*each, strict=True), strict=True):
                        out[i] = np.sort(np.concatenate(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(out, pa.list_(pa.int32()))], [*columns, "filters"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, fields + ", filters array<int>")


def _first_shared(own: int, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether two rows share no filter below ``own``."""
    lower = [x[:np.searchsorted(x, own)] for x in (*left, *right)]
    every = np.unique(np.concatenate(lower)) if lower else np.zeros(0, np.int64)
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(every), 4096):
        some = every[at:at + 4096]
        marks = np.zeros((len(lower), len(some)), np.float32)
        for row, x in zip(marks, lower, strict=True):
            x = x[(x >= some[0]) & (x <= some[-1])]
            row[np.searchsorted(some, x)] = 1
        shared += marks[:len(left)] @ marks[len(left):].T
    return shared == 0


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric link matrix."""
    todo, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not todo[start]:
            continue
        todo[start] = False
        reach = [start]
        while reach:
            at = reach.pop()
            fresh = np.flatnonzero(linked[at] & todo)
            todo[fresh] = False
            edges += [(at, int(x)) for x in fresh]
            reach += fresh.tolist()
    return edges


def _tile(own: int, ids, v: np.ndarray, many: np.ndarray, filters: list, side: np.ndarray, threshold: float):
    """(id, weight of links found) and forest edges (id, id) of one tile."""
    if side[0] < 0:
        a = b = np.arange(len(ids))
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    linked = v[a] @ v[b].T >= threshold
    if side[0] < 0:
        np.fill_diagonal(linked, False)
    use_a, use_b = linked.any(1), linked.any(0)
    a, b, linked = a[use_a], b[use_b], linked[use_a][:, use_b]
    if not linked.any():
        return {}, []
    linked &= _first_shared(own, [filters[i] for i in a], [filters[i] for i in b])
    weight: dict[int, int] = {}
    both = ((a, linked, b),) if side[0] < 0 else ((a, linked, b), (b, linked.T, a))
    for rows, m, others in both:
        for i, w in zip(rows.tolist(), (m * many[others]).sum(1).tolist(), strict=True):
            if w:
                weight[i] = weight.get(i, 0) + int(w)
    if side[0] < 0:
        edges = [(a[i], a[j]) for i, j in _forest(linked)]
    else:
        n = len(a)
        square = np.zeros((n + len(b),) * 2, bool)
        square[:n, n:] = linked
        square[n:, :n] = linked.T
        nodes = np.concatenate([a, b])
        edges = [(nodes[i], nodes[j]) for i, j in _forest(square)]
    return weight, edges


def tile_links(rows: DataFrame, kind: str, threshold: float) -> DataFrame:
    """``a``, ``b``, ``links``: link weight of ``a`` where ``b`` is null, else a forest edge."""
    id_type = rows.schema["id"].dataType.simpleString()

    def emit(table):
        table = table.combine_chunks()
        column = lambda c: table.column(c).chunk(0)
        own, tile, many, side = (np.asarray(column(c)) for c in ("filter", "tile", "many", "side"))
        raw = column("v")
        filters = [np.asarray(f.values) for f in column("filters")]
        ids, out = column("id"), ([], [], [])
        cuts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]), [True]]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            part = raw.slice(s, e - s).to_pylist()  # of one length
            v = units(part, kind, len(part[0]) // int(kind[-1]))
            weight, edges = _tile(int(own[s]), range(e - s), v, many[s:e], filters[s:e], side[s:e], threshold)
            for i, w in weight.items():
                out[0].append(s + i), out[1].append(None), out[2].append(w)
            for i, j in edges:
                out[0].append(s + int(i)), out[1].append(s + int(j)), out[2].append(0)
        take = lambda x: ids.take(pa.array(x, pa.int64()))
        return pa.RecordBatch.from_arrays([take(out[0]), take(out[1]), pa.array(out[2], pa.int64())], ["a", "b", "links"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held else table
            tile = np.asarray(table.column("tile"))
            done = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0  # the last tile may go on
            held = table.slice(done)
            if done:
                yield emit(table.slice(0, done))
        if held:
            yield emit(held)

    dealt = rows.repartition("tile").sortWithinPartitions("tile")
    return dealt.select("tile", "filter", "id", "v", "many", "filters", "side").mapInArrow(
        run, f"a {id_type}, b {id_type}, links long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, rotations: int = ROTATIONS, codes: int = CODES,
                    cap: float = CAP, tile: int = TILE) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` for each row."""
    every = materialize(numbered_vectors(rows, id_col, vector_col), "vectors")
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    usable = every.filter("v IS NOT NULL")
    # a class is named by its smallest id, a hash of its vector (so that names order alike on every run) and a row
    classes = usable.groupBy("v").agg(F.min("id").alias("id"), F.min_by("uid", "id").alias("uid"), F.count("*").alias("many"))
    classes = classes.select("v", F.struct("id", F.xxhash64("v").alias("mark"), "uid").alias("id"), "many")
    coded = materialize(filtered(classes, kind, rotations, codes, cap), "filters")
    held = coded.select("id", F.octet_length("v").alias("size"), F.explode("filters").alias("filter"))
    busy = held.groupBy("size", "filter").agg(F.count("*").alias("n")).filter("n > 1")
    # filters beyond one tile are cut into blocks; each pair of blocks is a tile
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (held.join(busy, ["size", "filter"]).withColumn("blocks", F.ceil(F.col("n") / tile).cast("int"))
             .withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("filter", "id", F.xxhash64("size", "filter", low, high).alias("tile"), side.cast("int").alias("side"))
    found = materialize(tile_links(dealt.join(coded, "id"), kind, threshold), "links")
    root = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "first")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("links"))
    known = (coded.select("v", F.col("id").alias("first"), "many").join(root, "first", "left").join(counts, "first", "left")
             .select("v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
                     F.coalesce("root", "first").alias("root")))
    linked = usable.join(known, "v").select("id", "n_links", F.col("root.id").alias("component"),
                                            (F.col("root.uid") == F.col("uid")).alias("kept"))
    alone = every.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"),
                                             F.when(F.col("id").isNotNull(), True).alias("kept"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), "kept")
