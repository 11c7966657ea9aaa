"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its minimum *and* its
maximum, so a signature of ``2 * permutations`` values costs half the hash evaluations.  Bands of
``rows`` values are bucketed; with 46 bands of 5 a pair of similarity 0.75 is missed with probability
4e-6.  One byte of each value is kept besides: the share of equal bytes estimates the similarity with
a standard error of 0.024 at 320 values, and pairs 4.5 errors below the threshold are not looked at
(another 3e-6).  What remains is confirmed on full shingle sets.

No bucket is expanded into its pairs.  Documents with equal sets are one from the start.  First every
bucket compares its members with its smallest id, which joins the bulk of a group of near copies.
Then only buckets that still hold several components are looked at, in tiles of bounded size, and
only pairs across components are compared, each in the first band the two share.

Nulls and edges: a null text is an empty text; texts without words have an empty set and are linked
with nothing; a null id is returned with a null component and links nothing; repeated rows are
repeated in the result; rows that share an id with different texts are documents of their own, each with
the component of its own text; other columns are not read.  ``keep_one`` carries rows whole, whatever
their columns are called, and of equal rows it keeps one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import words
from assayer.llm.graphs import components
from assayer.session import materialize

SHINGLE = 5
PERMUTATIONS, ROWS, BANDS = 160, 5, 46
ERRORS = 4.5
TILE = 512


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    found, splits = words.hashed(texts, lower=True)
    gram, inside = words.grams(found, splits, k)
    for a, z in zip(splits[:-1], splits[1:], strict=True):
        if z - a >= k:
            yield np.unique(gram[a:z - k + 1])
        elif z > a:  # the whole sequence is the only shingle
            one, _ = words.grams(found[a:z], np.array([0, z - a]), int(z - a))
            yield one
        else:
            yield np.zeros(0, np.uint64)


def min_max(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation of 32-bit integers."""
    short = (shingles >> np.uint64(20)).astype(np.uint32)
    low = np.full(len(factors), 2**32 - 1, np.uint32)
    high = np.zeros(len(factors), np.uint32)
    for at in range(0, len(short), 2048):
        seen = (short[None, at:at + 2048] ^ masks[:, None]) * factors[:, None]
        np.minimum(low, seen.min(axis=1), out=low)
        np.maximum(high, seen.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands_of(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Bucket numbers of each signature row."""
    used = signatures[:, :rows * bands].reshape(len(signatures), bands, rows).astype(np.uint64)
    bucket = np.broadcast_to(np.arange(bands, dtype=np.uint64), used.shape[:2])
    for j in range(rows):
        bucket = words.mix(bucket * np.uint64(0x9E3779B97F4A7C15) + used[:, :, j])
    return bucket


def byte_of(signatures: np.ndarray) -> np.ndarray:
    """One well-mixed byte of each value."""
    return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
           permutations: int = PERMUTATIONS, rows: int = ROWS, bands: int = BANDS,
           row: Column | None = None) -> DataFrame:
    """``id``, ``row``, ``n_shingles``, ``key`` (digest of the set; null if empty), ``bands`` and ``sig`` bytes.

    ``row`` numbers the rows; unless given, the numbers hold only once the result is stored.
    """
    if rows * bands > 2 * permutations:
        raise ValueError("the bands need more signature values than the permutations give")
    factors = words.stream(11, permutations).astype(np.uint32) | np.uint32(1)
    masks = words.stream(12, permutations).astype(np.uint32)

    def run(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, "text"):
                texts, sizes, keys, signatures = words.as_bytes(batch.column("text")), [], [], []
                for i, j in words.slices(texts):
                    for s in shingle_sets(texts[i:j], k):
                        sizes.append(len(s))
                        keys.append(_key(s) if len(s) else None)
                        signatures.append(min_max(s, factors, masks))
                values = np.array(signatures, np.uint32)
                found = bands_of(values, rows, bands).view(np.int64)
                offsets = np.arange(0, found.size + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(found.ravel())),
                     pa.array([v.tobytes() for v in byte_of(values)], pa.binary())],
                    ["id", "row", "n_shingles", "key", "bands", "sig"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                         (F.monotonically_increasing_id() if row is None else row).alias("row"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"id {id_type}, row long, n_shingles long, key binary, bands array<bigint>, sig binary")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id`` and full sorted ``shingles`` of the wanted classes (``id``, and ``doc`` and ``key`` to find the text by).

    Texts of the same document id with another set are left out.  The plan is the same at every size.
    """
    def run(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, "text"):
                texts, keys = words.as_bytes(batch.column("text")), batch.column("key").to_pylist()
                sets = [s for i, j in words.slices(texts) for s in shingle_sets(texts[i:j], k)]
                good = [_key(s) == key for s, key in zip(sets, keys, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["id", "shingles"]).filter(pa.array(good, pa.bool_()))

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    found = source.join(wanted.hint("merge"), "doc").select("id", "key", "text").mapInArrow(
        run, "id long, shingles binary")
    # equal rows of one document id give the same set
    return found.groupBy("id").agg(F.first("shingles").alias("shingles"))


def linked(ours: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(ours, other, assume_unique=True))
    return both * 100 >= (len(ours) + len(other) - both) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` with 100 * intersection >= ``percent`` * union of their full sets."""
    def run(batches):
        last, ours = None, None
        for batch in batches:
            a, left, right = (batch.column(c) for c in ("a", "sa", "sb"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, ours = a[i], np.frombuffer(left[i].as_py(), np.uint64)
                good[i] = linked(ours, np.frombuffer(right[i].as_py(), np.uint64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    id_type = pairs.schema["a"].dataType.simpleString()
    members = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = members.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {id_type}, b {id_type}")


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def likely(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether the byte signatures allow the similarity wanted."""
    want, values = percent / 100, left.shape[1]
    least = want - ERRORS * (want * (1 - want) / values) ** 0.5
    return (left == right).mean(axis=1) >= least + (1 - least) / 256


def _likely_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` (columns ``sa``, ``sb``: signatures) that may be linked."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                good = likely(_bytes_matrix(part.column("sa")), _bytes_matrix(part.column("sb")), percent)
                yield part.select(["a", "b"]).filter(pa.array(good))

    id_type = rows.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, f"a {id_type}, b {id_type}")


def _tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links across components (``root``) of each tile, each in the first band that both share.

    Full sets travel with the rows, so that no unconfirmed pair leaves a tile.

    Rows come sorted by ``tile``; a tile is either one block of a bucket or two (``side`` 0 and 1).
    """
    def found(tile, rows):
        ids, root, side, sig, bands, band, sets = rows
        full = lambda i: np.frombuffer(sets[int(i)].as_py(), np.uint64)
        size = np.diff(np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]])))
        at = np.arange(len(tile))
        out_a, out_b = [], []
        for d in range(1, int(size.max()) if len(size) else 1):
            at = at[at + d < len(tile)]
            at = at[tile[at] == tile[at + d]]
            i = at[(root[at] != root[at + d]) & ((side[at] < 0) | (side[at] != side[at + d]))]
            for cut in range(0, len(i), 8192):
                x = i[cut:cut + 8192]
                y = x + d
                first = (bands[x] == bands[y]).argmax(axis=1) == band[x]
                x, y = x[first], y[first]
                good = likely(sig[x], sig[y], percent)
                x, y = x[good], y[good]
                sure = np.array([linked(full(p), full(q), percent) for p, q in zip(x, y, strict=True)], bool)
                out_a.append(x[sure])
                out_b.append(y[sure])
        none = np.zeros(0, np.int64)
        return [ids.take(pa.array(np.concatenate([none, *o]))) for o in (out_a, out_b)]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held else table
            tile = np.asarray(table.column("tile"))
            done = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0  # the last tile may go on
            held = table.slice(done)
            yield from emit(table.slice(0, done))
        if held:
            yield from emit(held)

    def emit(table):
        if table.num_rows:
            t = table.combine_chunks()
            column = lambda c: t.column(c).chunk(0)
            bands = np.asarray(column("bands").flatten()).reshape(t.num_rows, -1)
            rows = (column("id"), np.asarray(column("root").dictionary_encode().indices),
                    np.asarray(column("side")), _bytes_matrix(column("sig")), bands, np.asarray(column("band")),
                    column("shingles"))
            yield pa.RecordBatch.from_arrays(found(np.asarray(column("tile")), rows), ["a", "b"])

    id_type = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("tile").sortWithinPartitions("tile")
    return dealt.select("tile", "id", "root", "side", "sig", "bands", "band", "shingles").mapInArrow(
        run, f"a {id_type}, b {id_type}")


def links(classes: DataFrame, fetch, percent: int = 75, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` between classes (``id``, ``bands``, ``sig``) that share a bucket.

    ``fetch(wanted)`` gives the full sets of class ids.  Complete up to links inside one component.
    """
    members = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    centre = (members.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n"))
              .filter("n > 1"))
    busy = materialize(members.join(centre, "bucket"), "busy")
    wanted = busy.select("id").distinct()
    signed = materialize(classes.join(wanted, "id").join(fetch(wanted), "id"), "signed")

    star = busy.filter("id <> centre").selectExpr("centre AS a", "id AS b").distinct()
    star = (star.join(signed.selectExpr("id AS b", "sig AS sb"), "b")
            .join(signed.selectExpr("id AS a", "sig AS sa"), "a"))
    star = materialize(confirmed(materialize(_likely_pairs(star, percent), "pairs"), signed, percent), "links")

    root = components(star).withColumnRenamed("node", "id")
    placed = busy.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = (placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .filter("lo <> hi").select("bucket"))
    # buckets beyond one tile are cut into blocks; each pair of blocks is a tile
    blocks = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (placed.join(open_, "bucket").withColumn("blocks", blocks).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("id", "root", "band", F.xxhash64("bucket", low, high).alias("tile"),
                         side.cast("int").alias("side"))
    rest = _tile_links(dealt.join(signed, "id"), percent)
    return star.unionAll(materialize(rest, "links"))


def _classified(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int,
                row: Column | None = None) -> DataFrame:
    """``id``, ``row``, ``n_shingles`` and ``least``: the smallest (id, row) of the component, null if in none.

    Documents with equal sets are one class, named after the row number of its first document.
    """
    known = materialize(sketch(docs, id_col, text_col, k, row=row), "sketch")
    named = known.filter("key IS NOT NULL AND id IS NOT NULL").withColumn("first", F.struct("id", "row"))
    classes = named.groupBy("key").agg(F.min("first").alias("first"),
                                       F.min_by(F.struct("bands", "sig"), "first").alias("s"))
    classes = classes.select(F.col("first.row").alias("id"), "key", "first", "s.bands", "s.sig")
    place = classes.select("id", F.col("first.id").alias("doc"), "key")
    fetch = lambda wanted: sets_of(docs, place.join(wanted, "id"), id_col, text_col, k)
    root = components(links(classes.drop("key", "first"), fetch, percent)).withColumnRenamed("node", "id")
    rooted = classes.select("id", "key", "first").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return known.select("id", "row", "n_shingles", "key").join(
        rooted.join(least, "root").select("key", "least"), "key", "left").withColumn(
        "least", F.when(F.col("id").isNotNull(), F.col("least")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``."""
    component = F.coalesce("least.id", "id")
    return _classified(docs, id_col, text_col, k, percent).select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        (F.col("id") == component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, the first row of the smallest id, of each group of near-duplicates.

    Rows without id or words stay.  Rows are stored with a number and decided on one by one.
    """
    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                                   F.monotonically_increasing_id().alias("row")), "numbered")
    texts = rows.select(F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"), "row")
    found = _classified(texts, "id", "text", SHINGLE, 75, F.col("row"))
    gone = found.filter("least.row <> row").select("row")
    return rows.join(gone.hint("merge"), "row", "left_anti").select("doc.*")
