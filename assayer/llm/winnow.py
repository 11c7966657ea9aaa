"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, ``k`` consecutive word hashes make a rolling k-gram hash, and of every ``w``
consecutive k-grams the one of least hash is kept, the rightmost of equals.  A k-gram and its
position share one integer (31 bits of hash above 32 bits that fall with the position), so the least
integer of a window is that choice.  Two texts that share ``w + k - 1`` words in a row share at least
one kept hash, and a kept position tells where.  A text of fewer than ``k`` words has one k-gram of
all its words; a text without words has none.

Nulls and edges: a null text is an empty text; likeness is the Jaccard index of the kept hashes, 1
for two empty fingerprints; null ids come last in descending order; rows that repeat an id are
ordered by a hash of their text, and equal rows share their result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.session import materialize

K, W = 5, 16
_LOW = (1 << 32) - 1
ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def kept_grams(text: Column, k: int = K, w: int = W) -> Column:
    """Packed hash and position of the kept k-grams, in order of position."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    # an array of one element binds a value, so that lambdas do not compute it again
    return F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), lambda hashes: _kept(hashes, k, w))[0]


def _kept(hashes: Column, k: int, w: int) -> Column:
    packed = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << 31) - 1)), 32) + (F.lit(_LOW) - i.cast("long"))
    last = F.greatest(F.size(hashes) - k, F.lit(0))
    whole = F.aggregate(hashes, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))
    rolled = F.transform(F.sequence(F.lit(0), last), lambda i: packed(
        F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]), i))
    grams = F.when(F.size(hashes) >= k, rolled).otherwise(F.array(packed(whole, F.lit(0))))
    # bound once, read by every window
    chosen = F.transform(F.array(grams), lambda g: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(g) - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(g, i, w)))))[0]
    return F.when(F.size(hashes) > 0, chosen).otherwise(F.array().cast("array<bigint>"))


def shown(kept: Column) -> Column:
    """``hash:position`` of each kept k-gram, joined by commas."""
    return F.array_join(F.transform(kept, lambda v: F.concat_ws(
        ":", F.hex(F.shiftright(v, 32)), (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("string"))), ",")


def likeness(left: Column, right: Column) -> Column:
    hashes = lambda kept: F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 32)))
    a, b = hashes(left), hashes(right)
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def ring(rows: DataFrame) -> DataFrame:
    """``id``, ``k``, ``h``, ``n`` of distinct rows with ``next_k``, ``next_h``: the next by falling id, then the first.

    A range sort numbers the rows; the next number is the next row but at the end of a partition, and
    there is one such row per partition.
    """
    placed = (rows.select("id", "k", "h", "n").distinct().repartitionByRange(F.desc("id"), "h")
              .sortWithinPartitions(F.desc("id"), "h").withColumn("at", F.monotonically_increasing_id()))
    placed = materialize(placed, "ring")
    part = F.shiftright("at", ROW_BITS)
    ends = placed.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # one row per partition, whatever the table holds
    heads = sorted((r["first"], r["last"]) for r in ends.collect())
    jump = {last: heads[(i + 1) % len(heads)][0] for i, (_, last) in enumerate(heads)}
    spark = rows.sparkSession
    jumps = spark.createDataFrame(list(jump.items()), "at long, jump long")
    linked = placed.join(jumps, "at", "left").withColumn("next_at", F.coalesce("jump", F.col("at") + 1))
    after = placed.select(F.col("at").alias("next_at"), F.col("k").alias("next_k"), F.col("h").alias("next_h"))
    return linked.join(after, "next_at").select("id", "k", "h", "n", "next_k", "next_h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # a row's key: never null, so that aggregates and joins deal it alike
    key = F.coalesce(F.col("id").cast("string"), F.lit("no id"))
    rows = rows.withColumns({"k": key, "h": F.xxhash64("text"), "n": F.char_length("text").cast("long")})
    order = ring(rows)
    # the same columns and no lambda before the exchange, so that one exchange of texts serves both joins
    base = rows.select("k", "h", "text")
    take = F.floor(F.col("n") / 3)
    # the text keeps its name: a renamed column would make another exchange
    nxt = base.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), "text")
    heads = order.join(nxt, ["next_k", "next_h"]).select(
        "id", "k", "h", "n", F.substring("text", F.lit(1), take.cast("int")).alias("head"),
        kept_grams(F.col("text"), k, w).alias("next_kept"))
    # a next row that is repeated gives equal heads
    heads = heads.groupBy("k", "h").agg(*[F.first(c).alias(c) for c in ("id", "n", "head", "next_kept")])
    joined = base.join(heads, ["k", "h"])
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - take).cast("int")), "head")
    joined = joined.select("id", "n", kept_grams(F.col("text"), k, w).alias("kept"), "next_kept", edited.alias("edited"))
    joined = joined.select("id", "n", "kept", "next_kept", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                           kept_grams(F.col("edited"), k, w).alias("edited_kept"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", shown(F.col("kept")).alias("fingerprint"),
        shown(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"))
