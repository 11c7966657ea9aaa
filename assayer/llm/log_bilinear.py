"""Token log-probabilities by a log-bilinear neural model trained with noise-contrastive estimation.

Counts of all training words are gathered in Spark, keyed by a 64-bit word hash.  The network
predicts one of ``HEAD`` most frequent words, one of ``GROUPS`` groups of all other words (by the
letters a word begins with) or the end of the text, from the ``CONTEXT`` units before: a context
vector is the sum of the previous units' vectors under diagonal position weights, and a unit's score
is its product with the unit's own vector plus a bias.  Inside a group a word has its add-one share
of the group's count, with one place for unknown words, so probabilities sum to one over known words
and one unknown word per group.

Training: texts are dealt into shards of about ``SHARD_TOKENS`` tokens by a hash of the row, so shards
(and with them the model) do not depend on how the table is partitioned, and a shard is long enough to
learn from whatever its number.  Each shard runs numpy stochastic gradient steps on the contrastive loss over
its texts in the order of their hash (unigram noise, shared by a batch), all from the same start, and the
parameters are averaged by token count in Spark.  A second pass starts from that average.  Scoring
normalises exactly, over all units: the sums of their exponentials are made by matrix products, once per
context and worker process.

Counts of the most frequent words (``LISTED``) are sent to every task, all others meet their counts
in a join.  Only a text's sums leave its task.

Nulls and edges: a null or empty text is one end token; a text of a null id is training text (its
remainder is unknown, not 2); without training texts N and V are 0; repeated rows count and are
scored once per row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import words
from assayer.session import materialize

HEAD, GROUPS, CONTEXT, WIDTH = 191, 64, 3, 24
UNITS = HEAD + GROUPS + 1  # the last unit is the end of a text, which also stands before its beginning
LISTED = 1 << 16
BUCKET_BITS = 18  # listed words lie in buckets by the first bits of their hash
SHIFT = np.uint64(64 - BUCKET_BITS)
BATCH, NOISE, RATE, PASSES = 2048, 48, 0.05, 2
SMALL = 1 << 17  # multiplications of a matrix product
SCORED = 512  # contexts scored at once: all units' scores of them stay in a core's cache
MET = 1 << 20  # tokens whose contexts are compared at once
FAR = 600  # scores of a context may lie this far apart for their exponentials to be products
SHARD_TOKENS, MAX_SHARDS = 1 << 21, 4096  # beyond that many, shards grow
END_HASH = np.uint64(1)
FLUSH = 1 << 21


def held_out(key: Column, of: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % of == rest, F.lit(False))


def _group_table() -> np.ndarray:
    """Group of a word by its first two bytes (A-Z lower-cased; a word of one byte has second byte 0)."""
    lower = np.arange(256)
    lower[65:91] += 32
    pair = lower[:, None] * 256 + lower[None, :]
    return (words.mix(pair.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int16)


_GROUP = _group_table()


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and groups of a slice of texts, and where each text's words begin."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > words.SLICE_BYTES:
        data = np.frombuffer(texts[0], np.uint8)
        hashes, starts, ends = words.locate(texts[0], True)
        splits = np.array([0, len(hashes)])
    else:
        data = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
        starts, ends = words.word_bounds(data)
        hashes = words.hash_words(data, starts, ends, True)
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        splits = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    second = np.where(ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)] if len(data) else 0, 0)
    return hashes, _GROUP[data[starts], second].astype(np.int64), splits


def _slices(batches, column: str = "text"):
    for whole in batches:
        for batch in words.row_blocks(whole, column):
            texts = words.as_bytes(batch.column(column))
            for i, j in words.slices(texts):
                yield batch.slice(i, j - i), tokens(texts[i:j])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``grp`` and ``c`` over all texts (column ``text``); the end token has group -1."""
    def rows(kept) -> pa.RecordBatch:
        h, g = (np.concatenate(x) for x in zip(*kept, strict=True))
        h, first, c = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(g[first], pa.int32()), pa.array(c, pa.int64())], ["word", "grp", "c"])

    def run(batches):
        kept, held = [], 0
        for batch, (h, g, _) in _slices(batches):
            ends = batch.num_rows
            kept.append((np.append(h, np.full(ends, END_HASH)), np.append(g, np.full(ends, -1))))
            held += len(h)
            if held > FLUSH:
                yield rows(kept)
                kept, held = [], 0
        if kept:
            yield rows(kept)

    return (docs.select("text").mapInArrow(run, "word long, grp int, c long")
            .groupBy("word", "grp").agg(F.sum("c").alias("c")))


class Vocabulary:
    """What every task needs: units of the head words and the counts of the listed ones."""

    def __init__(self, listed: pa.Table, totals: dict[int, tuple[int, int]], n: int, v: int):
        h = np.asarray(listed.column("word").combine_chunks(), np.int64).view(np.uint64)
        c, g = (np.asarray(listed.column(x).combine_chunks(), np.int64) for x in ("c", "grp"))
        inside = g >= 0
        self.n, self.v = n, v
        self.end_count = int(c[~inside].sum())
        h, c, g = h[inside], c[inside], g[inside]
        order = np.argsort(h)
        unit = np.full(len(h), -1)
        unit[:HEAD] = np.arange(min(HEAD, len(h)))  # listed by falling count
        self.hash, self.count, self.unit = h[order], c[order], unit[order]
        self.begin = np.searchsorted(self.hash >> SHIFT, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        # what a group's words share: its count without head words, its words and one unknown
        counts, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
        for k, (total, many) in totals.items():
            counts[k], kinds[k] = total, many
        head = np.flatnonzero(unit >= 0)
        np.subtract.at(counts, g[head], c[head])
        np.subtract.at(kinds, g[head], 1)
        self.group_log = np.log10(counts + kinds + 1)
        self.unigram = np.concatenate([c[head], np.zeros(HEAD - len(head)), counts + 1, [self.end_count]]) + 1.0

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the listed words, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        bucket = (h >> SHIFT).astype(np.intp)
        at, end = self.begin.take(bucket).astype(np.intp), self.begin.take(bucket + 1)
        out = np.where(self.hash.take(at, mode="clip") == h, at, -1)
        rest = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.hash[at[rest]] == h[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (at[rest] + 1 < end[rest])]
        return out

    def units(self, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
        unit = np.where(at >= 0, self.unit[at], -1) if len(self.hash) else np.full(len(at), -1)
        return np.where(unit >= 0, unit, HEAD + groups)


def with_ends(units: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with an end token after each text, and the ``CONTEXT`` units before each token."""
    every = np.insert(units, splits[1:], UNITS - 1).astype(np.int16)
    starts = splits[:-1] + np.arange(len(splits) - 1)
    context = np.full((CONTEXT, len(every)), UNITS - 1, np.int16).T
    for j in range(CONTEXT):
        context[j + 1:, j] = every[:-j - 1]
    for j in range(CONTEXT if len(every) else 0):  # a text's first tokens have fewer units before them
        context[np.minimum(starts + j, len(every) - 1), j:] = UNITS - 1
    return every, context


Model = dict[str, np.ndarray]


def fresh(vocabulary: Vocabulary) -> Model:
    r = np.random.default_rng(3)
    share = vocabulary.unigram / vocabulary.unigram.sum()
    return {"inner": (r.standard_normal((UNITS, WIDTH)) * 0.1).astype(np.float32),
            "outer": (r.standard_normal((UNITS, WIDTH)) * 0.1).astype(np.float32),
            "place": np.full((CONTEXT, WIDTH), 1.0, np.float32), "bias": np.log(share).astype(np.float32)}


def _summed(rows: np.ndarray, values) -> np.ndarray:
    """Sum per row number of the values, which ``values`` gives in an order of rows (16-bit numbers sort by digits)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out = np.zeros((UNITS, WIDTH), np.float32)
    out[rows[cut]] = np.add.reduceat(values(order), cut, axis=0)
    return out


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right`` in pieces too small for the library to start threads of its own: tasks fill the cores."""
    rows = max(1, SMALL // (right.shape[0] * right.shape[1]))
    whole = len(left) // rows * rows
    out = np.empty((len(left), right.shape[1]), left.dtype)
    if whole:
        np.matmul(left[:whole].reshape(-1, rows, left.shape[1]), right,
                  out=out[:whole].reshape(-1, rows, right.shape[1]))
    if whole < len(left):
        np.matmul(left[whole:], right, out=out[whole:])
    return out


def _crossed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right``, in pieces like those of ``_product``."""
    rows = max(1, SMALL // (left.shape[1] * right.shape[1]))
    whole = len(left) // rows * rows
    pieces = np.matmul(left[:whole].reshape(-1, rows, left.shape[1]).transpose(0, 2, 1),
                       right[:whole].reshape(-1, rows, right.shape[1]))
    return pieces.sum(0) + left[whole:].T @ right[whole:]


def _squashed(x: np.ndarray) -> np.ndarray:
    """``1 / (1 + exp(x))``, in place."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Stochastic gradient steps on the noise-contrastive loss."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.m = {k: v.copy() for k, v in model.items()}
        self.power = {k: np.full_like(v, 1e-2) for k, v in model.items()}
        self.random, self.tokens = np.random.default_rng(seed), 0
        self.reach = np.cumsum(share) / np.cumsum(share)[-1]
        self.log_noise = np.log(share * NOISE).astype(np.float32)

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        # whole rows are copied by ``take``, which costs a third of an index in brackets
        m, n = self.m, len(target)
        before = context.T.astype(np.intp, order="C")
        scaled = m["inner"] * m["place"][:, None]
        hidden = scaled[0].take(before[0], 0)
        for j in range(1, CONTEXT):
            hidden += scaled[j].take(before[j], 0)
        noise = np.searchsorted(self.reach, self.random.random(NOISE), "right")
        outer_own, outer_other = m["outer"].take(target, 0), m["outer"].take(noise, 0)
        offset = self.log_noise - m["bias"]
        own = np.einsum("nd,nd->n", hidden, outer_own) - offset.take(target)
        other = _product(hidden, -outer_other.T)
        other += offset.take(noise)
        up = _squashed(own)  # the true word is taken for noise
        down = _squashed(other)  # noise is taken for the true word
        to_hidden = up[:, None] * outer_own
        to_hidden -= _product(down, outer_other)
        toward = up[:, None] * hidden
        outer = _summed(target, lambda order: toward.take(order, 0))
        np.subtract.at(outer, noise, _crossed(down, hidden))
        bias = np.bincount(target, up, UNITS)
        np.subtract.at(bias, noise, down.sum(0))
        token, distance = np.tile(np.arange(n), CONTEXT), np.repeat(np.arange(CONTEXT), n)
        inner = _summed(context.T.ravel(), lambda order: to_hidden.take(token[order], 0)
                        * m["place"].take(distance[order], 0))
        place = np.stack([np.einsum("nd,nd->d", m["inner"].take(b, 0), to_hidden) for b in before])
        for name, grad in (("inner", inner), ("outer", outer), ("bias", bias.astype(np.float32)), ("place", place)):
            grad = grad / n
            self.power[name] += grad * grad
            m[name] += RATE * grad / np.sqrt(self.power[name])
        self.tokens += n


def _packed(model: Model) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def _unpacked(flat: np.ndarray, like: Model) -> Model:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def shard_count(tokens: int) -> int:
    return max(1, min(MAX_SHARDS, round(tokens / SHARD_TOKENS)))


def unit_texts(docs: DataFrame, shared, shards: int) -> DataFrame:
    """``shard``, ``h`` (hash of the row) and ``units`` (two bytes each, without ends) of every text."""
    def run(batches):
        vocabulary = shared.value
        for batch, (h, g, splits) in _slices(batches):
            units = vocabulary.units(vocabulary.look_up(h), g).astype("<i2")
            flat = pa.py_buffer(units.tobytes())
            offsets = pa.py_buffer((splits * 2).astype("<i4").tobytes())
            texts = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, flat])
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("h"), texts], ["shard", "h", "units"])

    key = F.xxhash64("id", "text")
    rows = docs.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("h"), "text")
    return rows.mapInArrow(run, "shard int, h long, units binary")


class _Shard:
    """Feeds a trainer with batches of equal size, wherever the rows of a shard are cut."""

    def __init__(self, start: Model, share: np.ndarray):
        self.trainer = Trainer(start, share, 1)
        self.target, self.context = np.zeros(0, np.int16), np.zeros((0, CONTEXT), np.int16)

    def add(self, units: np.ndarray, splits: np.ndarray) -> None:
        target, context = with_ends(units, splits)
        self.target, self.context = np.concatenate([self.target, target]), np.concatenate([self.context, context])
        whole = len(self.target) // BATCH * BATCH
        for at in range(0, whole, BATCH):
            self.trainer.step(self.target[at:at + BATCH], self.context[at:at + BATCH])
        self.target, self.context = self.target[whole:], self.context[whole:]

    def end(self) -> tuple[np.ndarray, int]:
        if len(self.target):
            self.trainer.step(self.target, self.context)
        return _packed(self.trainer.m).astype(np.float64) * self.trainer.tokens, self.trainer.tokens


def train_pass(units: DataFrame, shared, start: Model) -> Model:
    """Parameters after one pass over all training texts, averaged over shards by token count."""
    def run(batches):
        share = shared.value.unigram ** 0.75
        share, number, shard, total, tokens = share / share.sum(), None, None, 0.0, 0
        for whole in batches:
            for batch in words.row_blocks(whole, "units", 4 << 20):
                dealt = np.asarray(batch.column("shard"))
                cuts = [0, *(np.flatnonzero(np.diff(dealt)) + 1).tolist(), len(dealt)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == z:
                        continue
                    if dealt[a] != number:
                        if shard:
                            flat, n = shard.end()
                            total, tokens = total + flat, tokens + n
                        number, shard = dealt[a], _Shard(start, share)
                    texts = batch.column("units").slice(a, z - a).to_pylist()
                    splits = np.concatenate([[0], np.cumsum([len(t) // 2 for t in texts])])
                    shard.add(np.frombuffer(b"".join(texts), "<i2").astype(np.int64), splits)
        if shard:
            flat, n = shard.end()
            total, tokens = total + flat, tokens + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total),
                 pa.array(np.full(len(total), tokens), pa.int64())], ["at", "value", "tokens"])

    dealt = units.repartition("shard").sortWithinPartitions("shard", "h")
    mean = (dealt.mapInArrow(run, "at int, value double, tokens long")
            .groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value"))).toArrow()
    if not mean.num_rows:
        return start
    flat = np.zeros(len(_packed(start)))
    flat[np.asarray(mean.column("at"))] = np.asarray(mean.column("value"))
    return _unpacked(flat, start)


def unit_log10(model: Model, target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each target unit.  All units' scores are computed once for equal contexts."""
    key = np.zeros(len(target), np.int32)
    for j in range(CONTEXT):
        key = key * UNITS + context[:, j]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    first, row = np.flatnonzero(new), np.cumsum(new) - 1
    cuts = np.append(first, len(key))
    out = np.empty(len(target), np.float32)
    for a in range(0, len(first), SCORED):
        z = min(a + SCORED, len(first))
        before = context[order[first[a:z]]]
        hidden = sum(model["inner"][before[:, j]] * model["place"][j] for j in range(CONTEXT))
        scores = _product(hidden, model["outer"].T)
        scores += model["bias"]
        at, of = order[cuts[a]:cuts[z]], row[cuts[a]:cuts[z]] - a
        own = scores[of, target[at]]
        top = scores.max()
        if top - own.min() > 60:  # far apart: each row by its own maximum
            top = scores.max(1, keepdims=True)
        scores -= top
        total = np.ravel(top) + np.log(np.exp(scores, out=scores).sum(1))
        out[at] = (own - total[of]) / math.log(10)
    return out


class Normaliser:
    """Log10 probabilities of units after contexts, normalised over all units.

    A score is the unit's bias plus one number for each place of the context, by the unit there, so the
    exponentials of all scores are products of a row per place: their sums for the contexts that share all
    units but the farthest are one row of a matrix product.  Such a row is made when its first context comes
    and serves every later one.
    """

    def __init__(self, model: Model):
        self.model = model
        inner, place, outer = (model[k].astype(np.float64) for k in ("inner", "place", "outer"))
        self.parts = np.matmul(inner * place[:, None], outer.T)  # place, unit there, unit to come
        self.parts[0] += model["bias"]
        self.top = self.parts.max(2)
        self.far = (self.top - self.parts.min(2)).max(1).sum() > FAR
        self.exps = np.exp(self.parts - self.top[:, :, None])
        self.made = np.zeros(UNITS ** (CONTEXT - 1), bool)
        self.logs = np.empty((len(self.made), UNITS), np.float32)  # memory of rows not made is never touched

    def make(self, near: np.ndarray) -> None:
        """The rows of these contexts without their farthest unit, as numbers of ``CONTEXT - 1`` digits."""
        for a in range(0, len(near), UNITS):
            rest, product, top = near[a:a + UNITS], 1.0, 0.0
            for j in range(CONTEXT - 2, -1, -1):
                rest, unit = np.divmod(rest, UNITS)
                product, top = product * self.exps[j, unit], top + self.top[j, unit]
            sums = np.log(product @ self.exps[-1].T)
            self.logs[near[a:a + UNITS]] = sums + top[:, None] + self.top[-1]
        self.made[near] = True

    def log10(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        if self.far:  # products of exponentials could all vanish
            return np.concatenate([unit_log10(self.model, target[a:a + MET], context[a:a + MET])
                                   for a in range(0, max(1, len(target)), MET)])
        near, own = np.zeros(len(target), np.intp), np.zeros(len(target))
        for j in range(CONTEXT):
            before = context[:, j].astype(np.intp)
            own += self.parts[j].ravel().take(before * UNITS + target)
            if j < CONTEXT - 1:
                near = near * UNITS + before
        new = near[~self.made.take(near)]
        if len(new):
            self.make(np.unique(new))
        own -= self.logs.ravel().take(near * UNITS + before)
        return own / math.log(10)


def normaliser(model: Model) -> Normaliser:
    """The model's, with the rows made so far; a worker process keeps that of the last model for its next tasks."""
    kept, key = words.kept("log_bilinear", dict), _packed(model).tobytes()
    if key not in kept:
        kept.clear()
        kept[key] = Normaliser(model)
    return kept[key]


def local_sums(docs: DataFrame, shared, model: Model) -> DataFrame:
    """Per row (``id``, ``held_out``): sums over end and listed tokens, and hash and number of the others."""
    def run(batches):
        voc = shared.value
        log_count, after = np.log10(voc.count + 1.0), normaliser(model)
        for batch, (h, g, splits) in _slices(batches):
            at = voc.look_up(h)
            units = voc.units(at, g)
            target, context = with_ends(units, splits)
            unit = after.log10(target, context)
            listed, head = at >= 0, units < HEAD
            logs = np.where(listed, log_count[at], 0.0) if len(log_count) else np.zeros(len(h))
            # inside a group: log10((c + 1) / (count + words + 1)); rare words add log10(c + 1) later
            inner = np.where(head, 0.0, logs - voc.group_log[g])
            n = np.diff(splits)
            total = lambda x, cuts: np.add.reduceat(np.append(x, 0), cuts[:-1]) * (np.diff(cuts) > 0)
            score = total(unit, splits + np.arange(len(splits))) + total(inner, splits)
            base = total(logs, splits) + math.log10(voc.end_count + 1)
            known = total(listed.astype(np.int64), splits) + (voc.end_count > 0)
            rare, sizes = [], []
            for a, z in zip(splits[:-1], splits[1:], strict=True):
                w, c = np.unique(h[a:z][~listed[a:z]], return_counts=True)
                rare.append(w.view(np.int64))
                sizes.append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                ["id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "sizes"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "text").mapInArrow(
        run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, "
             "rare array<bigint>, sizes array<int>")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """Base and model score of each row, learnt from the rows that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).cast("binary").alias("text"))
    training = rows.filter("NOT held_out")
    counts = materialize(word_counts(training), "counts")
    totals = {r["grp"]: (r["c"], r["v"]) for r in
              counts.groupBy("grp").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    n, v = sum(c for c, _ in totals.values()), sum(k for _, k in totals.values())
    totals.pop(-1, None)
    listed = counts.filter("grp >= 0").orderBy(F.desc("c"), "word").limit(LISTED)
    end = counts.filter("grp = -1")
    vocabulary = Vocabulary(pa.concat_tables([end.toArrow(), listed.toArrow()]), totals, n, v)
    shared = spark.sparkContext.broadcast(vocabulary)
    model = fresh(vocabulary)
    units = materialize(unit_texts(training, shared, shard_count(n)), "units")
    for _ in range(passes):
        model = train_pass(units, shared, model)
    local = materialize(local_sums(rows, shared, model).withColumn("uid", F.monotonically_increasing_id()), "local")
    rare = local.select("uid", F.explode(F.arrays_zip("rare", "sizes")).alias("x")).selectExpr("uid", "x.rare AS word", "x.sizes AS k")
    found = (rare.join(counts.select("word", "c"), "word").groupBy("uid")
             .agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more")))
    more = F.coalesce("more", F.lit(0.0))
    return local.drop("rare", "sizes").join(found, "uid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("score") + more).alias("score"))
