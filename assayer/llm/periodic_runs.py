"""Find stretches of words that repeat with a period, by minimizers at many scales.

A run is a stretch of at least ``max(24, 3 * q)`` words in which words ``q`` apart are equal, ``q`` being
the smallest such period, and which no neighbouring word extends.

* Periods up to ``SHORT`` are found by direct scans: words are compared with those ``q`` behind.
* A scale ``W`` covers periods in ``(W / 1.5, W]``.  Every window of ``W // 3 + 1`` neighbouring ``W``-grams
  names its minimum (all ties).  A run of such a period holds two windows that lie one period apart, so
  their minima do as well, and the rotations of a primitive word differ, so no equal ``W``-gram lies between:
  neighbouring occurrences of equal minima are one period apart.  Each such pair is a seed and is extended
  both ways to the longest stretch with that lag.
* Candidates whose period has a divisor that is a period too are left to that smaller period.  Every
  candidate is compared word by word before it counts.

Texts are scanned about a slice at a time, with a distinct mark between texts, so that array
operations span many of them; no pairs of words are ever listed.  A text longer than a slice stands alone
and takes some 150 bytes of memory per word.

Nulls, edges, ties: a null, empty or blank text has no words and no runs; words are told apart by 64-bit
hashes of their bytes (a word of any length is hashed in bounded pieces); two runs may overlap and
both count; rows are independent, so repeated rows give equal results and a null id is kept as it is; of
runs with the greatest exact ratio of length to period the smallest start, then period, comes
first; an empty table gives no rows; columns beside id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import words

SHORT = 8  # periods found by direct scans
FIRST_SCALE = 12  # covers periods 9 to 12
LEAST = 24  # words in a run
TIMES = 3  # periods in a run


class _Prefix:
    """Hashes of all ranges of a word array from sums of ``w[i] * base ** i``."""

    def __init__(self, w: np.ndarray):
        up, down = words.powers(len(w) + 1)
        self.down = down
        self.total = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * up[:len(w)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return words.mix((self.total[k:] - self.total[:n]) * self.down[:n])


def _sliding(x: np.ndarray, k: int, fold: np.ufunc) -> np.ndarray:
    """``fold`` over every window of ``k``, by doubling."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = fold(x[:len(x) - step], x[step:])
        done += step
    return x


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True."""
    turn = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def _short_lags(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for q in range(1, min(SHORT, len(w) - 1) + 1):
        start, end = _stretches(w[q:] == w[:-q])
        end = end + q
        long = end - start >= max(LEAST, TIMES * q)
        if long.any():
            yield start[long], end[long], q


def _seeds(prefix: _Prefix, n: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and lag of neighbouring equal minima whose lag the scale covers."""
    span = scale // 3 + 1
    none = np.zeros(0, np.int64)
    if n < scale + span:
        return none, none
    x = prefix.grams(scale)
    least = _sliding(x, span, np.minimum)
    # a position is the minimum of some window where the largest minimum around it is its own value
    wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(_sliding(wide, span, np.maximum) == x)
    at = at[np.argsort(x[at], kind="stable")]
    lag = at[1:] - at[:-1]
    good = (x[at[1:]] == x[at[:-1]]) & (lag <= scale) & (3 * lag > 2 * scale)
    return at[:-1][good], lag[good]


def _extend(prefix: _Prefix, n: int, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest stretches around ``at`` in which words ``lag`` apart are equal, by bisection."""
    def reach(most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = equal(mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    right = reach(n - lag - at, lambda k: prefix.of(at, at + k) == prefix.of(at + lag, at + lag + k))
    left = reach(at.copy(), lambda k: prefix.of(at - k, at) == prefix.of(at - k + lag, at + lag))
    return at - left, at + lag + right


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + ([n] if n > 1 else [])


def find_runs(w: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, end, period) of all runs in an array of word hashes, by start, then period.

    ``longest`` bounds the words of one text where several are joined by distinct marks.
    """
    n, longest = len(w), longest or len(w)
    candidates = [np.stack([s, e, np.full(len(s), q)], 1) for s, e, q in _short_lags(w)]
    if longest >= TIMES * (SHORT + 1):
        prefix, scale = _Prefix(w), FIRST_SCALE
        covered = SHORT
        while covered < longest // TIMES:
            at, lag = _seeds(prefix, n, scale)
            if len(at):
                start, end = _extend(prefix, n, at, lag)
                long = end - start >= np.maximum(LEAST, TIMES * lag)
                if long.any():
                    candidates.append(np.unique(np.stack([start, end, lag], 1)[long], axis=0))
            covered, scale = scale, scale * 3 // 2
    if not candidates:
        return np.zeros((0, 3), np.int64)
    runs, open_ = set(), np.unique(np.concatenate(candidates), axis=0).tolist()
    while open_:
        start, end, q = open_.pop()
        if not np.array_equal(w[start:end - q], w[start + q:end]):
            # two ranges share a hash: take this lag word by word instead
            s, e = _stretches(w[q:] == w[:-q])
            e = e + q
            long = e - s >= max(LEAST, TIMES * q)
            open_ += np.stack([s, e, np.full(len(s), q)], 1)[long].tolist()
        elif not any(np.array_equal(w[start:end - q // p], w[start + q // p:end]) for p in _primes(q)):
            runs.add((start, end, q))
    return np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=None) -> bytes | None:
    """Words joined by one space, or fed to ``digest``, some thousand words at a time."""
    out, step = [], 1 << 16
    for at in range(0, len(starts), step):
        s, e = starts[at:at + step], ends[at:at + step]
        size = e - s + 1
        first = np.concatenate([[0], np.cumsum(size)])
        # a byte of the output is the byte at its word's start plus its place in the word
        index = np.arange(first[-1]) + np.repeat(s - first[:-1], size)
        space = first[1:] - 1
        index[space] = 0
        piece = data[index]
        piece[space] = 32
        piece = piece.tobytes() if at + step < len(starts) else piece[:-1].tobytes()
        if digest is None:
            out.append(piece)
        else:
            digest.update(piece)
    return b"".join(out) if digest is None else None


def _scan(texts: list[bytes | None]) -> Iterator[tuple]:
    """Runs (start, length, period) and the place of each word for the texts of one slice."""
    marks = words.stream(7, len(texts))
    located = [words.locate(t or b"") for t in texts]
    w = np.concatenate([x for i, (h, _, _) in enumerate(located) for x in (h, marks[i:i + 1])])
    sizes = np.array([len(h) for h, _, _ in located])
    runs = find_runs(w, int(sizes.max()))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    cut = np.searchsorted(runs[:, 0], first)
    for i, (_, starts, ends) in enumerate(located):
        mine = runs[cut[i]:cut[i + 1]]
        yield [(s - first[i], e - s, q) for s, e, q in mine.tolist()], starts, ends


def _keep(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run holds after its first period."""
    depth = np.zeros(n + 1, np.int32)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


_KINDS = {"id": None, "n_words": "long", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>",
          "text": "string", "collapsed_sha256": "string"}


def _run_struct() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  with_text: bool = True) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (start, length, period by start, then period), ``text`` with every run cut to
    its first period (words joined by one space) and ``collapsed_sha256`` of that text.

    ``with_text=False`` leaves the collapsed text null and hashes it piece by piece.
    """
    def run(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, "text"):
                texts, rows = words.as_bytes(batch.column("text")), []
                for a, b in words.slices(texts):
                    for text, (runs, starts, ends) in zip(texts[a:b], _scan(texts[a:b]), strict=True):
                        keep = _keep(len(starts), runs) if runs else slice(None)
                        data, digest = np.frombuffer(text or b"", np.uint8), hashlib.sha256()
                        joined = _joined(data, starts[keep], ends[keep], None if with_text else digest)
                        if joined is not None:
                            digest.update(joined)
                        rows.append((len(starts), [dict(zip(("start", "length", "period"), r)) for r in runs],
                                     joined, digest.hexdigest()))
                n, found, joined, digest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n, pa.int64()), pa.array(found, _run_struct()),
                     pa.array(joined, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())], list(_KINDS))

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = _KINDS | {"id": source.schema["id"].dataType.simpleString()}
    return source.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the best run, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    start = F.when(F.size("runs") > 0, F.col("runs")[0])
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", start, better))
    return found.withColumn("_best", best).select(
        F.col("id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length",
        "_best.period", F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256")


def looped(ident: Column, text: Column) -> Column:
    """``text`` whose words repeat from word ``a`` on with period ``p``, where 10 divides the CRC-32 of the id.

    With ``g`` a tenth of the CRC and ``n`` words: ``a = g % n``, ``p = 1 + (n - a) // (3 + g % 8)``.  Other
    texts, and those without words, stay as they are.
    """
    crc = F.crc32(ident.cast("string").cast("binary"))
    g = F.floor(crc / 10)
    words_of = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(w, (a + (i - a) % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " "))

    # the array of one element binds the words to a name, so they are split once
    changed = F.transform(F.array(words_of), repeat)[0]
    return F.when(crc % 10 == 0, F.coalesce(changed, text)).otherwise(text)
