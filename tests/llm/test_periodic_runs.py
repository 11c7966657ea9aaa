"""Runs against a plain definition, on random words, planted runs, long words and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from assayer.llm import periodic_runs as pr, queries, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """(start, length, smallest period) of every maximal stretch, by direct comparison at every lag."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        at = 0
        while at + q < len(w):
            if w[at] != w[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end + q - at >= max(24, 3 * q):
                found.setdefault((at, end + q - at), q)  # ascending lags: the smallest stays
            at = end
    # a stretch with a smaller period lies within a run of that period
    return sorted((s, n, q) for (s, n), q in found.items()
                  if not any(q % p == 0 and p < q and s2 <= s and s + n <= s2 + n2 for (s2, n2), p in found.items()))


def plain_row(text):
    w = WORD.findall(text or "")
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    if runs:
        s, n, q = runs[0]
        for r in runs:
            if r[1] * q > n * r[2]:
                s, n, q = r
        best = (s, n, q, 1000 * n // q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def plain_looped(ident, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(ident).encode())
    if h % 10 or not w or ident is None:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def find(codes):
    return [(s, e - s, q) for s, e, q in pr.find_runs(words.mix(np.array(codes, np.uint64))).tolist()]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_definition(seed):
    r = random.Random(seed)
    parts = []
    for _ in range(r.randrange(1, 6)):
        kind = r.choice("random loop few mixed".split())
        alphabet = r.choice([2, 3, 50])
        block = [r.randrange(alphabet) for _ in range(r.randrange(1, 90))]
        if kind == "loop":
            size = int(len(block) * r.choice([2.9, 3, 3.01, 4.5, 9]))
            block = [block[i % len(block)] for i in range(size)]
        elif kind == "few":
            block = block * r.randrange(1, 5)
        elif kind == "mixed":  # a loop whose period holds loops
            inner = block[:7] * r.randrange(3, 9) + [99]
            block = inner * r.randrange(2, 5)
        parts += block
    assert find(parts) == sorted(plain_runs(parts), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 12, 13, 18, 19, 27, 28, 41, 90, 91, 137, 400])
def test_every_period_is_covered(period):
    block = [1000 + i for i in range(period)]
    for length in (max(24, 3 * period) - 1, max(24, 3 * period), 3 * period + 25, 10 * period + 30):
        w = [5, 6, 7] + [block[i % period] for i in range(length)] + [8, 9]
        want = [(3, length, period)] if length >= max(24, 3 * period) else []
        assert find(w) == want


def test_one_word_many_times():
    assert find([4] * 5000) == [(0, 5000, 1)]
    assert find([4] * 23) == []


def test_collision_of_range_hashes_is_walked(monkeypatch):
    monkeypatch.setattr(pr._Prefix, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
    block = list(range(100, 120))
    w = [1, 2] + block * 4 + [3]
    assert find(w) == [(2, 80, 20)]


def test_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: plain_row(plain_looped(d.doc_id, d.text)) for d in docs}
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert any(v[0] for v in want.values())


def test_edges(spark):
    long_word = "x" * (3 * words.SLICE_BYTES)
    texts = [None, "", " \t\n", "a", "a " * 30, ("b c\n" * 12) + "d", "é ü " * 20, " ".join([long_word, "y"] * 12),
             "same text " * 20, "same text " * 20]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "n " * 40, "y"), (3, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumnsRenamed(
        {"id": "n_words"}).withColumn("runs", pr.F.lit(1))
    got = sorted((repr(r.doc_id), tuple(r)[1:]) for r in pr.digests(pr.periodic_runs(df, with_text=False)).collect())
    assert got == sorted((repr(i), plain_row(t)) for i, t, _ in rows)
    out = {r.id: r for r in pr.periodic_runs(df.filter("doc_id in (4, 5)")).collect()}
    assert out[4].text == "a" and [tuple(x) for x in out[4].runs] == [(0, 30, 1)]
    assert out[5].text == "b c d" and out[5].n_words == 25
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_words_of_any_length():
    for text in (b"", b" ", b"a", b"x" * 5_000_000, b"ab " + b"y" * words.SLICE_BYTES + b" z", b"q " * 1_200_000):
        found, starts, ends = words.locate(text)
        parts = text.split()
        assert [text[s:e] for s, e in zip(starts[:5], ends[:5])] == parts[:5] and len(found) == len(parts)
        one = np.frombuffer(text, np.uint8)
        assert np.array_equal(found, words.hash_words(one, starts, ends, False))


def test_looped_texts(spark):
    """Nulls, empty texts and any lengths under ids that 10 divides, and under others."""
    chosen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12] + [1, 2]
    texts = [None, "", " \t", "one", "a b", " a\tb\nc ", "é ü x y z", "a\x0bb\x0cc\rd"] + [
        " ".join(f"w{j}" for j in range(n)) for n in (7, 30, 100, 333)] + ["left alone", None]
    rows = list(zip(chosen, texts, strict=True)) + [(None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = df.withColumn("text", pr.looped(pr.F.col("doc_id"), pr.F.col("text"))).collect()
    for (i, text), r in zip(rows, out, strict=True):
        want = plain_looped(i, text) if i is not None else text
        assert WORD.findall(r.text or "") == WORD.findall(want or "")
