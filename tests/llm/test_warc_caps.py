"""Archives read back byte by byte; vector links against all pairs."""

import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from assayer.llm import caps, queries, warc

SF = "/root/testdata/sf0.01"


def index_of(rows):
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        refers = first.get(data) if i is not None and first.get(data, i) < i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archives_of_whole_table(spark):
    rows = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    assert sorted(map(tuple, queries.op6_warc(spark, SF).collect()), key=str) == index_of(rows)


def test_archive_bytes_and_edges(spark, tmp_path):
    long = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\n" * 9000
    rows = [(1, None), (2, ""), (3, "a\r\n\r\n\n"), (4, long), (5, long), (3, "a\r\n\r\n\n"), (None, long), (6, "é" * 50),
            (7, "é" * 50), (8, "é" * 49), (9, "é" * 49), (10, "x" * 200_000), (11, "\n" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("payload", F.lit("clash"))
    warc.write(df.coalesce(2), str(tmp_path / "w"))
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, warc.index(chunks, "bigint").collect()), key=str) == index_of(rows)
    assert chunks.filter("chunk > 0").count() > 2
    whole = defaultdict(set)
    for r in warc.assemble(chunks).collect():
        whole[r.target].add(bytes(r.payload).decode())
    assert whole["4"] == {long} and whole["3"] == {"a\r\n\r\n\n"} and whole["11"] == {"\n" * 70_000}
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_without_line_feeds_are_cut(spark, tmp_path):
    one, wide = "x" * 1_000_000, "aé" * 300_000
    mixed = "\n" + "y" * 300_000 + "\n" + "z" * 10 + "\n" * 140_000 + "w" * (2 * warc.CHUNK) + "\r\n"
    edge = "v" * (2 * warc.CHUNK) + "\n" + "u" * (2 * warc.CHUNK + 1)
    rows = [(1, one), (2, wide), (3, mixed), (4, edge), (5, one), (6, "short")]
    df = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    assert max(map(len, raw.split(b"\n"))) <= 2 * warc.CHUNK + 1
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    assert chunks.agg(F.max(F.octet_length("bytes"))).first()[0] <= 2 * warc.CHUNK + 1
    assert sorted(map(tuple, warc.index(chunks, "bigint").collect()), key=str) == index_of(rows)
    whole = {r.target: bytes(r.payload).decode() for r in warc.assemble(chunks).collect()}
    assert whole == {str(i): html for i, html in rows if i != 5}
    # as any reader of the format would: by lengths alone, segments put behind their origin
    at, found = 0, defaultdict(bytes)
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
        at = end + 4 + int(head[b"Content-Length"])
        found[head.get(b"WARC-Segment-Origin-ID", head[b"WARC-Record-ID"])] += raw[end + 4:at]
        assert raw[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert sorted(found.values()) == sorted(html.encode() if i != 5 else b"" for i, html in rows)


def brute(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    m = np.array([good[i] for i in ids])
    linked = m @ m.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min(label[k], label[linked[k]].min(initial=label[k])) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    out = {i: (0, i) for i, _ in rows}
    out.update({i: (int(linked[k].sum()), ids[label[k]]) for k, i in enumerate(ids)})
    return out


def test_links_of_whole_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op7_embedding_near_dedup(spark, SF).collect()}
    assert got == brute(rows)


def test_recall_and_tiles(spark):
    r = np.random.default_rng(8)
    centre = r.standard_normal((40, 64))
    v = np.repeat(centre, 30, 0) + r.standard_normal((1200, 64)) * 0.2
    v[:100] = v[0] + r.standard_normal((100, 64)) * 0.05
    v[100:120] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("many", F.lit(1))
    want = brute(rows)
    got = {x.vec_id: (x.n_links, x.component_id) for x in caps.near_duplicates(df, tile=16).collect()}
    found, every = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.98 * every  # most of these pairs lie between 0.95 and 0.96


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1e300, 1e290]), (9, [1.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.vec_id or 0, x.n_links, x.component_id) for x in caps.near_duplicates(df).collect())
    assert len(got) == len(rows)
    same = [g for g in got if g[0] in (1, 2, 8)]
    assert same == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (8, 3, 1)]
    assert all(n == 0 for i, n, _ in got if i not in (1, 2, 8))
    assert caps.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_an_id_and_lengths_have_results_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (2, None), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0]),
            (5, [5.0]), (6, [7.0]), (7, [0.0, 2.0, 0.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in caps.near_duplicates(df).collect()), key=str)
    assert got == sorted([
        (1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False),
        (5, 1, 5, True), (6, 1, 5, False), (7, 2, 3, False), (8, 1, 8, True), (8, 1, 8, False), (0, 0, None, None)], key=str)


def test_archives_are_not_cut_inside_records(spark):
    rows = [(i, "u", "<p>line</p>\n" * (i % 50) + f"page {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        got = {r.page_id: r.payload_digest for r in warc.round_trip(df).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, t in rows}
