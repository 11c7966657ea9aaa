"""Coding, files and places against plain Python and the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayer.llm import packing, queries, token_files as tf
from assayer.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
RANKS = packing.ranks_path(vocabulary("byte_bpe_50k.json"))


def plain(rows):
    """(id, start, n, crc) in ascending order of id, nulls first, ties in the given order."""
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    at, out = 0, []
    for ident, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((ident, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_values_round_trip(seed):
    r = random.Random(seed)
    pieces = [np.array([r.randrange(1 << r.choice([1, 8, 9, 16, 17, 24, 25, 32])) for _ in range(r.randrange(0, 30))],
                       np.uint32) for _ in range(r.randrange(1, 9))]
    coded = [tf.encode_values(p) for p in pieces]
    for p, (control, data) in zip(pieces, coded, strict=True):
        # by hand: lengths in two bits each, then the low bytes of each value
        size = [max(1, (int(v).bit_length() + 7) // 8) for v in p]
        assert data.tobytes() == b"".join(int(v).to_bytes(n, "little") for v, n in zip(p, size, strict=True))
        assert [c >> 2 * k & 3 for c in control.tolist() for k in range(4)][:len(p)] == [n - 1 for n in size]
    counts = np.array([len(p) for p in pieces])
    back = tf.decode_values(counts, *(np.concatenate(x) for x in zip(*coded, strict=True)))
    assert np.array_equal(back, np.concatenate(pieces))


def test_joined_crc():
    r = random.Random(1)
    parts = [r.randbytes(r.choice([0, 1, 4, 1000, 70_000])) for _ in range(12)]
    assert tf.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_query_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op13_token_files(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == sorted(r[:4] for r in plain(rows))


def test_pieces_blocks_files_and_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "PIECE_IDS", 16)
    monkeypatch.setattr(tf, "BLOCK_IDS", 64)
    monkeypatch.setattr(tf, "FILE_BLOCKS", 3)
    rows = [(i * 7 - 30, f"text {i} " * (i % 40)) for i in range(60)]
    rows += [(None, "no id"), (100_000, None), (100_001, ""), (3, "one two " * 900 + "<|endoftext|>"), (100_002, "ü é 漢字")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumns({"id": tf.F.lit("clash"), "n": tf.F.lit(1), "ids": tf.F.lit(None)})
    path = str(tmp_path / "files")
    tf.write(df, path, RANKS)
    got = sorted(tf.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got] == plain(rows)
    files = spark.read.format("binaryFile").load(f"{path}/ids").collect()
    assert len(files) > 3
    blocks = [b for f in files for b in tf.blocks_of(bytes(f.content))]
    assert all(table["ids"].max() <= 16 and table["ids"].sum() < 64 + 16 for _, table, _, _ in blocks)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["count"] for r in ranks] == sorted((r["count"] for r in ranks), reverse=True)
    content = bytearray(max((bytes(f.content) for f in files), key=len))
    content[tf.HEADER.itemsize + 70] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(tf.blocks_of(bytes(content)))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "same"), (5, "same"), (5, "other words"), (4, "x")], "doc_id long, text string")
    got = sorted(map(tuple, tf.round_trip(df, RANKS).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [4, 5, 5, 5] and len({r[1] for r in got}) == 4
    assert sum(r[2] for r in got) == got[-1][1] + got[-1][2]
    assert tf.round_trip(df.limit(0), RANKS).count() == 0
