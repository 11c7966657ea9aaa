"""Encoding against the tokenizers library; packing as a whole."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from tokenizers import Tokenizer

from assayer.llm import packing, queries, word_bpe
from assayer.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
ROWS = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
ODD_TEXTS = [None, "", " ", "it's <|endoftext|>AB<|startoftext|>²Ⅻ ΣΣ İ é", "\x1c\x1da_b__!'s", "x" * 30000]


def test_word_table_equals_library(spark):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = ROWS + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    want = {}
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(back.encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (1, 500, word_bpe.FREQUENT):
        out = word_bpe.digests(word_bpe.encode_decode(df, vocabulary("word_bpe_49k.json"), frequent=frequent))
        assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == want


def check_packing(out, size):
    by_sequence = defaultdict(list)
    for r in out:
        assert 1 <= r.length <= size
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_packing_whole_table(spark):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out = queries.op5_best_fit_packing(spark, SF).collect()
    pieces = {(r.doc_id, r.piece): r for r in out}
    n = 0
    for i, text in ROWS:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for k in range((len(ids) + 2047) // 2048):
            r = pieces[i, k]
            part = ids[at:at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
            n += 1
        assert at == len(ids)
    assert n == len(out)
    used = check_packing(out, 2048)
    assert used <= -(-sum(r.length for r in out) // 2048) + 3


def test_plan_places_all_lengths():
    r = random.Random(3)
    for _ in range(60):
        size = r.choice([8, 50, 300])
        counts = {n: r.choice([1, 2, 7, 1000]) for n in r.sample(range(1, size + 1), r.randrange(1, size + 1))}
        got = defaultdict(int)
        for pattern, many in packing.plan(counts, size):
            assert sum(pattern) <= size and many > 0
            for x in pattern:
                got[x] += many
        assert dict(got) == counts


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "b " * 5000 + "<|endoftext|>")],
                               "doc_id long, text string")
    out = packing.pack_documents(df, packing.ranks_path(vocabulary("byte_bpe_50k.json")), size=64).collect()
    check_packing(out, 64)
    assert sum(r.doc_id == 1 for r in out) == 2
    assert packing.pack_documents(df.limit(0), packing.ranks_path(vocabulary("byte_bpe_50k.json"))).count() == 0
