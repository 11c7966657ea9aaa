"""Manifests against a plain tree, at sizes around powers of two, with nulls, ties and clashing names."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from assayer.llm import merkle, queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, more=0):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"] and row["n_chars"] + more
              if row["n_chars"] is not None else None, row["text"])
    if row["n_chars"] == 0 and more:
        values = (*values[:3], more, values[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """Root, and each leaf's list of (side, sibling or None) from the leaf up."""
    proofs, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(place):
            other = p ^ 1
            proofs[i].append(("LR"[p % 2 == 0], level[other]) if other < len(level) else ("-", None))
        place = [p // 2 for p in place]
        level = [sha("".join(level[k:k + 2])) for k in range(0, len(level), 2)]
    return level[0], proofs


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    kept = {}
    for g in order:
        mine = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        kept[g] = (mine, *tree([leaf_of(r) for r in mine]))
    root, upper = tree([kept[g][1] for g in order])
    out = []
    for g, above in zip(order, upper, strict=True):
        mine, subroot, proofs = kept[g]
        for r, proof in zip(mine, proofs, strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            fold = leaf_of(r, 1 if changed else 0)
            for side, other in proof + above:
                fold = sha(fold if side == "-" else other + fold if side == "L" else fold + other)
            joined = "".join(x for _, x in proof + above if x)
            out.append((r["doc_id"], leaf_of(r), subroot, root, sha(joined), fold, fold == root))
    return out


def result(spark, df, tmp_path, name="t"):
    df.write.parquet(str(tmp_path / name / "documents.parquet"))
    return list(map(tuple, queries.op12_merkle_manifest(spark, str(tmp_path / name)).collect()))


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_query_whole_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op12_merkle_manifest(spark, SF)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = list(map(tuple, out.collect()))
    assert same(got, plain(rows))
    assert {r[6] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert same(con.execute(queries.ORACLE_SQL["op12_merkle_manifest"]).fetchall(), got)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 16, 17], [4, 5, 33, 64], [65, 1, 130]])
def test_sizes(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    rows = [{"doc_id": i * 3 - 20, "text": f"t{g} {i}", "lang": f"l{g}", "source": None, "n_chars": i}
            for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows],
                               COLUMNS).repartition(3)
    assert same(result(spark, df, tmp_path), plain(rows))


def test_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 3)
    rows = [{"doc_id": i, "text": "x", "lang": f"g{i % 21}", "source": "s", "n_chars": 1} for i in range(100)]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], COLUMNS)
    assert same(result(spark, df, tmp_path), plain(rows))


def test_edges(spark, tmp_path):
    values = [(None, None, None, None, None), (None, "a", None, None, 3), (1, "", "", "", 0), (1, "", "", "", 0),
              (1, "b", "", "s", 1), (2, "é漢" * 5000, "ü", "=", None), (-5, "x", "=", None, 7), (7, "c" * 300_000, "en", "s", 9)]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    df = spark.createDataFrame(values, COLUMNS)
    extra = df.withColumns({c: merkle.F.lit(1) for c in ("id", "tree", "pos", "digest", "row", "claimed", "rank")})
    assert same(result(spark, extra, tmp_path), plain([dict(zip(names, v)) for v in values]))
    assert result(spark, df.limit(0), tmp_path, "empty") == []
