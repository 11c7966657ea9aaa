"""The retrieval queries on tables of a test's own: every vector is searched for."""

import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """120 vectors around eight directions (none has a number divisible by 20), one without a vector, two documents."""
    at = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(3)
    m = rng.normal(size=(8, 16))[np.arange(120) % 8] + 0.4 * rng.normal(size=(120, 16))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")
    ids = [i + i // 19 + 1 for i in range(120)]
    rows = [(k, [float(x) for x in v], int(k % 8)) for k, v in zip(ids, m)] + [(1001, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)],
                          "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        f"{at}/documents.parquet")
    assert not [k for k in ids if k % 20 == 0]
    return str(at), ids, m.astype(float)


def _best(q, c, ids, guard):
    """Top three rows of each query by (score, id)."""
    score = np.round(q @ c.T, 12)
    return [sorted((j for j in np.nonzero(s >= guard)[0]), key=lambda j: (-s[j], ids[j]))[:3] for s in score]


def test_every_vector_is_a_query(spark, own):
    path, ids, m = own
    texts = [f"e{k}" for k in ids]
    want = {(f"q{k}", n + 1, texts[j]) for k, best in zip(ids, _best(m, m, texts, 0.30)) for n, j in enumerate(best)}
    got = entry.queries()["topk_retrieve"](spark, path).collect()
    assert len(got) == len(want) and {(r["query_id"], r["rank"], r["record_id"]) for r in got} == want
    assert {r["evidence"] for r in got if r["record_id"] in ("e1", "e2")} == {"a", "b"}


def test_every_vector_has_a_status(spark, own):
    path, ids, m = own
    score = np.round(m @ m.T, 12)
    got = {r["query_id"]: r for r in entry.queries()["retrieval_status"](spark, path).collect()}
    assert set(got) == {f"q{k}" for k in [*ids, 1001]}
    for k, s in zip(ids, score):
        assert got[f"q{k}"]["status"] == "matched" and got[f"q{k}"]["sources"] == min(3, (s >= 0.30).sum())
        assert got[f"q{k}"]["best_similarity"] == pytest.approx(s.max(), abs=6e-4)
    assert got["q1001"]["status"] == "no_relevant_evidence" and got["q1001"]["sources"] == 0


def test_recall_is_measured_for_every_vector(spark, own):
    """All given rows at the lower guard, and a query near each of them at the default one."""
    path, ids, m = own
    at = {k: i for i, k in enumerate(ids)}
    near = np.stack([m[i] + 0.6 * m[at[k + 1]] if k + 1 in at else m[i] for i, k in enumerate(ids)])
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    got = entry.queries()["topk_retrieve_lsh"](spark, path).first()
    assert got["expected"] == sum(map(len, _best(m, m, ids, 0.30)))
    assert got["near_expected"] == sum(map(len, _best(near, m, ids, 0.70)))
    assert got["recall_reached"]
