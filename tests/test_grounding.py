import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import terms
from assayer.operators import grounding as gr, retrieval as rt

ROWS = [
    ("a", "The dose increased survival in 12 patients. It did not cause any harm at all.",
     "In 12 patients the dose increased survival and caused no harm.", 0),
    ("b", "", "Evidence text is here and long enough.", 1),
    ("c", None, "Evidence text is here and long enough.", 1),
    ("d", "Mortality risk is reduced without treatment in 30 cases.", None, 1),
    ("e", "tiny. bits.", "Evidence text is here.", 0),
]
SCHEMA = "record_id string, answer string, knowledge string, is_hallucinated int"


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_rollup_keeps_records_without_claims(answers):
    got = {r["record_id"]: r for r in gr.claim_grounding_rollup(answers, ["record_id"]).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    for empty in "bce":
        assert (got[empty]["claim_count"], got[empty]["answer_claim_grounding_score"]) == (0, 0.0)
        assert got[empty]["unsupported_claim_count"] == 0
    assert got["a"]["claim_count"] == 2 and got["d"]["unsupported_claim_count"] == 1


def test_claim_parts_by_hand(answers):
    rows = gr.claim_scores(answers, ["record_id"]).filter("record_id = 'a'").orderBy("claim_index").collect()
    first, second = rows
    # tokens: dose increased survival patients 12 -> all in the evidence
    assert first["claim_token_support"] == 1.0 and first["claim_support_score"] == pytest.approx(1.0)
    # tokens: did, not, cause, any, harm, all -> only "harm" is in the evidence
    assert second["claim_token_support"] == pytest.approx(1 / 6)
    assert second["negation_support"] == 0.0          # "no" is too short to count in the evidence
    assert second["clinical_direction_support"] == 0.0  # cause vs caused
    assert second["contradiction_risk"] is True
    missing = gr.claim_scores(answers, ["record_id"]).filter("record_id = 'd'").first()
    assert missing["claim_token_support"] == 0.0 and missing["unsupported_high_impact_claim"] is True


def test_claim_scores_independent_of_partitioning(answers):
    base = sorted(map(str, gr.claim_scores(answers.repartition(1), ["record_id"]).collect()))
    assert sorted(map(str, gr.claim_scores(answers.repartition(64), ["record_id"]).collect())) == base


def _grams(text, stop):
    words = [w for w in re.findall(r"[a-z0-9_]{2,}", text.lower()) if w not in stop]
    return words + [" ".join(p) for p in zip(words, words[1:])]


def _brute(claim, sentences, stop):
    """The textbook definition: fit on {claim} + sentences, cosine, arg-max."""
    docs = [_grams(t, stop) for t in [claim, *sentences]]
    vocab = sorted({g for d in docs for g in d})
    tf = np.array([[d.count(g) for g in vocab] for d in docs], float)
    idf = np.log((1 + len(docs)) / (1 + (tf > 0).sum(0))) + 1
    m = tf * idf
    norm = np.linalg.norm(m, axis=1)
    cos = [round(float(m[0] @ m[i] / (norm[0] * norm[i])), 12) if norm[0] * norm[i] else 0.0
           for i in range(1, len(docs))]
    return max(cos), sentences[int(np.argmax(cos))]


def test_tfidf_against_definition(spark):
    from assayer.functions import text as tx
    texts = [("r%d" % i, " ".join(
        f"word{(i * j) % 7} common term{(j * j) % 5} more filler{j % 3}." for j in range(1, 9)),
        " ".join(f"common word{(i + j) % 6} and term{j % 4} in this place{j}." for j in range(1, 7)))
        for i in range(1, 6)]
    df = spark.createDataFrame(texts, "record_id string, answer string, knowledge string")
    stop = ["and", "in", "this"]
    got = gr.claim_best_sentence_tfidf(df, ["record_id"], stopwords=stop).collect()
    sentences = {r["record_id"]: r["s"] for r in df.select(
        "record_id", tx.split_sentences("knowledge").alias("s")).collect()}
    assert len(got) == 40
    for r in got:
        score, best = _brute(r["claim_text"], sentences[r["record_id"]], stop)
        assert r["semantic_claim_support_score"] == pytest.approx(score, abs=1e-9)
        assert r["best_evidence_sentence"] == best


def test_tfidf_words_of_any_script(spark):
    """``niño`` is one word: it matches itself, not a shared beginning, and not letter by letter."""
    rows = [("a", "Niño enfermo estaba hoy.", "Nike enferma vino ayer. Niño enfermo estaba hoy."), ("b", "Größe größe größe größe.", "Gr e gr e gr e gr e.")]
    df = spark.createDataFrame(rows, "record_id string, answer string, knowledge string")
    got = {r["record_id"]: r for r in gr.claim_best_sentence_tfidf(df, ["record_id"], stopwords=[]).collect()}
    assert got["a"]["semantic_claim_support_score"] == pytest.approx(1.0)
    assert got["a"]["best_evidence_sentence"] == "Niño enfermo estaba hoy."
    assert got["b"]["semantic_claim_support_score"] == 0.0


def test_pieces_and_words_in_bytes_are_those_of_the_expressions(spark):
    """Claims, sentences and words cut in bytes are what ``split_claims``, ``split_sentences`` and the patterns find."""
    from assayer.functions import text as tx
    from assayer.operators import claims as cl
    draw = np.random.default_rng(4)
    parts = ["alpha", "the", "1.2.3", "3.5", "x", "é", "Niño", "İs", "ΣΑΣ", "中文字", "a_b", "—", "\u00a0", "😀", ".", "!", "?", ";", "\x1c", "\u0085",
             " ", "  ", "\n", ". ", "; ", ";\n", "\t", " ; ", "? ; ", ".\r\n"]
    texts = [None, "", " ", ";", "; ", "short; ", " a long enough text;", "no break\u00a0here"] + [
        "".join(draw.choice(parts, draw.integers(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "t", cl.bare("t").alias("b"), tx.split_claims("t").alias("claims"), tx.split_sentences("t").alias("sentences"),
        tx.claim_words("t").alias("tokens"), tx.claim_words("t", False).alias("any"),
        F.regexp_extract_all(F.lower(tx.text_of("t")), F.lit(terms.WORD_OF_TWO), F.lit(0)).alias("words")).orderBy("i").collect()
    import pyarrow as pa
    column = lambda c: pa.array([r[c] or "" for r in rows], pa.string())
    own, plain = cl.Texts(column("t")), cl.Texts(column("b"))
    owned = lambda bounds, found: [[t for t, o in zip(found.to_pylist(), own.owner(bounds[0])) if o == k] for k in range(len(rows))]
    claims = np.flatnonzero(own.lengths() >= tx.CLAIM_LENGTH)
    bounds = own.kept(claims)
    assert owned(bounds, own.take(*bounds, np.arange(len(claims)))) == [r["claims"] for r in rows]
    long = np.flatnonzero(own.lengths() >= tx.SENTENCE_LENGTH)
    alone = np.flatnonzero(~np.isin(np.arange(len(rows)), own.owner(own.starts[long])) & (own.last > own.first))
    bounds = own.kept(long, alone)
    assert owned(bounds, own.take(*bounds, np.arange(len(bounds[0])))) == [r["sentences"] for r in rows]
    assert len(plain.starts) == len(own.starts)
    words, whole = cl.Words(plain.data), (plain.cuts[:-1], plain.cuts[1:])
    for found, name, flagged in ((words.tokens(True, *whole), "tokens", True), (words.tokens(False, *whole), "any", True),
                                 (words.words(*whole), "words", False)):
        assert found[0].tolist() == [len(r[name]) for r in rows]
        assert (found[1] == cl.word_hashes([w for r in rows for w in r[name]], flagged)).all()


def test_tfidf_without_evidence(spark):
    df = spark.createDataFrame([("x", "A claim of some length.", "")], "record_id string, answer string, knowledge string")
    row = gr.claim_best_sentence_tfidf(df, ["record_id"]).first()
    assert (row["semantic_claim_support_score"], row["best_evidence_sentence"]) == (0.0, "")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50:90] = v[7]                      # many exact copies
    record = np.where(np.arange(300) % 3 == 0, 0, np.arange(300) % 5)   # one hot record
    rows = [(int(record[i]), i, v[i].tolist()) for i in range(300)]
    return v, record, spark.createDataFrame(rows, "record_id int, item bigint, embedding array<double>")


@pytest.mark.parametrize("block", [7, 2048])
def test_vector_match_in_tiles(vectors, block):
    v, record, df = vectors
    claims = df.filter("item % 2 = 0").withColumnRenamed("item", "claim_id")
    evidence = df.filter("item % 2 = 1").withColumnRenamed("item", "evidence_id")
    got = gr.best_vector_match(claims, evidence, block=block).collect()
    assert len(got) == 150
    for r in got:
        pool = [j for j in range(1, 300, 2) if record[j] == r["record_id"]]
        assert r["similarity"] == pytest.approx(max(float(v[r["claim_id"]] @ v[j]) for j in pool))


@pytest.mark.parametrize("options", [{}, {"block_rows": 9, "rows_at_once": 16}, {"cell_rows": 5}, {"cell_rows": 40}])
def test_topk_against_brute_force(vectors, options):
    v, _, df = vectors
    df = df.select(F.col("item").alias("vec_id"), "embedding")
    queries, corpus = df.filter("vec_id % 10 = 0"), df.filter("vec_id % 10 != 0").repartition(5)
    got = {}
    cells = options.pop("cell_rows", None)
    index = rt.bound_index(corpus, cell_rows=cells) if cells else None
    for r in rt.topk_retrieve(queries, corpus, k=3, guard=0.5, index=index, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["record_id"], r["similarity_score"]))
    for q in range(0, 300, 10):
        scored = sorted(((-round(float(v[q] @ v[j]), 12), j) for j in range(300) if j % 10), )
        want = [(j, round(-s, 3)) for s, j in scored if -s >= 0.5][:3]
        have = got.get(q, [])
        assert [j for j, _ in have] == [j for j, _ in want]
        assert [s for _, s in have] == pytest.approx([s for _, s in want])


def test_guard_boundary_is_kept(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    c = spark.createDataFrame([(5, [0.7, 0.0]), (6, [0.69, 0.0])], "vec_id bigint, embedding array<double>")
    assert [r["record_id"] for r in rt.topk_retrieve(q, c).collect()] == [5]
    status = rt.retrieval_status(q, rt.topk_retrieve(q, c, guard=0.9)).first()
    assert (status["status"], status["sources"]) == ("no_relevant_evidence", 0)


def _frame(spark, m):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<double>")


def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_bounds_hold_for_any_vectors():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 12)) * rng.uniform(0, 3, size=(400, 1))
    pivots = _unit(m[:9])
    near = m @ pivots.T
    cell, along = near.argmax(1), near.max(1)
    across = np.sqrt(np.maximum((m * m).sum(1) - along * along, 0))
    known = np.array([(c, along[cell == c].min(), along[cell == c].max(), across[cell == c].max(), (cell == c).sum())
                      for c in np.unique(cell)])
    q = rng.normal(size=(50, 12)) * 2
    bound, products = rt.cell_bounds(q, pivots, known), q @ m.T
    for i, c in enumerate(known[:, 0]):
        assert (products[:, cell == c].max(1) <= bound[:, i]).all()


@pytest.mark.parametrize("scaled", [False, True])
def test_pruned_search_equals_all_pairs_and_skips_most(spark, scaled):
    """Clusters, copies, ties, a null, a zero vector and (scaled) any lengths; the guard below what is found."""
    rng = np.random.default_rng(6)
    centres = _unit(rng.normal(size=(20, 16)))
    m = _unit(centres[rng.integers(20, size=900)] + 0.05 * rng.normal(size=(900, 16)))
    if scaled:
        m *= rng.uniform(0.5, 1.5, size=(900, 1))
    m[40:60] = m[3]
    m[70] = 0
    corpus = _frame(spark, m).unionByName(spark.createDataFrame([(5000, None)], "vec_id long, embedding array<double>"))
    queries = _frame(spark, m).filter("vec_id % 7 = 0")
    index = rt.bound_index(corpus, cell_rows=30)
    for guard in (0.2, 0.9):
        got = rt.topk_retrieve(queries, corpus, guard=guard, index=index, digits=9)
        want = rt.topk_retrieve_all(queries, corpus, guard=guard, digits=9)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        share = rt.bound_share(queries, index, guard=guard).first()
        assert share["pairs"] == pytest.approx(share["share"] * queries.count() * 900)
        assert share["share"] < (0.7 if scaled else 0.4)


def test_empty_sides_of_the_pruned_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert rt.topk_retrieve(df.limit(0), df).count() == 0
    assert rt.topk_retrieve(df, df.filter("vec_id > 1")).count() == 0
    assert rt.topk_retrieve(df, df.withColumn("embedding", F.lit(None).cast("array<double>"))).count() == 0


@pytest.mark.parametrize("noise", [0.35, 3.0])
def test_calibrated_probes_reach_their_target(spark, noise):
    """Close and far neighbours: the number of probes follows from a measurement on other rows."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1200, 32))
    near = base[:400] + noise * rng.normal(size=(400, 32))
    q, c = _frame(spark, _unit(near)), _frame(spark, np.concatenate([_unit(base), _unit(near)]))
    centres = rt.fit_cells(c)
    assert 0.8 * rt.cell_count(1600) <= len(centres) <= 1.2 * rt.cell_count(1600)
    probes = rt.calibrate_probes(c, centres, guard=0.4)
    found = rt.topk_retrieve_cells(q, c, centres, guard=0.4, probes=probes)
    recall = rt.retrieval_recall(found, rt.topk_retrieve(q, c, guard=0.4)).first()
    assert recall["expected"] >= 400 and recall["recall"] >= 0.9
    share = rt.candidate_share(q, c, centres, probes=probes).first()["share"]
    assert share < (0.45 if noise < 1 else 0.7)


def test_cells_grow_with_the_table(spark):
    assert [rt.cell_count(n) for n in (0, 1, 100, 10_000, 10**6, 10**12)] == [1, 2, 20, 200, 2000, 16_384]
    assert len(rt.fit_cells(_frame(spark, np.ones((0, 4))))) == 1
    one = _frame(spark, np.ones((3, 4)))
    assert rt.topk_retrieve_cells(one, one, rt.fit_cells(one), probes=1).count() == 9


def test_text_ids_and_evidence(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", None)], "id string, embedding array<double>")
    c = spark.createDataFrame([("b", [1.0, 0.0], "of b"), ("a", [1.0, 0.0], "of a"), ("c", None, "of c")],
                              "id string, embedding array<double>, text string")
    found = rt.with_evidence(rt.topk_retrieve(q, c, query_id="id", corpus_id="id"), c, "id", ["text"])
    assert [(r["query_id"], r["rank"], r["record_id"], r["text"]) for r in found.orderBy("rank").collect()] == [
        ("q1", 1, "a", "of a"), ("q1", 2, "b", "of b")]
    claims = q.select(F.lit(1).alias("record_id"), F.col("id").alias("claim_id"), "embedding").filter("claim_id = 'q1'")
    evidence = c.filter("text <> 'of c'").select(F.lit(1).alias("record_id"), F.col("id").alias("evidence_id"), "embedding")
    assert gr.best_vector_match(claims, evidence).first()["evidence_id"] == "a"


def test_vector_grounding_branches(spark):
    vec = lambda *x: list(map(float, x))
    records = spark.createDataFrame([(1,), (2,), (3,)], "record_id int")
    claims = spark.createDataFrame(
        [(1, 10, True, vec(1, 0)), (1, 11, True, vec(0, 1)), (2, 20, True, vec(1, 0))],
        "record_id int, claim_id int, high_impact boolean, embedding array<double>")
    evidence = spark.createDataFrame([(1, 90, vec(1, 0))],
                                     "record_id int, evidence_id int, embedding array<double>")
    got = {r["record_id"]: r for r in gr.evidence_grounding_vec(records, claims, evidence).collect()}
    assert (got[1]["semantic_grounding_score"], got[1]["minimum_claim_grounding_score"]) == (0.5, 0.0)
    assert (got[1]["grounded_claim_count"], got[1]["unsupported_high_impact_claim_count"]) == (1, 1)
    assert (got[2]["claim_count"], got[2]["unsupported_claim_count"]) == (1, 1)   # no evidence
    assert (got[3]["claim_count"], got[3]["semantic_grounding_score"]) == (0, 0.0)  # no claims


def test_weights_sum_to_one():
    assert math.isclose(sum(terms.CLAIM_WEIGHTS.values()), 1.0)


def test_rows_and_cells_leave_a_task_in_bounded_parts(monkeypatch):
    """However many cells a row meets: neither a matrix nor the copied vectors of a batch are held whole."""
    import pandas as pd
    monkeypatch.setattr(rt, "PART_NUMBERS", 100)
    monkeypatch.setattr(rt, "PART_ROWS", 7)
    rows = pd.DataFrame({"_qid": range(35), "_qv": [[float(i)] for i in range(35)]})
    parts = list(rt._parts(iter([rows, rows.iloc[:0]]), 10))
    assert [len(p) for p in parts] == [10, 10, 10, 5] and pd.concat(parts).equals(rows)
    assert [len(p) for p in rt._parts(iter([rows]), 1000)] == [1] * 35
    at, cells = np.repeat(np.arange(35), 3), np.tile([4, 5, 6], 35)
    out = list(rt._repeated(rows, at, cells))
    assert max(map(len, out)) == 7
    whole = pd.concat(out)
    assert whole["_qid"].tolist() == at.tolist() and whole["_cell"].tolist() == cells.tolist()


def test_a_query_travels_once_per_group_of_cells(spark):
    """150 cells are three groups; hits and share are those of single cells by definition."""
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    m, centres, probes = unit(rng.normal(size=(300, 8))), unit(rng.normal(size=(150, 8))), 40
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    near = np.argsort(-(m @ centres.T), axis=1, kind="stable")
    met = np.array([[near[j, 0] in near[i, :probes] for j in range(300)] for i in range(300)])
    score = np.where(met, np.round(m @ m.T, 12), -1.0)
    want = {(i, n + 1, j) for i in range(300) for n, j in enumerate(np.lexsort((np.arange(300), -score[i]))[:3]) if score[i, j] >= 0.5}
    got = rt.topk_retrieve_cells(df, df, centres, guard=0.5, probes=probes, block_rows=64).collect()
    assert {(r["query_id"], r["rank"], r["record_id"]) for r in got} == want and len(got) == len(want)
    assert rt.candidate_share(df, df, centres, probes=probes).first()["pairs"] == met.sum()
    assert rt._in_groups(df, "embedding", centres, probes).groupBy("vec_id").count().agg(F.max("count")).first()[0] == 3
