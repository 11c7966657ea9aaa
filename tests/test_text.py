import pytest
from pyspark.sql import functions as F

from assayer.functions import arrays as ar, text as tx


def one(spark, column, text="x"):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, expected", [
    ("", []), (None, []), ("Too short.", []),
    ("Dose was raised. It helped them a lot; symptoms went away\nfor a long time",
     ["Dose was raised.", "It helped them a lot", "symptoms went away", "for a long time"]),
    ("Version 2.5 is used here. Next one follows", ["Version 2.5 is used here.", "Next one follows"]),
])
def test_split_claims(spark, text, expected):
    assert one(spark, tx.split_claims("t"), text) == expected


def test_split_sentences_falls_back_to_whole_text(spark):
    assert one(spark, tx.split_sentences("t"), " short one. ") == ["short one."]
    assert one(spark, tx.split_sentences("t"), "  ") == []


def test_split_claims_numbered(spark):
    text = "Intro words here 1. first point made 2. second point made too\n- bullet with words"
    assert one(spark, tx.split_claims_numbered("t"), text) == [
        "Intro words here", "first point made", "second point made too", "bullet with words"]
    assert one(spark, tx.split_claims_numbered("t"), "two words") == ["two words"]


def test_claim_tokens_keep_numbers_and_drop_short_words(spark):
    assert sorted(one(spark, tx.tokens_claim("t"), "Dose 2.5 mg.")) == ["2.5", "dose"]
    assert one(spark, tx.tokens_claim("t"), "no 7") == ["7"]
    assert sorted(one(spark, tx.tokens_claim("t", strict_terms=False), "no mg")) == ["mg", "no"]
    # "not" is a stopword but also a negation, so it survives
    assert one(spark, tx.tokens_claim("t"), "not the") == ["not"]


def test_tokens_alpha(spark):
    assert sorted(one(spark, tx.tokens_alpha("t"), "The DOG saw the dog at 12 o'clock")) == [
        "clock", "dog", "saw"]


@pytest.mark.parametrize("text, stance", [
    ("", "uncertain"), ("Yes, it does", "yes"), ("Yesterday", "uncertain"), ("answer :  no way", "no"),
    ("It's unclear to me", "maybe"), ("There is not enough evidence", "maybe"),
    ("The conclusion is yes.", "yes"), ("I think no", "uncertain"),
])
def test_stance(spark, text, stance):
    assert one(spark, tx.stance_parse("t"), text) == stance


@pytest.mark.parametrize("raw, level, reason", [
    ('x {"support_level":"partial","reason":"r"} y', "partial", "r"),
    ("nothing here", "unknown", "nothing here"),
    ('bad {"support_level": oops}', "unknown", 'bad {"support_level": oops}'),
    ('{"a": {"support_level": "supported"}}', "unknown", '{"a": {"support_level": "supported"}}'),
])
def test_json_judgment(spark, raw, level, reason):
    got = one(spark, tx.json_extract_judgment("t"), raw)
    assert (got["support_level"], got["reason"]) == (level, reason)


def test_json_judgment_reason_is_cut(spark):
    assert len(one(spark, tx.json_extract_judgment("t"), "z" * 400)["reason"]) == 250


@pytest.mark.parametrize("raw, level, safety", [
    ("Fully Supported", "supported", 0), ("partly-supported", "partial", 1),
    ("no support", "unsupported", 1), ("whatever", "unknown", None),
])
def test_support_levels(spark, raw, level, safety):
    assert one(spark, tx.support_normalise("t"), raw) == level
    assert one(spark, tx.support_to_safety(tx.support_normalise("t")), raw) == safety


@pytest.mark.parametrize("raw, label", [
    ("0", 0), (" 1 yes", 1), ("supported", 0), ("not hallucinated, supported", 1), ("?", -1)])
def test_label_extract(spark, raw, label):
    assert one(spark, tx.label_extract_binary("t"), raw) == label


def test_decision_extract(spark):
    assert one(spark, tx.decision_extract("t"), "I say. Decision: NO.") == "no"
    assert one(spark, tx.decision_extract("t"), "maybe so") == "maybe"
    assert one(spark, tx.decision_extract("t"), "yesterday") == "unparsed"


def test_base_id_removes_every_occurrence(spark):
    assert one(spark, tx.base_id("t"), "a_correct_7_student_correct") == "a_7"


def test_length_ratio_floor(spark):
    df = spark.createDataFrame([(None, "a b c d")], "a string, b string")
    row = df.select(tx.length_ratio("a", "b").alias("r"),
                    tx.length_ratio_inverse("a", "b").alias("i")).first()
    assert row["r"] == 0.25 and row["i"] is None


def test_truncation(spark):
    assert one(spark, tx.truncate_ellipsis("t", 3), " abcdef ") == "abc..."
    assert one(spark, tx.truncate_at_space("t", 8, "|"), "abc def ghi") == "abc def|"
    assert one(spark, tx.truncate_at_space("t", 8, "|"), "abcdefghijk") == "abcdefgh|"
    assert one(spark, tx.truncate_flat("t", 5), "ab\ncd\nef") == "ab cd..."


def test_prompt_round_trip(spark):
    from assayer.operators.normalize import evidence_prompt
    df = spark.createDataFrame([("Does it?", "Line one.\nLine two.")], "question string, knowledge string")
    got = df.select(tx.prompt_parse(evidence_prompt()).alias("p")).first()["p"]
    assert (got["question"], got["evidence"], got["matched"]) == (
        "Does it?", "Line one.\nLine two.", True)
    assert one(spark, tx.prompt_parse("t"), "other")["matched"] is False


def test_replace_first_only(spark):
    assert one(spark, tx.replace_first(F.col("t"), F.lit("a"), F.lit("b")), "aXa") == "bXa"
    assert one(spark, tx.replace_first(F.col("t"), F.lit("q"), F.lit("b")), "aXa") is None


def test_whole_word_option(spark):
    assert one(spark, tx.contains_any_term("t", ["men"]), "a treatment") is True
    assert one(spark, tx.contains_any_term("t", ["men"], whole_words=True), "a treatment") is False


def test_nested_text(spark):
    df = spark.createDataFrame([(["a", "b"], 'v"\n]', None)], "l array<string>, v string, n array<string>")
    df = df.withColumn("m", F.create_map(F.lit("k"), "v", F.lit("é"), F.lit(None).cast("string")))
    row = df.select(tx.normalise_nested_list("l").alias("a"), tx.normalise_nested_map("m").alias("b"),
                    tx.normalise_nested_map("m", as_json=False).alias("c"),
                    tx.normalise_nested_list("n").alias("d")).first()
    assert tuple(row) == ("a\nb", '{"k": "v\\"\\n]", "é": null}', 'v"\n]', "")


def test_set_scores(spark):
    df = spark.createDataFrame([([], [], ["a"], ["a", "b"])], "e array<string>, f array<string>, "
                               "a array<string>, b array<string>")
    row = df.select(ar.jaccard("e", "f").alias("both"), ar.jaccard("e", "a").alias("one"),
                    ar.jaccard("a", "b").alias("half"), ar.overlap_score("e", "a").alias("none"),
                    ar.alignment("e", "a").alias("free"), ar.alignment("a", "e").alias("miss")).first()
    assert tuple(row) == (1.0, 0.0, 0.5, 0.0, 1.0, 0.0)


def test_vector_normalise_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r["u"] for r in df.select(ar.vector_normalise("v").alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
