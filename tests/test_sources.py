import json

import pytest

from assayer.sources import readers, schemas, writers

QA = schemas._schema("record_id string, answer string, is_hallucinated int")


def test_jsonl_skips_blank_lines_and_rejects_bad_ones(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"record_id": "007", "answer": "x", "is_hallucinated": 1}\n\n'
                    '{"record_id": "8", "answer": "y", "is_hallucinated": 0}\n')
    assert sorted(r["record_id"] for r in readers.read_jsonl(spark, str(good), QA).collect()) == ["007", "8"]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"record_id": "1"\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad), QA).collect()


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes('﻿answer,record_id,is_hallucinated\n"two\nlines, ""quoted""",007,1\n  kept ,8,0\n'.encode())
    got = {r["record_id"]: r["answer"] for r in readers.read_csv_typed(spark, str(f), QA).collect()}
    assert got == {"007": 'two\nlines, "quoted"', "8": "  kept "}
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_csv_typed(spark, str(f), schemas._schema("other string"))


def test_headerless_pairs(spark, tmp_path):
    f = tmp_path / "prompts.csv"
    f.write_text('only one\n,"second  cell",third,fourth\n , \na,"b\nc"\n')
    got = sorted((r["prompt_a"], r["prompt_b"], r["prompt_type"], r["dataset_name"])
                 for r in readers.read_headerless_pairs(spark, str(f)).collect())
    assert got == [("a", "b c", "paired_prompt", "prompts"), ("only one", "", "single_prompt", "prompts"),
                   ("second cell", "third", "paired_prompt", "prompts")]


def test_headerless_rows_of_any_width(spark, tmp_path):
    wide = [""] * 200
    wide[70], wide[199] = "first", "second"
    (tmp_path / "w.csv").write_text(",".join(wide) + "\nsame,pair\nsame,pair\n" + '"' + "x" * 200_000 + '"\n')
    got = {r["source_row_id"]: r for r in readers.read_headerless_pairs(spark, str(tmp_path / "w.csv")).collect()}
    assert (got[0]["prompt_a"], got[0]["prompt_b"]) == ("first", "second")
    assert got[1]["prompt_a"] == got[2]["prompt_a"] and len({r["record_id"] for r in got.values()}) == 4
    assert len(got[3]["prompt_a"]) == 200_000


def test_object_map(spark, tmp_path):
    doc = {"1": {"QUESTION": "q", "CONTEXTS": ["a", "b"], "final_decision": "yes"},
           "02": {"QUESTION": "p", "CONTEXTS": [], "final_decision": "no"}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    got = {r["record_id"]: (r["QUESTION"], r["CONTEXTS"], r["final_decision"])
           for r in readers.read_object_map_json(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"1": ("q", ["a", "b"], "yes"), "02": ("p", [], "no")}


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "parquet"])
def test_write_and_read_any_format(spark, tmp_path, fmt):
    df = spark.createDataFrame([("007", 'x "y"\nz', 1), ("8", " pad ", None)], QA)
    path = str(tmp_path / f"t.{fmt}")
    writers.write_table(df, path, fmt)
    assert sorted(map(tuple, readers.read_any_format(spark, path, QA).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        readers.read_any_format(spark, "x.xlsx", QA)


def test_optional_source(spark, tmp_path):
    fallback = spark.createDataFrame([("1", "f", 0)], QA)
    missing = str(tmp_path / "none.parquet")
    assert readers.optional_source(spark, missing, QA).count() == 0
    assert readers.optional_source(spark, missing, QA, fallback).count() == 1


def test_arrays_are_joined_only_for_csv(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"],)], "r array<string>")
    writers.write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["r"] == "a; b"
    writers.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["r"] == ["a", "b"]


def test_log_schema():
    assert schemas.CASE_LOG.fieldNames()[0] == "logged_at"
