"""Records of split files against Python's csv module."""

import csv
import io
import json
import random

import pytest

from assayer.sources import readers, schemas
from assayer.sources.split_csv import csv_records, scan_line

PIECES = ["a", "bc", '"', '""', ",", "\n", "\r\n", "\r", " ", "é", "long word ", '"x\ny"', '"q""q",', '\n"', ',"']


def python_rows(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.fixture
def split_bytes(spark):
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)

    def use(n):
        spark.conf.set(key, str(n))
        spark.conf.set(cost, "1")
    yield use
    spark.conf.set(key, before[0])
    spark.conf.set(cost, before[1])


def test_lines_end_inside_as_the_module_says():
    for line, inside, want in [('a,b', False, False), ('a,"b', False, True), ('a"b', False, False), ('"a""', False, True),
                               ('x"', True, False), ('x"",', True, True), ('"a"b"c', False, False), ('"a"b,"c', False, True)]:
        assert scan_line(line, inside)[0] is want
    assert scan_line('a\rb,"c\rd"\re', False) == (False, [2, 10])


@pytest.mark.parametrize("seed,size", [(0, 13), (2, 60), (4, 1 << 20)])
def test_records_at_any_split(spark, tmp_path, split_bytes, seed, size):
    r = random.Random(seed)
    texts = {}
    for k in range(2):
        text = "".join(r.choice(PIECES) for _ in range(r.choice([0, 3, 60, 90])))
        text += "\n"
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        texts[f"f{k}.csv"] = python_rows(text)
    split_bytes(size)
    rows = csv_records(spark, str(tmp_path)).collect()
    got = {}
    for row in sorted(rows, key=lambda x: (x["source_path"], x["source_row_id"])):
        got.setdefault(row["source_path"].rsplit("/", 1)[1], []).append((row["source_row_id"], row["record"]))
    for name, want in texts.items():
        have = got.get(name, [])
        assert [i for i, _ in have] == list(range(len(want)))
        cells = [c for _, record in have for c in python_rows(record)]
        if cells != want:  # a cell that is never closed ends without the last line break
            want[-1][-1] = want[-1][-1].removesuffix("\n")
        assert cells == want


def test_one_file_is_read_by_several_tasks(spark, tmp_path, split_bytes):
    rows = [[f"id{i}", f"first line {i}\nsecond, \"line\" {i}\n" + "x" * (i % 90), str(i)] for i in range(200)]
    out = io.StringIO()
    csv.writer(out).writerows([["record_id", "answer", "is_hallucinated"], *rows])
    (tmp_path / "one.csv").write_text(out.getvalue(), newline="")
    split_bytes(1500)
    assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 8
    schema = schemas._schema("is_hallucinated int, record_id string, answer string")
    got = readers.read_csv_typed(spark, str(tmp_path / "one.csv"), schema)
    assert sorted(map(tuple, got.collect())) == sorted((int(c), a, b) for a, b, c in rows)
    pairs = readers.read_headerless_pairs(spark, str(tmp_path / "one.csv"))
    assert pairs.count() == 201 and pairs.select("source_row_id").distinct().count() == 201


def test_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv_typed(spark, str(tmp_path), schemas._schema("x string"))


def test_empty_cells_are_null_and_short_rows_filled(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n,"",3\n1\n"a ""b""",2,3\n')
    got = readers.read_csv_typed(spark, str(tmp_path / "a.csv"), schemas._schema("x string, y string, z int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, 3), ("1", None, None), ('a "b"', "2", 3)], key=str)


@pytest.mark.parametrize("indent,size", [(None, 90), (2, 300), (None, 1 << 20)])
def test_entries_of_one_large_document(spark, tmp_path, split_bytes, indent, size):
    """Braces, quotes and backslashes in texts, nested objects, an empty document, two documents in a file."""
    r = random.Random(size)
    odd = ["plain", "{", "}", "}}{{", '"', "\\", '\\"}', "a\nb", "é}", "", ',{"x": 1}']
    docs = [{f"k{d}-{i}{r.choice(odd)}": {"QUESTION": r.choice(odd) * r.randrange(3), "CONTEXTS": [r.choice(odd) for _ in range(r.randrange(4))],
                                          "extra": {"deep": {"er": r.choice(odd)}}, "final_decision": r.choice(odd)}
             for i in range(n)} for d, n in enumerate((25, 0, 1, 12))]
    dump = lambda d: json.dumps(d, indent=indent)
    (tmp_path / "a.json").write_text(dump(docs[0]))
    (tmp_path / "b.json").write_text(dump(docs[1]) + "\n")
    (tmp_path / "c.json").write_text("  " + dump(docs[2]) + "\n" + dump(docs[3]))
    split_bytes(size)
    got = {x["record_id"]: (x["QUESTION"], x["CONTEXTS"], x["final_decision"])
           for x in readers.read_object_map_json(spark, str(tmp_path)).collect()}
    assert got == {k: (v["QUESTION"], v["CONTEXTS"], v["final_decision"]) for d in docs for k, v in d.items()}


def test_records_are_not_shuffled(spark, tmp_path):
    """Places come from one number per split; only pieces that splits share move."""
    (tmp_path / "f.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    rows = csv_records(spark, str(tmp_path / "f.csv"))
    assert sorted((r["source_row_id"], r["record"]) for r in rows.collect()) == [(0, "a,b"), (1, '1,"x\ny"'), (2, "2,z")]
    assert "strategy=broadcast" in rows._jdf.queryExecution().optimizedPlan().toString()
