"""S3: one CSV file cut anywhere gives the rows that Python's csv module finds in the whole file."""

import csv
import io
import random

import pytest

from bastion.sources import files as S


def whole(text):
    rows = csv.DictReader(io.StringIO(text, newline=""))
    return [S._row_text(r) for r in rows]


def cut(spark, path, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = S.split_csv_documents(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(r.error is None for r in got)
    return [r.text for r in sorted(got, key=lambda r: (r.record, r.part))]


TEXT = 'a, b ,"c\nd"\n1,"x, ""y""\nz\n\n",3\r\n\n"","\r\n",5" pipe\n7,"\n""\n""""",é\nlast,one\n'


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 19, 37, 1000])
def test_cut_at_every_byte(spark, tmp_path, size):
    (tmp_path / "t.csv").write_bytes(TEXT.encode())
    assert cut(spark, str(tmp_path / "t.csv"), size) == whole(TEXT)


def test_random_files_of_many_shapes(spark, tmp_path):
    rng = random.Random(4)
    pieces = ["a", "é", ",", '"', '""', "\n", "\r\n", "\r", " ", "x y", '","', '"\n"', "\n\n"]
    texts = {f"f{k:02d}.csv": "h1,h2,h3\n" + "".join(rng.choice(pieces) for _ in range(60)) for k in range(40)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = S.split_csv_documents(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        got = [r.text for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: (r.record, r.part))]
        assert got == whole(text), (name, text)


def test_no_header_bad_bytes_and_short_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "blank.csv").write_bytes(b"\n\n")
    (tmp_path / "short.csv").write_bytes(b"\n\na,b\n1\n1,2,3\n")
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,\xff\n2,ok\n")
    got = {}
    for r in S.split_csv_documents(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.record, r.text, r.error))
    assert set(got) == {"short.csv", "bad.csv"}
    assert [t for _, t, _ in sorted(got["short.csv"])] == whole("a,b\n1\n1,2,3\n")
    assert [(t, e) for _, t, e in sorted(got["bad.csv"])] == [(None, "not valid UTF-8"), ("a: 2\nb: ok", None)]


def test_records_go_to_python_in_small_batches(spark, tmp_path):
    """An Arrow batch takes 10 000 records however long they are; pickled rows come a hundred at a time."""
    (tmp_path / "t.csv").write_bytes(TEXT.encode())
    plan = S.split_csv_documents(spark, str(tmp_path / "t.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "ArrowEvalPython" not in plan
