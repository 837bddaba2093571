"""Records of CSV files: splits, quoted line breaks, malformed records, positions."""

import random

import pytest

from tallyflow.sources import records
from tallyflow.sources.statement import read_statements

COLUMNS = ["Date", "Description", "Amount"]


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for name, value in zip(names, ("300", "1", "64"), strict=True):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())
    return str(folder)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_give_the_records_of_one_task(spark, tmp_path, small_splits, seed):
    rnd = random.Random(seed)
    part = lambda: rnd.choice(["a", "é", ",", '"', "\n", "\n\n", " x", "long text " * rnd.randint(1, 9)])
    for k in range(3):
        rows = [",".join([f"0{k}/01/2024", quoted("d" + "".join(part() for _ in range(rnd.randint(0, 6)))), str(i)]) for i in range(120)]
        path = write(tmp_path / "in", f"f{k}.csv", "\n".join([",".join(COLUMNS), *rows]) + rnd.choice(["", "\n"]))
    lines = records.read_lines(spark, path)
    assert lines.select("file", "block").distinct().count() > 30
    got = records.parse_records(records.read_records(spark, path, multi_line=True), COLUMNS)
    assert got.filter("record_error IS NOT NULL").count() == 0
    want = read_statements(spark, path, COLUMNS, multi_line=True)
    as_rows = lambda df: sorted(map(tuple, df.select(*COLUMNS).collect()))
    assert as_rows(got) == as_rows(want) and got.count() == 360
    for r in got.collect():
        data = open(r.file.removeprefix("file://").removeprefix("file:"), "rb").read()
        assert data[r.position :].startswith(r.Date.encode()) and r.row == int(r.Amount) + 1


def test_malformed_records_and_their_places(spark, tmp_path, small_splits):
    lines = ["Date,Description,Amount", "01/01/2024,ok,1", "01/01/2024,short", "", '01/01/2024,"open,2', '01/01/2024,"a, ""b""",3', "01/01/2024,too,4,many", "é,ü,5\r", ",,"]
    path = write(tmp_path / "in", "f.csv", "\n".join(lines * 40))
    parsed = records.parse_records(records.read_records(spark, path), COLUMNS).collect()
    starts = [0]
    for line in (lines * 40)[:-1]:
        starts.append(starts[-1] + len(line.encode()) + 1)
    by_row = {r.row: r for r in parsed}
    kinds = {1: None, 2: "not 3 fields", 4: "open quotation mark", 5: None, 6: "not 3 fields", 7: None, 8: None}
    for block in range(40):
        for k, error in kinds.items():
            row = block * 9 + k
            assert by_row[row].record_error == error and by_row[row].position == starts[row]
            assert (by_row[row].bad_record == lines[k]) == (error is not None)
        assert block * 9 + 3 not in by_row  # blank
        assert tuple(by_row[block * 9 + 5][c] for c in COLUMNS) == ("01/01/2024", 'a, "b"', "3")
        assert tuple(by_row[block * 9 + 7][c] for c in COLUMNS) == ("é", "ü", "5")
    assert 0 not in by_row


def test_an_open_mark_at_the_end_of_a_file(spark, tmp_path):
    path = write(tmp_path / "in", "f.csv", 'a,b,1\nc,"d\ne\n')
    rows = records.parse_records(records.read_records(spark, path, multi_line=True), COLUMNS, header=False).collect()
    assert sorted((r.row, r.record_error, r.bad_record) for r in rows) == [(1, None, None), (2, "open quotation mark", 'c,"d\ne')]
    assert records.read_records(spark, write(tmp_path / "none", "f.csv", ""), multi_line=True).count() == 0
