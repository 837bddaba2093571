"""Insights replaced in one step, and imports that report while they run."""

import pytest

from tallyflow.sources import feed, versions

SCHEMA = "user_id long, insight_type string, value double"


def insights(spark, *rows):
    return spark.createDataFrame([(u, k, float(v)) for u, k, v in rows], SCHEMA)


def stored(spark, path, version=None):
    frame = insights(spark, (1, "x", 1))
    return sorted(map(tuple, versions.read_version(spark, path, frame.schema, version).collect()))


def users(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "user_id long")


def test_a_writer_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "insights")
    assert stored(spark, path) == []
    assert versions.replace_at_once(insights(spark, *((u, "a", u) for u in range(300))), None, path) == 0
    before = stored(spark, path)
    with monkeypatch.context() as broken:
        broken.setattr(versions, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.replace_at_once(insights(spark, (5, "b", 1), (900, "b", 2)), users(spark, 5, 6), path)
    assert stored(spark, path) == before
    assert versions.replace_at_once(insights(spark, (5, "c", 1)), users(spark, 5, 6, 7000), path) == 1
    want = sorted([r for r in before if r[0] not in (5, 6)] + [(5, "c", 1.0)])
    assert stored(spark, path) == want and stored(spark, path, 0) == before
    assert versions.replace_at_once(insights(spark, (5, "d", 2)), None, path) == 2
    want = sorted([*want, (5, "d", 2.0)])
    assert stored(spark, path) == want


def test_untouched_buckets_are_not_written_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "insights")
    versions.replace_at_once(insights(spark, *((u, "a", u) for u in range(300))), None, path)
    for value in range(1, 5):
        versions.replace_at_once(insights(spark, (5, "a", value)), users(spark, 5), path)
        assert len([p for p in (tmp_path / "insights" / "data" / f"version={value}").iterdir() if p.is_dir()]) == 1
    versions.replace_at_once(insights(spark, (5, "z", 0)).limit(0), users(spark, 5), path)
    want = [(u, "a", float(u)) for u in range(300) if u != 5]
    assert stored(spark, path) == want
    versions.drop_versions(spark, path)
    assert stored(spark, path) == want and (5, "a", 4.0) in stored(spark, path, 4)
    assert not list((tmp_path / "insights" / "data" / "version=2").glob("bucket=*"))


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "insights")
    versions.replace_at_once(insights(spark, (1, "a", 1)), None, path)
    first = versions.committed(spark, path)
    versions.replace_at_once(insights(spark, (1, "b", 2)), users(spark, 1), path)
    monkeypatch.setattr(versions, "committed", lambda *_: first)
    with pytest.raises(RuntimeError):
        versions.replace_at_once(insights(spark, (2, "c", 3)), users(spark, 1), path)
    monkeypatch.undo()
    assert versions.committed(spark, path)[0] == 1


def test_import_is_observed(spark, tmp_path):
    rows = spark.sql("SELECT user_id, 'n' || id % 5 AS description, CAST(1 AS decimal(18,2)) AS amount, TIMESTAMP_NTZ '2024-01-01' AS ts, id AS seq FROM (SELECT id, id % 3 AS user_id FROM range(100))")
    jobs = []
    found = feed.observed_import(rows, rows.filter("user_id = 0"), lambda fresh: jobs.append(fresh.write.parquet(str(tmp_path / "x"))))
    assert found == {"total": 100, "imported": 10} and len(jobs) == 1
    assert spark.read.parquet(str(tmp_path / "x")).count() == 10
