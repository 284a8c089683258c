"""Files that are dropped in turn: taken once each, checked, set apart and archived."""

import pytest

from sparkloom.sources import ingest

NEED = ["id", "name"]


def drop(tmp_path, name, text):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text(text)


def take(spark, tmp_path, **options):
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), NEED, str(tmp_path / "archive"), **options)
    rows, apart = ingest.ingested(spark, str(tmp_path / "out"), NEED)
    return sorted((r["id"], r["name"], r["rescued"], r["file"].rsplit("/", 1)[1]) for r in rows.collect()), sorted((r["file"].rsplit("/", 1)[1], r["reason"]) for r in apart.collect())


def test_files_are_taken_once_and_archived(spark, tmp_path):
    drop(tmp_path, "a.csv", "id,name\n1,x\n2,\n")
    drop(tmp_path, "b.csv", 'name,id,file\n"y,\nz",3,c1\n')
    drop(tmp_path, "notes.txt", "id,name\n9,no\n")
    rows = [("1", "x", None, "a.csv"), ("2", None, None, "a.csv"), ("3", "y,\nz", '{"file":"c1"}', "b.csv")]
    assert take(spark, tmp_path) == (rows, [])
    assert take(spark, tmp_path) == (rows, [])
    drop(tmp_path, "c.csv", "id,other\n4,x\n")
    drop(tmp_path, "d.csv", "id,name,id\n5,x,6\n")
    drop(tmp_path, "e.csv", "")
    drop(tmp_path, "f.csv", "id,name\n")
    drop(tmp_path, "g.csv", "﻿id,name\n7,w\n")
    rows += [("7", "w", None, "g.csv")]
    apart = [("c.csv", "lacks the columns ['name']"), ("d.csv", "names a column twice")]
    assert take(spark, tmp_path) == (rows, apart)
    drop(tmp_path, "h.csv", "id,name\n8,v\n")
    assert take(spark, tmp_path) == ([*rows, ("8", "v", None, "h.csv")], apart)
    archived = {p.name for p in (tmp_path / "archive").rglob("*.csv")}
    assert archived >= {"a.csv", "b.csv", "c.csv"} and not (tmp_path / "in/a.csv").exists() and (tmp_path / "in/notes.txt").exists()


def test_lines_of_another_length_are_marked(spark, tmp_path):
    drop(tmp_path, "a.csv", "id,name\n1,x\n2\n3,y,z\n")
    take(spark, tmp_path)
    rows, _ = ingest.ingested(spark, str(tmp_path / "out"), NEED)
    assert {r["id"]: r["corrupt"] is not None for r in rows.collect()} == {"1": False, "2": True, "3": True}


def test_a_failed_batch_is_taken_again(spark, tmp_path, monkeypatch):
    drop(tmp_path, "a.csv", "id,name\n1,x\n")
    read, calls = ingest._read, []

    def fails(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return read(*args)

    monkeypatch.setattr(ingest, "_read", fails)
    with pytest.raises(Exception, match="lost"):
        take(spark, tmp_path)
    drop(tmp_path, "b.csv", "name,id\ny,2\n")
    assert take(spark, tmp_path, files=1) == ([("1", "x", None, "a.csv"), ("2", "y", None, "b.csv")], [])


def test_nothing_to_take(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert take(spark, tmp_path) == ([], [])
    with pytest.raises(ValueError):
        ingest.ingestion(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["file"])
