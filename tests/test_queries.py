"""Every query of the library runs, and is its SQL where it has one."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from sparkloom.plans.queries import ORACLES, QUERIES
from tests.compare import connect, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["r_name", "l_returnflag", "revenue", "line_count"] and df.count() > 0


def test_entry_module_without_the_subpackage(tmp_path):
    """With the folders of the training-data operators gone, and with their pipeline left or gone, the rest works."""
    root = Path(__file__).resolve().parent.parent
    for name in ("with", "without"):
        copy = tmp_path / name
        shutil.copytree(root / "sparkloom", copy / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        if name == "with" and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(n.startswith('op1') or n == 'pipeline' for n in q); print(len(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        assert int(out.stdout) == len(QUERIES)


def _times(rows):
    out = {}
    for r in rows:
        out.setdefault(r["user_id"], []).append((r["ts"].timestamp(), r["event_id"]))
    return {k: sorted(v) for k, v in out.items()}


def test_rate_limits_against_a_model(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    fixed, sliding, fresh = set(), set(), set()
    for hits in _times(events).values():
        start, n, log, last = None, 0, [], None
        for t, i in hits:
            if start is None or t >= start + 86400:
                start, n = t, 0
            n += 1
            if n <= 2:
                fixed.add(i)
            log = [x for x in log if x > t - 86400]
            if len(log) < 2:
                log.append(t)
                sliding.add(i)
            if last is None or t >= last + 86400:
                last = t
                fresh.add(i)
    for name, want, column in (("rate_fixed", fixed, "allowed"), ("rate_sliding", sliding, "allowed"), ("idempotency", fresh, "fresh")):
        assert {r["event_id"] for r in QUERIES[name](spark, sf_dir).where(column).collect()} == want
