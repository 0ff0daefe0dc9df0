"""Every query with SQL gives the SQL's rows on the smallest tables, and the entry point runs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from stormspan.plans import branches
from stormspan.plans import queries as reference

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
BRANCHES = sorted(n for n, f in reference.Q.items() if f.__module__ == branches.__name__)
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "null" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["flag_spell_last", "eca_pvalue_blocked", "compound_events_cooccurring", "window_analysis", "episode_stats_national", "composite_anomaly", "thermo_thresholds", "pipeline_summary", *BRANCHES])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = reference.Q[name](spark, DIR)
    want = con.execute(reference.SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), [c[0] for c in want.description])


def test_public_names():
    import stormspan

    assert all(hasattr(stormspan, n) for n in stormspan.__all__)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(tmp_path):
    """With the folders of the corpus operators gone, everything else imports and registers its queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 60 and 'pipeline' not in q; print(*[n for n in q if n.startswith('op')])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip() == ""
