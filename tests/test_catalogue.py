"""Every query against the same in SQL."""

import os

import duckdb
import pytest

from stemma.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=str)
    assert rows(df.select(*rel.columns).collect()) == rows(rel.fetchall())


def test_one_shuffle_for_runs(spark):
    """Windows and grouping of the delta share one exchange."""
    plan = QUERIES["delta_detection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["modifying_laws_top5"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_top_k_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in QUERIES["neighbourhood_versions_top6"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry_works_without_the_optional_package():
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = Path(__file__).parents[1]
    with tempfile.TemporaryDirectory() as d:
        for p in root.iterdir():
            if p.name in ("stemma", "tests", ".git", "corpus_pipeline.py"):
                continue
            (Path(d) / p.name).symlink_to(p)
        (Path(d) / "stemma").mkdir()
        for p in (root / "stemma").iterdir():
            if p.name != "llm":
                (Path(d) / "stemma" / p.name).symlink_to(p)
        code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=d, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": d})


def test_entry_works_if_a_dependency_is_missing(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    root = Path(__file__).parents[1]
    code = "import __spark_entry__ as e; from stemma.plans.catalogue import QUERIES; assert set(e.queries()) >= set(QUERIES); e.oracle_sql(); assert e.llm is not None or 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=root, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": f"{tmp_path}:{root}"})
