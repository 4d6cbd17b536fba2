"""The entry module: names, columns, and its independence of the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 60


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["agg_ae_level", "win_lift_chart", "agg_cramers_v", "ft_bs_linear", "fit_poisson_exposure", "win_discrimination", "q_conventions", "ft_te_interaction"])
def test_against_sql(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    own = [tuple(r) for r in got.select(*columns).collect()]
    assert len(own) == len(want)
    for a, b in zip(sorted(own, key=repr), sorted(want, key=repr), strict=True):
        assert a == pytest.approx(b, abs=1e-3)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize(("name", "source"), [("ft_encoder_api", "orders"), ("ft_fe", "part")])
def test_whole_tables(spark, name, source):
    """These leave no row out, and agree with their SQL."""
    import __spark_entry__ as entry

    test_against_sql(spark, name)
    assert entry.queries()[name](spark, str(DATA)).count() == spark.read.parquet(str(DATA / f"{source}.parquet")).count()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_stands_alone(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_ae_level' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    lib = [p for p in (ROOT / "riskloom").rglob("*.py") if "llm" not in p.parts]
    assert not any("riskloom.llm" in p.read_text() for p in lib)
