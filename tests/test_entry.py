import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyforge.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


def rows(df, names):
    show = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[names].astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'model_summary' in q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=False).returncode == 0
