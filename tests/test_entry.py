import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "rank", "score"} <= set(rows[0].asDict())


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
