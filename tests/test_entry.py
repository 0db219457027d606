"""The entry points with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
from __spark_entry__ import entry, oracle_sql, queries
from tidemart.session import get_session

named, sql = queries(), oracle_sql()
assert set(sql) <= set(named) and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in named), sorted(named)
spark = get_session("entry", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
print([named[n](spark, sys.argv[1]).count() > 0 for n in ("silver_users", "event_type_counts", "cosine_topk")], entry(spark).count() > 0)
"""


def test_queries_without_the_subpackage(tmp_path, sf):
    """The pipeline's file stays behind: it must not be imported without what it imports itself."""
    skip = {".git", "llm", "__pycache__", ".pytest_cache"}
    shutil.copytree(HERE, tmp_path / "repo", ignore=lambda folder, names: [n for n in names if n in skip])
    done = subprocess.run([sys.executable, "-c", SCRIPT, sf], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "[True, True, True] True" in done.stdout


def test_every_query_with_sql_is_registered():
    sys.path.insert(0, HERE)
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
