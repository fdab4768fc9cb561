"""The driver contract: entry(), queries() and oracle_sql() stay consistent."""

import os
import re
import subprocess
import sys

import __spark_entry__ as E

ROWS_ONLY = {"clustering", "theme_rebuild"}


def test_oracle_keys_match_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    own = {k for k in q if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert own - set(s) == ROWS_ONLY
    assert all(isinstance(v, str) and v.strip() for v in s.values())


def test_entry_runs_on_smallest_scale(spark):
    df = E.entry(spark)
    assert df.columns == ["domain", "theme_key", "size", "evidence", "weight", "reused", "score"]
    rows = df.collect()
    assert len(rows) >= 1 and len({r.domain for r in rows}) == len(rows)


def test_import_needs_nothing_of_the_machine(tmp_path):
    """The entry point imports where Spark's ML jar is missing: no file beside the Python sources is opened."""
    code = ("import builtins, sys, zipfile\n"
            "zipfile.ZipFile = None\n"
            "import __spark_entry__ as E\n"
            "assert len(E.queries()) >= 74 and E.oracle_sql()\n"
            "assert not [m for m in sys.modules if m.startswith('pyspark.ml')]\n")
    root = os.path.dirname(os.path.abspath(E.__file__))
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": root},
                         capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-2000:]
