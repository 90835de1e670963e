"""The driver's entry imports without a session, a JVM or Spark's jars."""
import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code, path):
    env = os.environ | {"PYTHONPATH": path, "JAVA_HOME": "/nonexistent", "SPARK_HOME": "/nonexistent"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd="/", env=env,
                          capture_output=True, text=True, timeout=120)


def test_entry_imports_from_pyspark_zip():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = [z for z in glob.glob(os.path.join(lib, "*.zip"))]
    path = ":".join([*zips, ROOT])
    got = _run("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql();"
               "print(len(q), len(s), set(s) <= set(q))", path)
    assert got.returncode == 0, got.stderr[-2000:]
    n, m, inside = got.stdout.split()
    assert int(n) >= 55 and int(m) >= 55 and inside == "True"
