"""The entry must import before any session exists, from the zipped pyspark alone."""

import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_from_zip_without_jvm():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = glob.glob(os.path.join(lib, "*.zip"))
    assert len(zips) >= 2, zips
    code = ("import pyspark, __spark_entry__ as e\n"
            "from pyspark import SparkContext\n"
            "assert pyspark.__file__.startswith(%r), pyspark.__file__\n"
            "assert SparkContext._gateway is None\n"
            "assert len(e.queries()) > 70 and set(e.oracle_sql()) <= set(e.queries())\n" % lib)
    env = os.environ | {"PYTHONPATH": os.pathsep.join(zips + [ROOT])}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
