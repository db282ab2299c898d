import subprocess
import sys


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 60


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
