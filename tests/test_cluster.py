"""How jobs behave outside the repository's folder and under a submitted master."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run_elsewhere(tmp_path, code, *args):
    """Run ``code`` as a submitted program from another folder; workers get no
    path to the package, the driver finds it through ``sys.path`` alone."""
    program = tmp_path / "program.py"
    program.write_text(f"import sys\nsys.path.insert(0, {ROOT!r})\n" + textwrap.dedent(code))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env |= {"PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable,
            "PYSPARK_SUBMIT_ARGS": " ".join([*args, "--conf spark.ui.enabled=false", "pyspark-shell"])}
    done = subprocess.run([sys.executable, str(program)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_a_submitted_master_stays_and_x1_runs_anywhere(tmp_path):
    out = run_elsewhere(tmp_path, """
        from placeweave.session import get_spark
        spark = get_spark()
        print("MASTER", spark.sparkContext.master)
        from placeweave.operators.elements import page_elements
        df = spark.createDataFrame([(1, "u", "<p>a</p><p>b</p>")], "page_id long, url string, html string")
        print("ELEMENTS", len(page_elements(df).first().elements))
        """, "--master local[2]")
    assert "MASTER local[2]" in out and "ELEMENTS 5" in out
