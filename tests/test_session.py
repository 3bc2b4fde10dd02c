"""Sessions without the machine's settings, and installations without the corpus parts."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, tmp_path, **env):
    held = os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)} | env
    return subprocess.run([sys.executable, "-c", code], env=held, capture_output=True, text=True, cwd=tmp_path, timeout=300)


def test_a_stock_session_makes_its_own_folder(tmp_path):
    code = (
        "from linkloom.session import local_session, shared_folder, written\n"
        "spark = local_session(1)\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert shared_folder(spark) == shared_folder(spark)\n"
        "print('rows', written(spark.range(3), 'x').count())\n"
    )
    done = run(code, tmp_path)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_the_entry_survives_any_missing_part(tmp_path):
    for name in ("corpus_pipeline", "linkloom.llm", "public_tokenizers", "duckdb"):
        code = (
            f"import sys; sys.modules[{name!r}] = None\n"
            "import __spark_entry__ as e\n"
            "print('names', len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))\n"
        )
        done = run(code, tmp_path)
        words = done.stdout.split()
        assert words and int(words[1]) > 50 and words[1] == words[2] and words[3] == "False", done.stderr[-2000:]
