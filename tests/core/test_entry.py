import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_without_the_subpackage(tmp_path):
    """Without the training-data folders, the pipeline left or not, the other queries are all there."""
    without = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.md", "*.json", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=without)
    code = "import __spark_entry__ as e; from glimmer.plans import queries as q; assert e.queries().keys() == q.QUERIES.keys() and e.oracle_sql().keys() == q.ORACLE_SQL.keys() and 'pipeline' not in e.queries()"
    for leave in (True, False):
        pipeline = tmp_path / "copy" / "corpus_pipeline.py"
        if not leave:
            pipeline.unlink(missing_ok=True)
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, check=True)
