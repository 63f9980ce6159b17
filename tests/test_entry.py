import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_works_without_the_llm_folder(tmp_path):
    """The driver deletes it, the pipeline and their tests; all else must import."""
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('tidemark.llm'):
            raise ModuleNotFoundError(name)
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""
    for item in ("__spark_entry__.py", "tidemark"):
        source, target = ROOT / item, tmp_path / item
        if source.is_dir():
            for f in source.rglob("*.py"):
                if "llm" not in f.parts:
                    to = target / f.relative_to(source)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(f.read_text())
        else:
            target.write_text(source.read_text())
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    queries, oracles = map(int, done.stdout.split())
    assert queries >= oracles > 50
