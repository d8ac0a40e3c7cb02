import subprocess
import sys


def test_imports_without_a_session_and_without_the_corpus_folders(tmp_path):
    """The entry imports in a fresh process, with and without the corpus subpackage."""
    import shutil
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"
    for place, corpus in ((repo, (repo / "corpus_pipeline.py").exists()), (copy, False)):
        out = subprocess.run([sys.executable, "-c", code], cwd=place, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        assert ("pipeline" in out.stdout) == corpus
