"""The core stands without the llm subpackage."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_core_never_imports_llm():
    for f in (ROOT / "tipstaff").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


def test_entry_without_llm():
    code = "import sys; sys.modules['tipstaff.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "p5_found" in said.stdout and "p1_found" not in said.stdout and "q_bm25_topk" in said.stdout


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_workers_need_no_search_path(tmp_path):
    """A session started elsewhere, with the package known to the driver alone."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\nfrom tipstaff.runtime import session\nimport __spark_entry__ as e\nprint(e.queries()['q_edges'](session(cores='2'), '/root/testdata/sf0.001').count())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert said.returncode == 0, said.stderr[-2000:]
    assert int(said.stdout.split()[-1]) > 0
