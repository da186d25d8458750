import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "url" in df.columns


def test_imports_without_the_training_data_operators(tmp_path):
    """The rest stands without harrow/llm and corpus_pipeline.py."""
    import shutil

    shutil.copytree(ROOT / "harrow", tmp_path / "harrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_report' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_imports_the_training_data_operators():
    for f in (ROOT / "harrow").rglob("*.py"):
        if "llm" not in f.parts:
            assert "harrow.llm" not in f.read_text()


def test_stands_where_a_library_is_missing(tmp_path):
    """Without what the training-data operators need, the other queries stay."""
    code = "import sys; sys.modules['tiktoken'] = sys.modules['public_tokenizers'] = sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'page_report' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
