"""The entry file with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'o6_lco' in q, 'op4_host_rules' in q, 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data(tmp_path, pipeline):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "corpus_pipeline.py"][: 1 + pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 200 and int(out[1]) > 160 and out[2:] == ["True", "False", "False"]


def test_no_other_module_uses_them():
    used = [p for p in ROOT.glob("tessella/**/*.py") if "llm" not in p.parts and "tessella.llm" in p.read_text()]
    assert not used
