"""The driver's entry points, with and without the training-data operators."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = """
import sys, warnings
warnings.simplefilter("ignore")
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as e
print(len([q for q in e.queries() if q == "pipeline" or q[:2] == "op"]), len(e.queries()) > 60, len(e.oracle_sql()) > 60)
"""


@pytest.mark.parametrize("lacking", ["millrace.llm", "corpus_pipeline", "ahocorasick"])
def test_without_the_training_data_operators(lacking):
    done = subprocess.run([sys.executable, "-c", SAYS, lacking], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["0", "True", "True"], done.stderr[-500:]
