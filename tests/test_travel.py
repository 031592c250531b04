"""What the core runs in Python workers travels by value: a process that can't import the package can run it."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from graphquarry.operators import vector_index, vectors
from graphquarry.sources import files

MODEL = ("cosine", np.eye(2), np.zeros((2, 256, 1)))
CALLS = {
    "index": lambda: vector_index.Model(*MODEL).encode(vectors.matrix(pa.array([[1.0, 2.0]]))),
    "exact": lambda: vectors.BestRows(1, np.array([1]), np.eye(1), "dot").add(np.array([2]), np.eye(1)),
    "docx": lambda: files.docx_text,
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_by_value(name, tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(CALLS[name]))
    code = "import sys; from pyspark import cloudpickle; cloudpickle.load(open('f', 'rb'))(); assert 'graphquarry' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
