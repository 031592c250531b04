"""What runs in Python workers travels by value: a process that can't import the package can run it."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from graphquarry.llm import decontaminate, htmlblocks, langid, secrets, simhash, sstable

CALLS = {
    "fingerprint": lambda: simhash.fingerprint("a b c d"),
    "langid": lambda: langid.Bundler(dim=16).bundle(["abc"])[1].tolist(),
    "blocks": lambda: htmlblocks.features(htmlblocks.leaf_blocks("<p class='x'>a</p>")).shape,
    "labels": lambda: len(htmlblocks.label(htmlblocks.train(htmlblocks.synthetic(4), epochs=1), [htmlblocks.leaf_blocks("<p>a</p>")])),
    "secrets": lambda: secrets.written(secrets.all_spans("token = abcdefghij", {})[0]),
    "windows": lambda: decontaminate.chunks(["a b"]).__next__(),
    "keys": lambda: sstable.id_of(sstable.key_of(5)),
    "writer": lambda: sstable.ShardWriter(None, 2).at,
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_by_value(name, tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(CALLS[name]))
    code = "import sys; from pyspark import cloudpickle; cloudpickle.load(open('f', 'rb'))(); assert 'graphquarry' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
