"""The driver's contract also where the training-data part or something it needs is missing."""

import subprocess
import sys

import pytest

_SCRIPT = """
import importlib.abc, sys

class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
names = set(e.queries())
assert "suffix_cut" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
"""


@pytest.mark.parametrize("hidden", ["palimpsest.llm", "ahocorasick", "sentencepiece", "public_tokenizers"])
def test_entry_without(hidden):
    subprocess.run([sys.executable, "-c", _SCRIPT.format(hidden=hidden)], check=True, timeout=120)


def test_scratch_is_beside_the_warehouse_and_cleared(spark):
    from palimpsest.sources import scratch

    with scratch.cleared(spark):
        inner = scratch.materialize(spark.range(3), "kept-inside")
        assert inner.count() == 3
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    assert path.startswith(scratch.scratch_dir(spark))
