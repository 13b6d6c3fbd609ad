"""The driver's entry without the optional part, or without what that needs."""

import subprocess
import sys

import pytest

HIDDEN = """
import sys
sys.path.insert(0, {root!r})
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
found = entry.queries()
assert "bm25_topk" in found and "op3_toxicity" not in found and "pipeline" not in found, sorted(found)
assert set(entry.oracle_sql()) <= set(found)
"""


@pytest.mark.parametrize("names", (["zstandard"], ["quire.llm"], ["quire.llm.registry", "corpus_pipeline"]))
def test_entry_without_the_optional_part(names):
    code = HIDDEN.format(root=sys.path[0], names=names)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1000:]
