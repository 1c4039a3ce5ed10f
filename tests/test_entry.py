"""The driver's entry without packages that only the text operators need."""

import importlib.util
import subprocess
import sys

#: Warnings: one where the text operators are there but cannot be imported.
ONE = int(importlib.util.find_spec("edgeloom.llm") is not None)

PROGRAM = """
import sys, warnings
class Without:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Without())
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__ as e
assert len(e.queries()) > 200 and set(e.oracle_sql()) <= set(e.queries())
assert not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
print(len([w for w in seen if "edgeloom.llm" in str(w.message)]))
"""


def run(*names):
    out = subprocess.run([sys.executable, "-c", PROGRAM.format(names=names)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return int(out.stdout.split()[-1])


def test_a_missing_package_leaves_the_engine():
    assert run("xxhash") == ONE
    assert run("ahocorasick", "sentencepiece") == ONE


def test_a_missing_folder_is_no_fault():
    assert run("edgeloom.llm", "corpus_pipeline") == 0
