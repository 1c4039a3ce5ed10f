"""The pipeline against its stages' plain versions, and the isolation of the subpackage."""

import pathlib
import re
import subprocess
import sys

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from edgeloom.llm import language, quality  # noqa: E402
from tests.llm.test_mixing import brute as water  # noqa: E402
from tests.llm.test_shingle_join import brute as joins  # noqa: E402

ROOT = pathlib.Path(__file__).parents[2]


def test_stages(spark, tmp_path):
    words = "the of and to in is that for it was as with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()
    rows = []
    for i in range(240):
        base = i if i % 4 else i // 16
        text = " ".join(words[(base * 7 + j * (base % 5 + 1)) % len(words)] + ("s" if (base + j) % 3 else "") for j in range(40 + base % 20))
        if i % 10 == 9:
            text = "### ".join(text.split()) + " $$$ |||"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "123 456", "en", "s0", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 10 == 9 else 1, 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    at = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at.write.parquet(f"{sf}/in-{name}")
        at = spark.read.parquet(f"{sf}/in-{name}")
        before = at
        at = stage(spark, at, sf)
        if name != "pieces":
            assert at.columns == docs.columns
        kept[name] = (before.collect(), at.collect())
    one = {r["doc_id"] for r in kept["quality"][1]}
    assert not {i for i in one if i is not None and i < 240 and i % 10 == 9} and len(one) >= 210
    assert not {900, 901} & {r["doc_id"] for r in kept["language"][1]}
    before, after = kept["near_duplicates"]
    want = joins([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, low in want if i == low)
    before, after = kept["mix"]
    sizes, taken = {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    for s, want in water(sizes, (3.0, 1.0, 2.0)).items():
        assert abs(taken[s] - want) <= 80
    assert len(kept["pieces"][1]) == len(after)
    assert corpus_pipeline.run(spark, sf).count() == len(after)
    assert quality.stage and language.stage


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "edgeloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"edgeloom\.llm|from edgeloom import llm", p.read_text()), p


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "edgeloom", tmp_path / "edgeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
