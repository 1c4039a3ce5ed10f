"""The corpus pipeline: quality, language, near-duplicates, mix, token pieces.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; what it returns is written
as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import language, mixing, pieces, quality, shingle_join
from edgeloom.llm.common import table
from edgeloom.session import dropped, stored

STAGES = [
    ("quality", quality.stage),
    ("language", language.stage),
    ("near_duplicates", shingle_join.stage),
    ("mix", mixing.stage),
    ("pieces", pieces.stage),
]

#: Models and tokenizers are not expressed in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; a stage's table is deleted once the next one is written.

    An empty table passes all stages; what each does with nulls, empty texts, ties, repeats and other columns is said there.
    """
    docs, ours = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES:
        out = stored(stage(spark, docs, sf_dir), name)
        if ours:
            dropped(docs)
        docs, ours = out, True
    return docs
