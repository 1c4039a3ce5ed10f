"""What every operator needs from the session: shared storage, and joins whose small side is checked.

Lineage is cut with tables written below the folder in ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and nothing more.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast; beyond it both sides are shuffled by the key.
BROADCAST_ROWS = 300_000
#: Bytes that a writer of a stored table holds in memory before it writes them out.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` once no later step reads them."""
    for t in tables:
        spark = t.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        local = lambda at: re.sub("^file:/*", "/", at)  # noqa: E731  a local folder may be given with its scheme or without
        for parent in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if local(parent).startswith(local(shared_dir(spark)) + "/"):
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)


def join_counted(left: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join ``small``, whose row count is known to be ``rows``, to a large side whose keys may be skewed.

    Up to BROADCAST_ROWS the small side is broadcast. Beyond that each row of either side is shuffled once, and a merge
    join streams a hot key past its one row of ``small``; partitions that a hot key makes large are cut by adaptive
    execution, which copies only the piece of ``small`` they meet. Null keys match nothing under ``how='inner'``.
    """
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, how)
    return left.join(small.hint("merge"), on, how)
