"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words. The mix asks for ``share`` times all words,
dealt to sources by weight; no source gives more than ``epochs`` times its size, and what a
capped source can't give is dealt again by weight among the others until none is above its
cap. A source's target divided by its size is the number of times its documents are read:
the whole part for every document, the fraction for documents in seeded hash order until the
fraction of the source's words is reached (to the nearest document).

Nothing is gathered per source: the water level is found by sums over the table of sources, and
the cut of a source in hash order is found by two levels of histogram, so that only the
documents of one cell of CELLS ** 2 are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import fresh, held_columns, table, word_count
from edgeloom.session import join_counted, stored

#: Cells of a source's hash range at each of the two levels.
CELLS = 1024


def ranked(sources: DataFrame, key: str = "source") -> DataFrame:
    """``rank`` of each source by code point, from 0, null last, without one sort of them all."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(
        sources.repartitionByRange(n, F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "start")
    inside = Window.partitionBy("part").orderBy(F.col(key).asc_nulls_last())
    return parts.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.row_number().over(inside) - 1).drop("part", "start")


def targets(sources: DataFrame, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table of ``source_size`` and ``weight``.

    With level x a source gives ``min(weight * x, epochs * source_size)``. Each round sums the
    caps of the sources that are above at the present level and deals the rest again; the level
    only rises, and the loop ends when no further source is capped. Sources without words
    get 0. If all caps together are below what is asked for, every source gives its cap.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    asked = (sources.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap if capped >= 0 else F.col("source_size") <= 0
        row = sources.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            level = float("inf") if not row["weights"] else level
            break
        capped, level = row["n"], max(level, (asked - row["caps"]) / float(row["weights"]))
    give = F.lit(level) * F.col("weight") if level != float("inf") else cap
    return sources.withColumn("target", F.least(give, cap).cast("double"))


def _cell(h: Column, level: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(h, 10 * level), 54)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17, key: str = "source") -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``times``, how often the mix reads it.

    ``weights`` repeat over the sources by code point, null last; a null source is a source. A null
    or empty text has size 0 and is read the whole part of its source's epochs, which takes no
    words. Rows with the same id and text are dealt alike, so a repeated row may move its source's total
    by its size. An empty table gives an empty one; extra columns stay, and columns of the
    input that have the names of the new ones are replaced.
    """
    new = ["size", "source_size", "target", "times"]
    kept = [c for c in docs.columns if c not in new]
    name, hash_, size, row_cuts = fresh(docs, "mix_source", "mix_hash", "mix_size", "mix_cuts")
    base = docs.withColumn(name, F.struct(F.col(key).isNull().alias("missing"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name")))
    base = base.withColumn(hash_, F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))).withColumn(size, word_count(F.col("text")))

    h = F.col("h")
    slim = base.select(name, F.col(size).alias("size"), F.col(hash_).alias("h"))
    cells = stored(slim.groupBy(name, _cell(h, 0).alias("c0")).agg(F.sum("size").alias("words")), "mix-cells")
    sizes = cells.groupBy(name).agg(F.sum("words").alias("source_size")).withColumn("source", F.when(~F.col(name)["missing"], F.col(name)["name"]))
    sizes = stored(ranked(sizes, "source").drop("source"), "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    plan = targets(sizes.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), share, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.floor(rate) * F.col("source_size")))
    plan = stored(plan.select(name, "source_size", "target", "whole", "need"), "mix-plan")
    n = plan.count()

    def cut(cells: DataFrame, by: list[str], cell: str) -> DataFrame:
        """For each group, the cell in which its need is reached, and what is needed of that cell."""
        run = F.sum("words").over(Window.partitionBy(*by).orderBy(cell))
        found = cells.withColumn("run", run).where(F.col("run") - F.col("words") < F.col("need")).groupBy(*by).agg(F.max(F.struct(F.col(cell).alias("cell"), (F.col("need") - F.col("run") + F.col("words")).alias("left"))).alias("at"))
        return found.select(*by, F.col("at.cell").alias(cell), F.col("at.left").alias("left"))

    first = stored(cut(join_counted(cells, plan.select(name, "need"), [name], n), [name], "c0"), "mix-cut0")
    edge = join_counted(slim.withColumn("c0", _cell(h, 0)), first, [name, "c0"], n).withColumn("c1", _cell(h, 1))
    fine = edge.groupBy(name, "c1").agg(F.sum("size").alias("words"), F.max("left").alias("need"))
    second = stored(cut(fine, [name], "c1").withColumnRenamed("left", "left1"), "mix-cut1")
    last = join_counted(edge, second, [name, "c1"], n)
    run = F.sum("size").over(Window.partitionBy(name).orderBy("h"))
    last = last.withColumn("run", run).where(F.col("run") - F.col("size") / 2 <= F.col("left1")).groupBy(name).agg(F.max("h").alias("h2"))
    cuts = first.drop("left").join(second.drop("left1"), name, "left").join(last, name, "left")
    plan = plan.drop("need").join(cuts, name, "left")
    plan = stored(plan.select(name, F.struct("source_size", "target", "whole", "c0", "c1", "h2").alias(row_cuts)), "mix-cuts")

    out = join_counted(base, plan, [name], n)
    at, h = F.col(row_cuts), F.col(hash_)
    c0, c1 = _cell(h, 0), _cell(h, 1)
    extra = F.when(at["c0"].isNull(), F.lit(False)).when(c0 != at["c0"], c0 < at["c0"]).when(c1 != at["c1"], c1 < at["c1"]).otherwise(F.coalesce(h <= at["h2"], F.lit(False)))
    times = (at["whole"] + F.when(extra, 1).otherwise(0)).cast("long")
    return out.select(*kept, F.col(size).alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"), times.alias("times"))


def op5_source_mix(spark, sf_dir) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """The pipeline's mix: each document as many times as the mix reads it.

    A null or empty text is read the whole part of its source's epochs; equal rows are dealt alike; an
    empty table stays empty.
    """
    held = held_columns(docs)
    (copy,) = fresh(docs, "copy")
    out = mixed(docs.select(*held))
    return out.where("times > 0").select(*held, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias(copy)).select(*held)
