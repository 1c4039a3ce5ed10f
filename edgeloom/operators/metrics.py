"""Splits of labelled nodes and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.scoring import softmax
from edgeloom.operators.edges import key
from edgeloom.operators.order import running


def random_split(nodes: DataFrame, train: float = 0.5, valid: float = 0.25, seed: int = 0) -> DataFrame:
    """``(node, part)`` by place in hash order."""
    r = running(nodes, [key("node", seed=seed), F.col("node")], pos="__i")
    n = r.count()
    a, b = int(n * train), int(n * train) + int(n * valid)
    return r.select("node", F.when(F.col("__i") <= a, "train").when(F.col("__i") <= b, "valid").otherwise("test").alias("part"))


def class_split(nodes: DataFrame, per_class: int, valid: int, seed: int = 0) -> DataFrame:
    """``per_class`` nodes of each class for training; of the rest ``valid`` nodes for validation; no null or negative labels."""
    w = Window.partitionBy("y").orderBy(key("node", seed=seed), "node")
    r = nodes.where("y >= 0").withColumn("__i", F.row_number().over(w))
    rest = running(r.where(F.col("__i") > per_class), [key("node", seed=seed), F.col("node")], pos="__j")
    part = F.when(F.col("__j") <= valid, "valid").otherwise("test")
    return r.where(F.col("__i") <= per_class).select("node", F.lit("train").alias("part")).unionByName(rest.select("node", part.alias("part")))


def balanced_split(nodes: DataFrame, per_class: int, valid: int, seed: int = 0) -> DataFrame:
    """As ``class_split``, but validation is dealt to classes by largest remainder of what they have left, keeping one test node each."""
    w = Window.partitionBy("y").orderBy(key("node", seed=seed), "node")
    r = nodes.where("y >= 0").withColumn("__i", F.row_number().over(w))
    left = r.groupBy("y").agg(F.greatest(F.count("*") - per_class, F.lit(0)).alias("cap"))
    give = largest_remainder(left.withColumn("cap", F.greatest(F.col("cap") - 1, F.lit(0))), "y", "cap", valid)
    part = F.when(F.col("__i") <= per_class, "train").when(F.col("__i") <= per_class + F.col("give"), "valid").otherwise("test")
    return r.join(F.broadcast(give.select("y", "give")), "y").select("node", part.alias("part"))


def largest_remainder(groups: DataFrame, group: str, cap: str, budget: int) -> DataFrame:
    """Adds ``give``: a budget dealt in proportion to capacities, floors first, then one each by largest fraction, ties by group."""
    t = F.broadcast(groups.agg(F.sum(cap).alias("__t")))
    g = groups.crossJoin(t).withColumn("__b", F.least(F.lit(budget), F.col("__t")))
    g = g.withColumn("__raw", F.when(F.col("__t") > 0, F.col(cap) * F.col("__b") / F.col("__t")).otherwise(F.lit(0.0))).withColumn("__f", F.floor(F.round("__raw", 9)))
    w = Window.orderBy((F.col("__f") < F.col(cap)).desc(), F.round(F.col("__raw") - F.col("__f"), 9).desc(), group)
    s = F.broadcast(g.agg(F.sum("__f").alias("__s")))
    g = g.crossJoin(s).withColumn("__r", F.row_number().over(w))
    return g.withColumn("give", F.col("__f") + F.when(F.col("__r") <= F.col("__b") - F.col("__s"), 1).otherwise(0)).drop("__t", "__b", "__raw", "__f", "__s", "__r")


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("pred") == F.col("y")).cast("int")).alias("accuracy"))


def accuracy_per_class(preds: DataFrame) -> DataFrame:
    return preds.groupBy("y").agg(F.avg((F.col("pred") == F.col("y")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def f1(preds: DataFrame) -> DataFrame:
    """``micro`` and ``macro``; a class without true or predicted rows counts 0 only if it occurs at all."""
    c = preds.select(F.explode(F.array(F.struct(F.col("y").alias("c"), (F.col("y") == F.col("pred")).cast("int").alias("tp"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("r")).select("r.*")
    per = c.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    one = 2 * F.col("tp") / (F.col("t") + F.col("p"))
    return per.agg((2 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("micro"), F.avg(one).alias("macro"))


def multi_task_f1(preds: DataFrame, group: str = "task") -> DataFrame:
    """One row: the mean over tasks of the F1 of class 1, where a logit of 0 or more is a yes; null, NaN and negative labels don't
    count, tasks without labels neither; a task without any yes scores 0."""
    known = preds.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")) & (F.col("y") >= 0))
    yes, said = F.col("y") > 0, F.col("logit") >= 0
    n = lambda c: F.count(F.when(c, 1))
    per = known.groupBy(group).agg(n(yes & said).alias("tp"), (n(yes) + n(said)).alias("both"))
    return per.agg(F.avg(F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both")).otherwise(F.lit(0.0))).alias("f1"), F.count("*").alias("tasks"))


def gate_load(gates: DataFrame, column: str = "gates") -> DataFrame:
    """``(expert, load)``: rows whose gate for an expert is above 0."""
    g = gates.select(F.posexplode(column).alias("expert", "g"))
    return g.groupBy("expert").agg(F.count(F.when(F.col("g") > 0, 1)).alias("load"))


def cv_squared(values: DataFrame, column: str) -> DataFrame:
    """One row: sample variance over the squared mean; 0 for one value."""
    x = F.col(column).cast("double")
    cv = F.var_samp(x) / (F.pow(F.avg(x), F.lit(2)) + F.lit(1e-10))
    return values.agg(F.when(F.count("*") > 1, cv).otherwise(F.lit(0.0)).alias("cv_squared"))


def roc_auc(scored: DataFrame, group: str = "task") -> DataFrame:
    """Area under the curve per group from rank sums with average ranks; groups with one class are left out.

    Equal scores are one row with counts, so a window holds the distinct scores of a group.
    """
    s = scored.groupBy(group, "score").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("rank", before + (F.col("n") + 1) / 2)
    t = s.groupBy(group).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q")).where("p > 0 AND q > 0")
    return t.select(group, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def ensemble_mean(preds: DataFrame, probabilities: bool = False) -> DataFrame:
    """``(node, pos, value)``: mean logits over views, or the logarithm of mean probabilities."""
    x = softmax(F.col("logits")) if probabilities else F.col("logits")
    m = preds.select("node", F.posexplode(x).alias("pos", "e")).groupBy("node", "pos").agg(F.avg("e").alias("value"))
    return m.withColumn("value", F.log(F.greatest("value", F.lit(1e-30)))) if probabilities else m


def ensemble_vote(preds: DataFrame) -> DataFrame:
    """``(node, pred)``: the class most views choose, ties by mean softmax, then the first."""
    p = preds.select("node", "logits", F.array_max("logits").alias("top"))
    p = p.select("node", (F.array_position("logits", F.col("top")) - 1).alias("vote"), F.transform("logits", lambda x: F.exp(x - F.col("top"))).alias("e"))
    p = p.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    m = p.select("node", "vote", "total", F.posexplode("e").alias("pos", "e")).groupBy("node", "pos")
    m = m.agg(F.sum((F.col("vote") == F.col("pos")).cast("int")).alias("votes"), F.avg(F.col("e") / F.col("total")).alias("e"))
    return m.groupBy("node").agg(F.max_by("pos", F.struct(F.col("votes"), F.round("e", 9), -F.col("pos"))).alias("pred"))


def ensemble_prefixes(preds: DataFrame, sizes: list[int]) -> DataFrame:
    """``(k, node, pos, value)``: mean logits of the first k views, all k from one pass of running sums."""
    w = Window.partitionBy("node", "pos").orderBy("view_id").rowsBetween(Window.unboundedPreceding, 0)
    m = preds.select("view_id", "node", F.posexplode("logits").alias("pos", "e")).withColumn("k", F.row_number().over(w)).withColumn("value", F.avg("e").over(w))
    return m.where(F.col("k").isin(sizes)).select("k", "node", "pos", "value")


def chosen(candidates: DataFrame, priority: Column) -> DataFrame:
    """The candidate with the best validation score, ties by priority."""
    return candidates.orderBy(F.col("valid").desc(), priority).limit(1)
