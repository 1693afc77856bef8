"""Merging metrics that filings name in their own words: a similarity join of label texts.

Two labels are compared by the cosine of their character q-grams. Only labels that agree in the hard filters (statement, unit, ...) may
meet, and of those only such as share one of their rarest q-grams: with q-grams in the order of their frequency, labels
whose cosine is at least t share one among the first n - ceil(t * t * n) + 1 of each, n being its number of q-grams. Then the cosine is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import similarity_band
from ..functions.text import normalized_label
from ..staging import staged


def q_grams(text: Column, q: int = 3) -> Column:
    """The distinct q-grams of a text with a blank at both ends."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    n = F.length(padded)
    return F.array_distinct(F.when(n <= q, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), n - q + 1), lambda k: F.substring(padded, k, F.lit(q)))))


def label_classes(labels: DataFrame, filters: list[str], q: int = 3) -> DataFrame:
    """labels (id, label and the filters) with class_id: the smallest id of those that agree in the filters and whose labels have the same q-grams, whose cosine is 1. Null labels and filters have no class."""
    each = labels.select("id", *filters, normalized_label(F.col("label")).alias("name")).where(" and ".join(f"{c} is not null" for c in ("name", *filters)))
    names = each.groupBy(*filters, "name").agg(F.min("id").alias("first")).withColumn("grams", F.array_sort(q_grams(F.col("name"), q)))  # q-grams of distinct names only
    firsts = names.groupBy(*filters, "grams").agg(F.min("first").alias("class_id"), F.collect_list("name").alias("names"))
    return each.join(firsts.select(*filters, "class_id", F.explode("names").alias("name")), [*filters, "name"]).select("id", *filters, "class_id")


def linked_labels(labels: DataFrame, filters: list[str], threshold: float = 0.7, q: int = 3) -> DataFrame:
    """(id, class_id, other, similarity, band): each label of a class with each other class that is similar, as similar_labels compares them; with no such class one row, other null.

    The classes are compared by their representatives, and each label tells of its class, so copies aren't paired with copies: two labels are similar if their classes are the same or linked.
    """
    classes = staged(label_classes(labels, filters, q).select("id", "class_id"))
    firsts = labels.join(classes.where("id = class_id").select("id"), "id", "left_semi")
    pairs = similar_labels(firsts, filters, threshold, q)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "band"))
    return classes.join(both.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "similarity", "band"), "class_id", "left").select("id", "class_id", "other", "similarity", "band")


def similar_labels(labels: DataFrame, filters: list[str], threshold: float = 0.7, q: int = 3) -> DataFrame:
    """(a, b, similarity, band) of the labels (id, label and the filters) whose similarity is over the threshold, a < b.

    Labels are compared in lower case and with single blanks. Null labels and filters match nothing. A q-gram that many labels have is
    in a label's prefix only if the label has hardly a rarer one.
    """
    named = labels.select("id", *filters, q_grams(normalized_label(F.col("label")), q).alias("grams")).where("grams is not null")
    each = named.select("id", *filters, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = each.join(often, "gram").groupBy("id", *filters, "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("g"))
    sets = staged(ranked.withColumn("grams", F.transform("g", lambda x: x["gram"])).drop("g"))
    # cosine > t of sets needs an overlap over t * sqrt(n * m), and that both are within t * t of each other's size
    keep = (F.col("n") - F.ceil(F.lit(threshold * threshold) * F.col("n")) + 1).cast("int")
    prefix = sets.select("id", *filters, "n", F.explode(F.slice("grams", F.lit(1), keep)).alias("gram"))
    other = prefix.select(F.col("id").alias("b"), *filters, F.col("n").alias("m"), "gram")
    fits = (F.col("n") >= threshold * threshold * F.col("m")) & (F.col("m") >= threshold * threshold * F.col("n"))
    pairs = prefix.withColumnRenamed("id", "a").join(other, ["gram", *filters]).where("a < b").where(fits).select("a", "b").distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", (both / F.sqrt(F.size("x") * F.size("y"))).alias("similarity"))
    return scored.where(F.col("similarity") > threshold).withColumn("band", similarity_band(F.col("similarity")))
