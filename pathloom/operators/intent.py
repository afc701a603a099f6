"""What a request is about, without a service: categories by complement naive Bayes, parameters by typed patterns.

Complement naive Bayes (Rennie et al., 2003) scores a class by how badly a text fits all other classes, which suits classes of uneven
size. Fitting is three aggregations. Only words that a class has are stored; what all classes share of a word's weight is taken once a
text, so scoring is a join on words and a row a text and class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

ALPHA = 1.0
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@dataclass
class Classifier:
    """shared (word, w: its total), own (word, category, n), classes (category, size: its words), and sums over all."""

    shared: DataFrame
    own: DataFrame
    classes: DataFrame
    vocabulary: int
    total: int


def fit(texts: DataFrame, category: str, text: str) -> Classifier:
    """A classifier of ``category``, from rows where neither it nor ``text`` is null."""
    rows = texts.where(F.col(category).isNotNull()).select(F.col(category).alias("category"), F.explode(words(F.col(text))).alias("word"))
    own = cut(rows.groupBy("word", "category").agg(F.count(F.lit(1)).alias("n")))
    shared = cut(own.groupBy("word").agg(F.sum("n").alias("w")))
    classes = cut(own.groupBy("category").agg(F.sum("n").alias("size")))
    found = shared.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("w"), F.lit(0)).alias("t")).first()
    return Classifier(shared, own, classes, found.v, found.t)


def scores(requests: DataFrame, key: str, text: str, model: Classifier, alpha: float = ALPHA) -> DataFrame:
    """key, category, score (less the logarithm of the fit to all other classes), support (the class's words in the text).

    Words that no class has don't count; a text without known words has no row.
    """
    f = requests.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("f"))
    f = cut(f.join(model.shared, "word"))
    base = f.groupBy(key).agg(F.sum(-F.col("f") * F.log(F.col("w") + alpha)).alias("base"), F.sum("f").alias("length"))
    extra = f.join(model.own, "word").groupBy(key, "category").agg(
        F.sum(F.col("f") * (F.log(F.col("w") + alpha) - F.log(F.col("w") - F.col("n") + alpha))).alias("extra"), F.sum("f").alias("support"),
    )
    every = base.crossJoin(model.classes).join(extra, [key, "category"], "left")  # a row a text and class is the result itself
    rest = F.log(F.lit(alpha * model.vocabulary) + model.total - F.col("size"))
    return every.select(key, "category", (F.col("base") + F.coalesce("extra", F.lit(0.0)) + F.col("length") * rest).alias("score"), F.coalesce("support", F.lit(0)).alias("support"))


def best(scored: DataFrame, key: str, k: int = 1, digits: int = 9) -> DataFrame:
    """The k best categories of each key with their rank, among those with support; ties by name."""
    w = W.partitionBy(key).orderBy(F.desc(F.round("score", digits)), "category")
    return scored.where("support > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# typed values in the order in which they are looked for, after key = value
KINDS = {
    "url": r"https?://[^\s<>\"']+[^\s<>\"'.,;:!?)]",
    "email": r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "time": r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?\b",
    "number": r"(?<![\w.:/=?&-])-?\d+(?:\.\d+)?(?![\w:/-]|\.\d)",
}
_PAIR = r"\b([A-Za-z_][\w-]*)\s*(?:=|:(?!//))\s*(\"[^\"]*\"|'[^']*'|[^\s,;]+)"


def parameters(text: Column) -> Column:
    """key -> value: pairs written as key = value or key: value (quotes taken off), and the first value of each kind of ``KINDS``
    under the kind's name. The first of equal keys counts. Null gives an empty map."""
    keys, values = (F.regexp_extract_all(text, F.lit(_PAIR), F.lit(i)) for i in (1, 2))
    bare = lambda v: F.regexp_replace(v, r"^[\"']|[\"']$", "")
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), bare(v).alias("value")))
    typed = [F.struct(F.lit(k).alias("key"), F.regexp_extract(text, p, 0).alias("value")) for k, p in KINDS.items()]
    found = F.filter(F.concat(pairs, F.array(*typed)), lambda e: e["value"] != "")
    first = F.filter(found, lambda e, i: F.array_position(F.transform(found, lambda x: x["key"]), e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))
