"""Many patterns in many texts: which of the patterns each text contains.

Where the distinct patterns are few enough (their bytes are measured first: ``MOST_BYTES``), they are broadcast and each task builds
Aho-Corasick automata of at most ``PART`` patterns each; a text is passed over once by each, without any shuffle, whatever its
length. Beyond that bound, patterns and texts meet on grams of three characters: a pattern waits at the rarest of its own grams,
by their frequency in the texts, and a text asks only at grams where a pattern waits. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lineage import cut, free_names

MOST_BYTES, PART, GRAM = 32_000_000, 50_000, 3


def automata(patterns: list[str], part: int = PART) -> list[ahocorasick.Automaton]:
    """Automata over parts of distinct, non-empty patterns."""
    out = []
    for at in range(0, len(patterns), part):
        a = ahocorasick.Automaton()
        for p in patterns[at : at + part]:
            a.add_word(p, p)
        a.make_automaton()
        out.append(a)
    return out


def known(patterns: DataFrame, pattern: str, most_bytes: int = MOST_BYTES) -> list[str] | None:
    """The distinct patterns in order (no nulls), or None if they take more than ``most_bytes``."""
    p = cut(patterns.select(F.col(pattern).alias("p")).where("p IS NOT NULL").distinct())
    size = p.agg(F.sum(F.octet_length("p") + 8)).first()[0] or 0
    return sorted(r.p for r in p.collect()) if size <= most_bytes else None


def with_found(texts: DataFrame, text: str, patterns: list[str], name: str, part: int = PART) -> DataFrame:
    """``texts`` with ``name``: the given patterns that ``text`` contains, in order; none for a null text."""
    shared = texts.sparkSession.sparkContext.broadcast(patterns)
    (own,) = free_names(texts.columns, name)
    at = texts.columns.index(text)
    schema = texts.select("*", F.lit(None).cast(ArrayType(StringType())).alias(own)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = "" in shared.value
        searchers = automata([p for p in shared.value if p], part)
        for batch in batches:
            found = []
            for t in batch.column(at).to_pylist():
                hits = {p for a in searchers for _, p in a.iter(t)} if t else set()
                found.append(sorted(hits | {""} if every and t is not None else hits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, own])

    return texts.mapInArrow(run, schema)


def containing(needles: DataFrame, needle: str, hays: DataFrame, hay: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of ``needles`` joined to those of ``hays`` whose text contains theirs; nulls match nothing. Names must differ."""
    words = known(needles, needle, most_bytes)
    if words is None:
        return _by_rarest_gram(needles, needle, hays, hay)
    (mine,) = free_names([*needles.columns, *hays.columns], "_found")
    hits = with_found(hays, hay, words, mine).select(*hays.columns, F.explode(mine).alias(mine))
    return needles.join(hits, F.col(needle) == F.col(mine)).drop(mine)


def _by_rarest_gram(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """Patterns shorter than a gram wait at themselves; a text then asks with its shorter grams as well."""
    gram, asked, n = free_names([*needles.columns, *hays.columns], "_gram", "_asked", "_n")

    def grams(c: str, k: int):  # noqa: ANN202
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - k + 1)), lambda i: F.substring(c, i, F.lit(k)))

    texts = hays.where(F.col(hay).isNotNull())
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[grams(hay, k) for k in range(1, GRAM + 1)]))
    words = cut(needles.select(needle).where(F.col(needle).isNotNull()).distinct())
    places = words.select(needle, F.explode(F.when(F.length(needle) < GRAM, F.array(needle)).otherwise(F.array_distinct(grams(needle, GRAM)))).alias(gram))
    wanted = places.select(gram).distinct()
    often = texts.select(F.explode(every).alias(gram)).join(wanted, gram, "left_semi").groupBy(gram).agg(F.count(F.lit(1)).alias(n))
    # a gram that no text has rules its pattern out
    waiting = places.join(often, gram, "left").groupBy(needle).agg(F.min_by(gram, F.struct(F.coalesce(n, F.lit(0)), gram)).alias(gram))
    asking = texts.select("*", F.explode(every).alias(asked))
    return needles.join(waiting, needle).join(asking, F.col(gram) == F.col(asked)).where(F.col(hay).contains(F.col(needle))).select(*[needles[c] for c in needles.columns], *[c for c in hays.columns])
