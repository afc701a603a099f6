"""Pluggable services: embedder, intents and generator, with deterministic offline defaults."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pathloom.functions.text import ascii_only, description_status, fallback_tokens, short_error, technical_terms, without_number
from pathloom.operators import intent

DIMENSIONS = 256


@F.pandas_udf(ArrayType(DoubleType()))
def _histogram(places: pd.Series) -> pd.Series:
    """How often each of DIMENSIONS numbers stands in an array."""
    return pd.Series([np.bincount(p, minlength=DIMENSIONS).astype(float) for p in places])


def hashed_embedding(text: Column, n: int = 3) -> Column:
    """An offline embedding: counts of hashed character n-grams of the lower-cased text, as array<double>."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))
    return _histogram(grams)


def letter_counts(text: Column) -> Column:
    """A plainer offline embedding: how often each of the letters a to z stands in the text, case aside."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)])


def embed_distinct(df: DataFrame, column: str, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """text, embedding of the distinct texts of a column: each is embedded once, to be joined back."""
    return df.select(F.col(column).alias("text")).where("text is not null").distinct().withColumn("embedding", embed(F.col("text")))


def offline_intent(requests: DataFrame, text: str = "text") -> DataFrame:
    """``requests`` with goal_description, parameters (as written in the text), function_categories (none) and keywords, without a
    service; ``fitted_intent`` gives categories too."""
    return requests.withColumns({
        "goal_description": F.col(text), "parameters": intent.parameters(F.col(text)), "function_categories": F.array().cast("array<string>"),
        "keywords": F.array_sort(F.array_union(fallback_tokens(F.col(text)), technical_terms(F.col(text)))),
    })


def fitted_intent(leaves: DataFrame, k: int = 2) -> Callable[[DataFrame], DataFrame]:
    """``offline_intent`` with the k most likely first-level categories of ``leaves`` (path_str, combined_text, mapped_nodes)."""
    category = without_number(F.element_at(F.split("path_str", " -> "), 1))
    model = intent.fit(leaves.select(category.alias("category"), F.concat_ws(" ", "combined_text", F.array_join("mapped_nodes", " ")).alias("text")), "category", "text")

    def analyse(requests: DataFrame, text: str = "text") -> DataFrame:
        out = offline_intent(requests, text).drop("function_categories")
        found = intent.best(intent.scores(requests, "request_id", text, model), "request_id", k)
        found = found.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]).alias("function_categories"))
        return out.join(found, "request_id", "left").withColumn("function_categories", F.coalesce("function_categories", F.array().cast("array<string>")))

    return analyse


GENERATED = "template_id string, llm_response string, prompt_tokens long, completion_tokens long, error string"


def generate(templates: DataFrame, call: Callable[[str], tuple[str, int, int]], retries: int = 3, wait: float = 2.0, parallel: int = 4) -> DataFrame:
    """A record per template (template_id, description): ``call`` gets the prompt and gives answer and usage.

    Unusable descriptions become error records without a call; a call that fails is repeated with growing
    waits and then recorded. ``parallel`` bounds the calls at a time.
    """
    status = description_status(F.col("description"))
    todo = templates.select(F.col("template_id").cast("string"), F.when(status == "ok", ascii_only(F.col("description"))).alias("prompt"), status.alias("status"))
    message = {"empty": "empty description", "no_ascii": "no ASCII text in description"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                if r.status != "ok":
                    rows.append((r.template_id, None, None, None, message[r.status]))
                    continue
                for attempt in range(retries):
                    try:
                        answer, a, b = call(r.prompt)
                        rows.append((r.template_id, answer, a, b, None))
                        break
                    except Exception as e:  # noqa: BLE001 - recorded
                        if attempt == retries - 1:
                            rows.append((r.template_id, None, None, None, str(e)))
                        else:
                            time.sleep(wait * 2**attempt)
            yield pd.DataFrame(rows, columns=["template_id", "llm_response", "prompt_tokens", "completion_tokens", "error"]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    out = todo.repartition(parallel, "template_id").mapInPandas(run, GENERATED)
    return out.withColumn("error", short_error(F.col("error")))
