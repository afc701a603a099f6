"""Categories against log odds by hand, and parameters in texts."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pathloom.operators import intent
from pathloom.plans import providers

TEXTS = [("mail", "send an email to people"), ("mail", "read the inbox"), ("data", "store rows in a database table"), ("chat", "send a message"), (None, "nothing"), ("data", None)]


def test_categories_by_hand(spark):
    model = intent.fit(spark.createDataFrame(TEXTS, "category string, text string"), "category", "text")
    asked = ["Send an Email, send it", "database of people", "qqq", None, "a a the table"]
    got = {(r.id, r.category): (r.score, r.support) for r in intent.scores(spark.createDataFrame(list(enumerate(asked)), "id int, text string"), "id", "text", model).collect()}
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    own = {c: Counter(w for k, t in TEXTS if k == c for w in split(t)) for c in ("mail", "data", "chat")}
    every = sum(own.values(), Counter())
    want = {}
    for i, t in enumerate(asked):
        known = [w for w in split(t) if w in every]
        for c in own if known else ():
            rest = sum(every.values()) - sum(own[c].values())
            score = -sum(math.log((every[w] - own[c][w] + 1) / (len(every) + rest)) for w in known)
            want[i, c] = (score, sum(w in own[c] for w in known))
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_parameters(spark):
    texts = ["key=v1, key = v2; Name: 'a b' see https://x.org/a?b=1. mail me@x.org at 9:30 on 2024-05-06, 17 times", "", None, "no 1a, v2.0 or 3:4:5x", 'retry="x y" -2.5']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", intent.parameters(F.col("text")).alias("p"))
    got = {r.id: r.p for r in df.collect()}
    first = got[0]
    assert first["key"] == "v1" and first["Name"] == "a b" and first["url"] == "https://x.org/a?b=1" and first["email"] == "me@x.org"
    assert first["time"] == "9:30" and first["date"] == "2024-05-06" and first["number"] == "17"
    assert got[1] == got[2] == got[3] == {} and got[4] == {"retry": "x y", "number": "-2.5"}


def test_fitted_intent(spark):
    leaves = spark.createDataFrame([("1 Mail -> Send", "send an email", ["p.emailSend"]), ("2 Data -> Store", "store rows in a table", ["p.postgres"])], "path_str string, combined_text string, mapped_nodes array<string>")
    asked = spark.createDataFrame([(1, "put rows into a table, table=orders"), (2, "qqq")], "request_id int, text string")
    got = {r.request_id: r for r in providers.fitted_intent(leaves, 1)(asked).collect()}
    assert got[1].function_categories == ["Data"] and got[1].parameters["table"] == "orders" and got[2].function_categories == []
