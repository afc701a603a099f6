"""Documents of long chains: the work grows with the chain, and repeated names share an entry."""

import json
import time

from pyspark.sql import functions as F

from pathloom.operators import report


def test_documents_of_long_chains(spark):
    n = 20_000
    path = [f"t.x{i % 7}" if i % 3 else f"t.y{i}" for i in range(n)]
    c = spark.createDataFrame([(1, "w", path), (2, "w", ["t.a"]), (3, "w", ["t.b", "t.a", "t.b", "t.b"])], "id int, workflow_name string, path array<string>")
    begin = time.time()
    docs = {r.id: json.loads(r.document) for r in report.workflow_json(c).where(F.col("document").isNotNull()).collect()}
    assert time.time() - begin < 60
    for i, p in ((1, path), (2, ["t.a"]), (3, ["t.b", "t.a", "t.b", "t.b"])):
        names = [t.split(".")[1].capitalize() for t in p]
        want: dict[str, list[str]] = {}
        for a, b in zip(names, names[1:]):
            want.setdefault(a, []).append(b)
        got = docs[i]["connections"]
        assert list(got) == list(want) and {a: [t["node"] for t in v["main"][0]] for a, v in got.items()} == want
        assert [x["name"] for x in docs[i]["nodes"]] == names
