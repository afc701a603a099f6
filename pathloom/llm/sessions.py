"""Gap sessionisation by triage: SQL windows finish what they can, only overlong islands are cut greedily.

A client's timely clicks, in order of time and id, form hard islands: a click opens one if the client has no earlier
click, the previous click is final, or it lies at least ``gap`` back. An island whose span is within ``longest`` is one
session. In an overlong one, a click more than ``longest`` after its session's first opens the next session, which depends
on all sessions before it; these islands alone go to grouped Arrow functions.

Nothing holds all clicks of a client. Windows run over a client's clicks of one ``SLOT``; what they need of other slots
(the click before, the click after, the island that goes on) comes from a row a client and slot, windowed by client: as
many rows as the client has active slots, whatever it does in them. Overlong islands are cut in stretches of ``STRETCH``.
Where islands are longer than that, each stretch first maps every click at which a session may enter it to the entry of the next
stretch; those maps are composed with themselves until all true entries are known (as many rounds as the logarithm of the
number of stretches), and then all stretches are cut at once.

Defined results: rows without client_id, ts or click_id take no part. Rows that repeat a click_id count once; if they differ,
the first to arrive counts (ties: the smaller ts, client, value in cents). Without arrived_at, a click is timely. A null or
non-finite value counts as 0 cents (NaN compares above all numbers, as in SQL, so it can be final). Equal times are
ordered by click_id. A late click belongs to the client's last session that starts at or before it, if any. An empty
table gives an empty result. Other columns are ignored; texts (``props``) are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, store, table

MINUTE = 60_000_000
GAP, LONGEST, LATE, SLOT, STRETCH = 15 * MINUTE, 60 * MINUTE, 15 * MINUTE, 60 * MINUTE, 360 * MINUTE
FINAL_KINDS, FINAL_VALUE = ("purchase", "signup"), 60.0
ISLAND = ["client_id", "island_us", "island_id"]
_ROW = ["us", "click_id", "late", "cents", "reason"]
_CUT = "client_id long, us long, click_id long, late boolean, cents long, reason string, start_us long, session_id long"
_HOP = "client_id long, island_us long, island_id long, stretch long, entry_us long, entry_id long, from_us long, from_id long, exit_us long, exit_id long"


def microseconds(df: DataFrame, name: str) -> Column:
    """A time as microseconds since 1970; one without a zone is taken as it stands, whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(F.col(name))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name).cast("timestamp_ntz"))


def prepared(clicks: DataFrame, late: int = LATE, kinds: tuple[str, ...] = FINAL_KINDS, value: float = FINAL_VALUE) -> DataFrame:
    """client_id, us, click_id, late, final, cents: each click once, of fixed width."""
    v, arrived = F.col("value"), microseconds(clicks, "arrived_at")
    finite = F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    d = clicks.select(
        F.col("click_id").cast("long").alias("click_id"), arrived.alias("arrived"), microseconds(clicks, "ts").alias("us"), F.col("client_id").cast("long").alias("client_id"),
        F.when(finite, F.floor(100 * v + 0.5)).otherwise(F.lit(0)).cast("long").alias("cents"), F.coalesce(F.col("kind").isin(*kinds) & (v >= value), F.lit(False)).alias("final"),
    ).where("click_id IS NOT NULL AND client_id IS NOT NULL AND us IS NOT NULL")
    once = d.groupBy("click_id").agg(F.min(F.struct("arrived", "us", "client_id", "cents", "final")).alias("c"))
    return once.select("c.client_id", "c.us", "click_id", F.coalesce(F.col("c.arrived") - F.col("c.us") > late, F.lit(False)).alias("late"), "c.final", "c.cents")


def islands(clicks: DataFrame, gap: int = GAP, slot: int = SLOT) -> DataFrame:
    """Rows of ``prepared`` with ``reason`` (what ends the session if this timely click is its last), the first click of
    their island (island_us, island_id) and the island's last time (island_end); late clicks before any island go."""
    here, late, timely, us = "PARTITION BY client_id, slot ORDER BY us, late, click_id", F.col("late"), ~F.col("late"), F.col("us")
    rows = clicks.withColumn("slot", F.floor(us / slot)).withColumns({
        "before": F.expr(f"lag(if(late, NULL, struct(us, final))) IGNORE NULLS OVER ({here})"),
        "next_us": F.expr(f"lead(if(late, NULL, us)) IGNORE NULLS OVER ({here})"),
    })
    breaks = lambda before, after: before["final"] | (after - before["us"] >= gap)
    mine = F.struct("us", "final")
    rows = rows.withColumns({
        "opening": F.when(timely & F.col("before").isNotNull() & breaks(F.col("before"), us), F.struct("us", "click_id")),
        "closing": F.when(timely & F.col("next_us").isNotNull() & breaks(mine, F.col("next_us")), us),
    })

    # one row a client and slot: what a slot's clicks need of the client's other slots
    slots = rows.groupBy("client_id", "slot").agg(
        F.min(F.when(timely, F.struct("us", "click_id"))).alias("first"), F.max(F.when(timely, F.struct("us", "click_id", "final"))).alias("final_click"),
        F.max("opening").alias("opening"), F.min("closing").alias("closing"),
    )
    along = "PARTITION BY client_id ORDER BY slot"
    slots = slots.withColumns({
        "last": F.expr(f"lag(final_click) IGNORE NULLS OVER ({along})"),
        "follows": F.expr(f"lead(first.us) IGNORE NULLS OVER ({along})"),
    })
    opens = F.coalesce(breaks(F.col("last"), F.col("first.us")), F.lit(True))
    closes = F.coalesce(breaks(F.col("final_click"), F.col("follows")), F.lit(True))
    slots = slots.withColumns({"entered": F.when(F.col("first").isNotNull() & opens, F.col("first")), "left": F.when(F.col("final_click").isNotNull() & closes, F.col("final_click.us"))})
    slots = slots.withColumns({"reached": F.coalesce("opening", "entered"), "reaches": F.coalesce("closing", "left")})
    slots = slots.withColumns({"carried": F.expr(f"lag(reached) IGNORE NULLS OVER ({along})"), "ahead": F.expr(f"lead(reaches) IGNORE NULLS OVER ({along})")})
    slots = slots.select(
        F.col("client_id").alias("c"), F.col("slot").alias("s"), "follows", "carried", F.struct("last.us", "last.final").alias("last"),
        F.coalesce("entered", "carried").alias("entered"), F.coalesce("left", "ahead").alias("left"),
    )

    to_here = W.partitionBy("client_id", "slot").orderBy("us", "late", "click_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"opened": F.last("opening", ignorenulls=True).over(to_here), "closed": F.coalesce("closing", F.expr(f"lead(closing) IGNORE NULLS OVER ({here})"))})
    rows = rows.join(slots, (F.col("client_id") == F.col("c")) & (F.col("slot") == F.col("s")))
    early = late & F.col("before").isNull()  # a late click before the slot's first timely one
    island, next_us = F.coalesce("opened", F.when(early, F.col("carried")).otherwise(F.col("entered"))), F.coalesce("next_us", "follows")
    reason = F.when(late, None).when(F.col("final"), "end").when(next_us.isNull(), "none").when(next_us - us >= gap, "gap").otherwise("length")
    before = F.coalesce("before", "last")
    over = late & F.coalesce(breaks(before, next_us), F.lit(True))  # a late click behind its island
    end = F.when(over, before["us"]).otherwise(F.coalesce("closed", "left"))
    rows = rows.select("client_id", "us", "click_id", "late", "cents", reason.alias("reason"), island.alias("i"), end.alias("island_end")).where("i IS NOT NULL")
    return rows.withColumns({"island_us": F.col("i.us"), "island_id": F.col("i.click_id")}).drop("i")


def _timely(group: pa.Table) -> tuple[np.ndarray, ...]:
    """us and click_id of a group's timely rows in order, and which of them are lent by the next stretch."""
    keep = ~group.column("late").to_numpy()
    us, ids, lent = (group.column(c).to_numpy()[keep] for c in ("us", "click_id", "lent"))
    order = np.lexsort((ids, us))
    return us[order], ids[order], lent[order]


def _hops(longest: int, gap: int):
    """For each click at which a session may enter a stretch: the stretch's last session start, the next one's first."""

    def run(group: pa.Table) -> pa.Table:
        us, ids, lent = _timely(group)
        own, stretch = int((~lent).sum()), group.column("stretch")[0].as_py()
        begin = group.column("begin")[0].as_py()
        after = np.searchsorted(us, us + longest, "right")
        last = np.arange(own)
        for i in range(own - 1, -1, -1):
            if after[i] < own:
                last[i] = last[after[i]]
        entries = np.flatnonzero(us[:own] < begin + longest + gap) if stretch else np.arange(min(own, 1))
        ends = last[entries]
        exits = after[ends]
        there = exits < len(us)
        at = np.minimum(exits, max(len(us) - 1, 0))
        same = [pa.array([group.column(c)[0].as_py()] * len(entries), pa.int64()) for c in [*ISLAND, "stretch"]]
        moved = [pa.array(x[i]) for x, i in ((us, entries), (ids, entries), (us, ends), (ids, ends))]
        out = [pa.array(x[at], mask=~there) for x in (us, ids)]
        return pa.table([*same, *moved, *out], names=[f.split()[0] for f in _HOP.split(", ")])

    return run


def _cuts(longest: int):
    """Cuts one stretch, from its entry on; rows before it belong to the session that came in."""

    def run(group: pa.Table) -> pa.Table:
        us, ids, late, ends = (group.column(c).to_numpy() for c in ("us", "click_id", "late", "island_end"))
        us = np.minimum(us, ends)  # a late click behind the island belongs to its last session
        order = np.lexsort((ids, late, us))
        us, ids, late = us[order], ids[order], late[order]
        timely = np.flatnonzero(~late)
        entry_us, entry_id, from_us, from_id = (group.column(c)[0].as_py() for c in ("entry_us", "entry_id", "from_us", "from_id"))
        start = np.full(len(us), -1, np.int64)
        if entry_us is not None:
            i = int(np.flatnonzero((us[timely] == entry_us) & (ids[timely] == entry_id))[0])
            while i < len(timely):
                start[timely[i]] = timely[i]
                i = int(np.searchsorted(us[timely], us[timely[i]] + longest, "right"))
        start = np.maximum.accumulate(start)
        first_us, first_id = np.where(start >= 0, us[start], from_us or 0), np.where(start >= 0, ids[start], from_id or 0)
        taken = group.select(["client_id", *_ROW]).take(pa.array(order))
        return taken.append_column("start_us", pa.array(first_us, pa.int64())).append_column("session_id", pa.array(first_id, pa.int64()))

    return run


def _entries(rows: DataFrame, stretches: int, longest: int, gap: int, stretch: int) -> DataFrame:
    """Island, stretch, its first session start (entry_us, entry_id; null if none) and the start that came in (from_us, from_id)."""
    near = (F.col("offset") % stretch < longest + gap) & (F.col("stretch") > 0) & ~F.col("late")
    lent = rows.where(near).withColumns({"stretch": F.col("stretch") - 1, "lent": F.lit(True)})
    both = rows.withColumn("lent", F.lit(False)).unionByName(lent).withColumn("begin", F.col("island_us") + F.col("stretch") * stretch)
    hops = cut(both.select(*ISLAND, "stretch", "begin", "us", "click_id", "late", "lent").groupBy(*ISLAND, "stretch").applyInArrow(_hops(longest, gap), _HOP))
    step = F.col("stretch") + 1
    jump = hops.select(*ISLAND, "stretch", "entry_us", "entry_id", step.alias("to"), "exit_us", "exit_id", "from_us", "from_id")
    none = F.lit(None).cast("long")
    known = hops.where("stretch = 0").select(*ISLAND, "stretch", "entry_us", "entry_id", none.alias("from_us"), none.alias("from_id"))
    at, steps = [*ISLAND, "stretch", "entry_us", "entry_id"], 1
    while True:
        onward = known.select(*at).join(jump, at).select(*ISLAND, F.col("to").alias("stretch"), F.col("exit_us").alias("entry_us"), F.col("exit_id").alias("entry_id"), "from_us", "from_id")
        known = cut(known.unionByName(onward).repartition(*ISLAND, "stretch"))
        steps *= 2
        if steps > 2 * stretches:
            return known
        second = jump.select(*ISLAND, F.col("stretch").alias("to"), F.col("entry_us").alias("exit_us"), F.col("entry_id").alias("exit_id"), F.col("to").alias("to2"), F.col("exit_us").alias("us2"), F.col("exit_id").alias("id2"), F.col("from_us").alias("fu2"), F.col("from_id").alias("fi2"))
        jump = cut(jump.join(second, [*ISLAND, "to", "exit_us", "exit_id"]).select(*at, F.col("to2").alias("to"), F.col("us2").alias("exit_us"), F.col("id2").alias("exit_id"), F.col("fu2").alias("from_us"), F.col("fi2").alias("from_id")))


def sessionised(clicks: DataFrame, gap: int = GAP, longest: int = LONGEST, late: int = LATE, slot: int = SLOT, stretch: int = STRETCH) -> DataFrame:
    """client_id, us, click_id, late, cents, reason and the first click of the row's session (start_us, session_id)."""
    offset = F.least("us", "island_end") - F.col("island_us")
    seen, overlong = Observation(), F.col("island_end") - F.col("island_us") > longest
    most = F.max(F.when(overlong, F.floor((F.col("island_end") - F.col("island_us")) / stretch)))
    rows = store(islands(prepared(clicks, late), gap, slot).observe(seen, most.alias("most")))
    stretches = seen.get.get("most")
    done = rows.where(~overlong).select("client_id", *_ROW, F.col("island_us").alias("start_us"), F.col("island_id").alias("session_id"))
    if stretches is None:
        return done
    left = rows.where(overlong).withColumn("offset", offset).withColumn("stretch", F.floor(F.col("offset") / stretch))
    if stretches:
        known = _entries(left, stretches, longest, gap, stretch)
        left = left.join(known, [*ISLAND, "stretch"])
    else:
        none = F.lit(None).cast("long")
        left = left.withColumns({"entry_us": F.col("island_us"), "entry_id": F.col("island_id"), "from_us": none, "from_id": none})
    return done.unionByName(left.groupBy(*ISLAND, "stretch").applyInArrow(_cuts(longest), _CUT))


def summary(rows: DataFrame) -> DataFrame:
    """A row a session, of rows as ``sessionised`` returns them."""
    timely = ~F.col("late")
    path = F.transform(F.array_sort(F.collect_list(F.when(timely, F.struct("us", "click_id")))), lambda c: c["click_id"].cast("string"))
    return rows.groupBy("client_id", "session_id", "start_us").agg(
        F.max(F.when(timely, F.col("us"))).alias("end_us"), F.count_if(timely).alias("n_clicks"), F.count_if("late").alias("n_late"),
        F.coalesce(F.sum(F.when(timely, F.col("cents"))), F.lit(0)).alias("value_cents"), F.max_by("reason", F.when(timely, F.struct("us", "click_id"))).alias("closed_by"),
        F.sha2(F.array_join(path, ",").cast("binary"), 256).alias("path_sha256"),
    )


def op11_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(sessionised(table(spark, sf_dir, "clicks")))
