import pytest

from reelquarry.plans import kernels, media_queries
from tests.compare import assert_same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(kernels.SQL | media_queries.SQL))
def test_kernel_equals_sql(spark, oracle, name):
    assert_same((kernels.QUERIES | media_queries.QUERIES)[name](spark, str(SF)), (kernels.SQL | media_queries.SQL)[name], oracle)


def test_later_wins_equals_plain_replay(spark):
    import random

    from reelquarry.operators.overlay import later_wins

    random.seed(3)
    rows = [(key, k, a := random.randint(-40, 60), a + random.randint(-2, 30), f"e{k}") for key, n in (("a", 1), ("b", 30), ("c", 120)) for k in range(n)]
    got = later_wins(spark.createDataFrame(rows, "key string, n long, lo long, hi long, name string"), ["key"], "n", "lo", "hi", ["name"]).collect()
    heard = {}
    for key, k, a, b, _ in rows:
        heard.update({(key, at): k for at in range(a, b)})
    assert {(r["key"], at): r["n"] for r in got for at in range(r["seg_start"], r["seg_end"])} == heard
    assert all(r["name"] == f"e{r['n']}" and r["seg_end"] > r["seg_start"] for r in got)
    ends = {(r["key"], r["seg_end"]): r["n"] for r in got}
    assert not any(ends.get((r["key"], r["seg_start"])) == r["n"] for r in got)


def test_later_wins_cuts_crowded_timelines(spark):
    import random

    from reelquarry.operators.overlay import later_wins

    random.seed(5)
    spans = [(a := random.choice([random.randint(0, 3000), 700]), a + random.choice([3, 40, 900, 2500])) for _ in range(3000)]
    rows = [("hot", k, a, b, f"e{k}") for k, (a, b) in enumerate(spans)] + [("cold", k, a, b, f"e{k}") for k, (a, b) in enumerate(spans[:50])]
    rows += [("long", k, 5 * k, 5 * k + 4, f"e{k}") for k in range(300)] + [("long", 1000, 200, 1300, "e1000"), (None, 1, 0, 5, "e1"), ("hot", 9999, 4000, 4000, "e9999")]
    events = spark.createDataFrame(rows, "key string, n long, lo long, hi long, name string")
    for most in (40, 100, 100_000):
        got = later_wins(events, ["key"], "n", "lo", "hi", ["name"], most).collect()
        heard = {}
        for key, k, a, b, _ in rows:
            if key:
                heard.update({(key, at): k for at in range(a, b)})
        assert {(r["key"], at): r["n"] for r in got for at in range(r["seg_start"], r["seg_end"])} == heard
        assert sum(r["seg_end"] - r["seg_start"] for r in got) == len(heard)
        assert all(r["name"] == f"e{r['n']}" for r in got)
        ends = {(r["key"], r["seg_end"]): r["n"] for r in got}
        assert not any(ends.get((r["key"], r["seg_start"])) == r["n"] for r in got)


def test_later_wins_holds_a_batch(spark, monkeypatch):
    """Groups that run on over batches, and one that is larger than a batch."""
    from collections import Counter

    import pyarrow as pa

    from reelquarry.operators import overlay

    class Rows:
        schema = None

        def __getattr__(self, name):
            return lambda *a: a[0] if name == "mapInArrow" else self

    monkeypatch.setattr(overlay, "ROWS", 64)
    sizes = [1, 500, 3, 60, 70, 2, 200]
    rows = [(g, 10 * (k % 37), 10 * (k % 37) + 10 + k % 50, k) for g, n in enumerate(sizes) for k in range(n)]
    whole = pa.RecordBatch.from_pylist([dict(zip(("g", "lo", "hi", "n"), r, strict=True)) for r in rows])
    held = []
    replay = overlay._replay
    monkeypatch.setattr(overlay, "_replay", lambda rows, n: held.append(rows.num_rows) or replay(rows, n))
    got = [r for b in overlay._replayed(Rows(), ["g"])(whole.slice(k, 10) for k in range(0, len(rows), 10)) for r in b.to_pylist()]
    heard = {}
    for g, lo, hi, n in rows:
        heard.update({(g, at): n for at in range(lo, hi)})
    assert Counter((r["g"], at, r["n"]) for r in got for at in range(r["lo"], r["hi"])) == Counter((g, at, n) for (g, at), n in heard.items())
    assert max(held) < 500


def test_later_wins_shuffles_an_event_once(spark):
    """What a timeline is replayed from goes over the network once, and no row is made for each node and piece of it."""
    import re

    from reelquarry.operators.overlay import later_wins

    events = spark.createDataFrame([("a", 1, 0, 5, "x"), ("a", 2, 3, 9, "y")], "key string, n long, lo long, hi long, name string")
    plan = later_wins(events, ["key"], "n", "lo", "hi", ["name"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and not re.search("Generate|Join|Window", plan)


def test_offsets_and_segments(spark):
    from reelquarry.operators.lookup import offset_to_segment

    segments = spark.createDataFrame([("a", 0, 5, "x"), ("a", 5, 0, "none"), ("a", 5, 3, "y"), ("a", 20, 2, "z"), ("b", 3, 1, "w")], "key string, log_start long, length long, name string")
    offsets = spark.createDataFrame([(k, at) for k in "abc" for at in range(-1, 25)], "key string, at long")
    got = {(r["key"], r["at"]): r["name"] for r in offset_to_segment(offsets, segments, ["key"], "at").collect()}
    want = {("a", k): "x" for k in range(5)} | {("a", k): "y" for k in (5, 6, 7)} | {("a", k): "z" for k in (20, 21)} | {("b", 3): "w"}
    assert got == want
