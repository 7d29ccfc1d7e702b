"""The engine's relational kernels over ordinary tables, with SQL that computes the same.

These queries show the kernels, not media: each docstring says which columns stand for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import grouping, lookup, ordering, overlay


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """events as an edit list: a user's timeline of seconds of the day, errors erase."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return _t(spark, folder, "events").select(
        "user_id", "event_id", second.cast("long").alias("start"), (second + F.lit(600) + F.col("event_id") % 3600).cast("long").alias("end"),
        (F.col("event_type") != "error").alias("audible"), "ts", "event_type",
    )


def kernel_later_wins_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines by user after all edits; the later event wins, an erasing one too."""
    return overlay.later_wins(_edits(spark, folder), ["user_id"], "event_id", "start", "end", ["audible"])


def kernel_island_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive event numbers of one type."""
    events = _t(spark, folder, "events").select("event_type", "event_id")
    return grouping.runs(events, "event_id", ["event_type"])


def kernel_track_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tracks, their lines as events: returned lines are audio, the line number stands for the end."""
    lines = _t(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("long").alias("end"))
    return grouping.track_stats(lines, ["l_orderkey"], F.col("l_returnflag") == "R", "end", F.lit(2)).filter("has_audio")


def kernel_catalog_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as songs, orders as tracks, priced above a limit as audio."""
    orders = _t(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    end = F.floor("o_totalprice").cast("long")
    stats = grouping.track_stats(orders.withColumn("end", end), ["o_custkey", "o_orderkey"], F.col("o_totalprice") > 150000, "end", F.lit(12))
    return grouping.song_summary(stats, ["o_custkey"])


def kernel_stamp_span(spark: SparkSession, folder: str) -> DataFrame:
    """First and last stamp of each user's events."""
    return grouping.stamp_span(_t(spark, folder, "events").select("user_id", "ts"), ["user_id"], "ts")


def kernel_latest_stamp(spark: SparkSession, folder: str) -> DataFrame:
    """The latest stamp of each type of event."""
    return grouping.stamp_span(_t(spark, folder, "events"), ["event_type"], "ts").drop("first_stamp")


def kernel_first_seen_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Types of events in the order in which they first appear."""
    return grouping.first_seen_groups(_t(spark, folder, "events"), "event_type", "event_id")


def kernel_distinct_refs_max(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as songs, parts as takes; the quantity is the claimed count."""
    lines = _t(spark, folder, "lineitem").select(
        "l_suppkey", "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("long").alias("count")
    )
    return grouping.distinct_references(lines, ["l_suppkey"], "l_partkey", "seq", "count")


def kernel_ref_left_join_miss(spark: SparkSession, folder: str) -> DataFrame:
    """Lines refer to parts; parts above a size are not there."""
    refs = _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("partkey"))
    parts = _t(spark, folder, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("partkey"), "p_size")
    return lookup.resolve_references(refs, parts, ["partkey"], "p_size")


def kernel_duplicate_refs_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Brands looked up where several parts have one: the part with the highest key wins."""
    parts = _t(spark, folder, "part")
    refs = parts.select("p_brand").distinct()
    return lookup.resolve_references(refs, parts.select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey")


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    nations = _t(spark, folder, "nation").filter("n_regionkey = 1").select((F.col("n_nationkey").cast("long") * 7).alias("c_custkey"))
    return nations.union(spark.range(1).select(F.lit(-5).cast("long")))


def kernel_key_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose key is wanted."""
    return lookup.wanted(_t(spark, folder, "customer").select("c_custkey", "c_name"), _keys(spark, folder), ["c_custkey"])


def kernel_key_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted keys that no customer has."""
    return lookup.not_found(_keys(spark, folder), _t(spark, folder, "customer"), ["c_custkey"])


def kernel_top1_election(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as backup sets of suppliers: one with a supplier in good standing first, then the larger, then the lower key."""
    sets = _t(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.bool_or(F.col("s_acctbal") > 9000).alias("has_first"), F.count(F.lit(1)).alias("size")
    )
    return ordering.elect(sets, [], [(~F.col("has_first")), -F.col("size"), F.col("s_nationkey")])


def _discs(spark: SparkSession, folder: str) -> DataFrame:
    lines = _t(spark, folder, "lineitem").filter("l_linenumber <> 3 OR l_orderkey % 3 = 0")
    return lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("index"), "l_partkey", F.lit(5).alias("total"))


def kernel_contiguous_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sets, lines as discs: which continue the run from 0."""
    return ordering.contiguous(_discs(spark, folder), ["l_orderkey"], "index", "l_partkey").select("l_orderkey", "index", "l_partkey", "status")


def kernel_missing_index(spark: SparkSession, folder: str) -> DataFrame:
    """Indices that the sets of kernel_contiguous_prefix lack, as each cause reports them."""
    placed = ordering.contiguous(_discs(spark, folder), ["l_orderkey"], "index", "l_partkey")
    return ordering.missing_indices(placed, ["l_orderkey"], "index", "total")


def kernel_adjacent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as songs, suppliers as tracks; equal tens of thousands of the balance are equal geometry."""
    own = _t(spark, folder, "customer").select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 4000).cast("long").alias("geometry"))
    tracks = ordering.ordinals(own, ["c_nationkey"], "c_custkey", "track")
    return ordering.adjacent_pairs(tracks, ["c_nationkey"], "track", "geometry")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    orders = _t(spark, folder, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("length"))
    return ordering.running_offsets(orders, ["k"], "o_orderkey", "length")


def kernel_running_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's orders laid end to end."""
    return _segments(spark, folder)


def kernel_offset_to_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Which of a customer's orders holds each of a few places."""
    places = _t(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 150, 900)])).alias("offset"))
    return lookup.offset_to_segment(places, _segments(spark, folder), ["k"], "offset")


def kernel_carry_lag(spark: SparkSession, folder: str) -> DataFrame:
    """What each event carries over from the one before, 0 after an error."""
    value = F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id"))
    return ordering.carried(_t(spark, folder, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", value)


def kernel_per_partition_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers numbered from 0 in each nation."""
    return ordering.ordinals(_t(spark, folder, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey")


def kernel_key_format(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and folder names of nations: the region is the partition."""
    n = _t(spark, folder, "nation")
    return n.select("n_nationkey", fn.song_key(F.col("n_regionkey"), F.col("n_nationkey")).alias("song_key"), fn.folder_name(F.col("n_regionkey"), F.col("n_nationkey")).alias("folder"))


def kernel_key_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of keys read back, bad ones among them."""
    n = _t(spark, folder, "nation")
    text = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit(" "), F.col("n_nationkey"))).when(
        F.col("n_nationkey") % 4 == 1, F.concat(F.col("n_regionkey"), F.lit(".0"), F.col("n_nationkey"))
    ).when(F.col("n_nationkey") % 4 == 2, F.col("n_name")).otherwise(F.concat(F.col("n_nationkey"), F.lit(".1.2")))
    key = fn.parse_song_key(text)
    return n.select("n_nationkey", text.alias("text"), key["partition"].alias("part"), key["ordinal"].alias("ordinal"))


def kernel_length_mmss(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of orders: the price in frames, at a rate by the order's key."""
    rate, known = lookup.coded((F.col("o_orderkey") % 8).cast("int"), fn.RATES, fn.DEFAULT_RATE)
    whole = fn.seconds(F.floor("o_totalprice").cast("long"), rate)
    return _t(spark, folder, "orders").select("o_orderkey", rate.alias("rate"), known.alias("known"), whole.alias("seconds"), fn.mmss(whole).alias("length"))


def kernel_name_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as track names: trimmed, default ones empty, fit for a path."""
    p = _t(spark, folder, "part")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("V.T "), F.col("p_partkey"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" "), F.col("p_name"), F.lit("/2 "))).otherwise(F.col("p_name"))
    return p.select("p_partkey", fn.track_name(raw).alias("track_name"), fn.file_name(raw).alias("file_name"))


def kernel_lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by the low four bits of a part's size, with the default for unknown codes."""
    rate, known = lookup.coded(F.col("p_size").bitwiseAND(15), fn.RATES, fn.DEFAULT_RATE)
    return _t(spark, folder, "part").select("p_partkey", rate.alias("rate"), known.alias("known"))


def kernel_integrity_shortfall(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose lines are fewer than their key claims."""
    have = _t(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("have"))
    claimed = _t(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("claimed"))
    return claimed.join(have, "o_orderkey", "left").fillna(0, ["have"]).filter("have < claimed")


def kernel_deviation_union(spark: SparkSession, folder: str) -> DataFrame:
    """Deviations of several checks in one table, each with its rendered line."""
    customers, parts = _t(spark, folder, "customer"), _t(spark, folder, "part")
    one = customers.filter("c_acctbal < 0").select(F.lit(2).alias("level"), F.lit("§1").alias("ref"), F.col("c_name").alias("loc"), F.lit("balance below zero").alias("message"))
    two = parts.filter("p_size > 45").select(F.lit(1).alias("level"), F.lit("").alias("ref"), F.col("p_name").alias("loc"), F.concat(F.lit("size "), F.col("p_size")).alias("message"))
    both = one.unionByName(two)
    return both.withColumn("line", fn.deviation_text(F.col("level"), F.col("ref"), F.col("loc"), F.col("message")))


def kernel_set_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The declared total of sets (order priorities): the first disc's if above 0, all totals, the highest index and one."""
    o = _t(spark, folder, "orders").select("o_orderpriority", (F.col("o_orderkey") % 11).alias("index"), (F.col("o_custkey") % 9).alias("total"))
    return o.groupBy("o_orderpriority").agg(F.greatest(F.max("total"), F.max("index") + 1).alias("declared"), F.bool_or(F.col("total") == 0).alias("any_without"))


def kernel_sample_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of customers' names by nation, in key order."""
    c = _t(spark, folder, "customer")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "")
    return c.groupBy("c_nationkey").agg(F.sha2(names, 256).alias("digest"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("kernel_")}

_RATE = "CASE {0} WHEN 0 THEN 48000 WHEN 1 THEN 44100 WHEN 2 THEN 32000 WHEN 3 THEN 96000 WHEN 4 THEN 88200 ELSE 44100 END"
_DISCS = "SELECT l_orderkey, l_linenumber - 1 AS index, l_partkey, 5 AS total FROM lineitem WHERE l_linenumber <> 3 OR l_orderkey % 3 = 0"
_PLACED = f"""
copies AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, index ORDER BY l_partkey) AS copy FROM ({_DISCS})),
placed AS (SELECT *, CASE WHEN copy > 1 THEN 'duplicate'
    WHEN index = sum((copy = 1)::INT) OVER (PARTITION BY l_orderkey ORDER BY index, l_partkey ROWS UNBOUNDED PRECEDING) - 1 THEN 'kept' ELSE 'stranded' END AS status FROM copies)"""
_SEGMENTS = """SELECT o_custkey AS k, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS length,
    coalesce(sum(floor(o_totalprice / 1000)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS log_start
    FROM orders"""
_KEYS = "SELECT n_nationkey::BIGINT * 7 AS c_custkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT -5"

SQL = {
    "kernel_later_wins_overlay": """
        WITH e AS (SELECT user_id, event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s, hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 600 + event_id % 3600 AS t, event_type <> 'error' AS audible FROM events),
        p AS (SELECT user_id, s AS x FROM e UNION SELECT user_id, t FROM e),
        q AS (SELECT user_id, x, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS y FROM p),
        w AS (SELECT q.user_id, x, y, max(event_id) AS event_id, arg_max(audible, event_id) AS audible FROM q JOIN e ON q.user_id = e.user_id AND s <= x AND t >= y GROUP BY ALL),
        f AS (SELECT *, CASE WHEN lag(y) OVER o = x AND lag(event_id) OVER o = event_id THEN 0 ELSE 1 END AS fresh FROM w WINDOW o AS (PARTITION BY user_id ORDER BY x)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY x) AS run FROM f)
        SELECT user_id, min(x)::BIGINT AS seg_start, max(y)::BIGINT AS seg_end, any_value(event_id) AS event_id, any_value(audible) AS audible FROM r GROUP BY user_id, run""",
    "kernel_island_runs": """
        SELECT event_type, min(event_id) AS low, max(event_id) AS high, count(*) AS n
        FROM (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM (SELECT DISTINCT event_type, event_id FROM events)) GROUP BY event_type, g""",
    "kernel_track_stats": """
        SELECT l_orderkey, count(*) AS n_events, bool_or(l_returnflag = 'R') AS has_audio, greatest(0, max(l_linenumber) - 2)::BIGINT AS end_frames
        FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')""",
    "kernel_catalog_summary": """
        SELECT o_custkey, count(*) FILTER (audio) AS n_tracks, coalesce(max(e) FILTER (audio), 0)::BIGINT AS frames
        FROM (SELECT o_custkey, o_orderkey, bool_or(o_totalprice > 150000) AS audio, greatest(0, max(floor(o_totalprice)::BIGINT - 12)) AS e FROM orders GROUP BY ALL) GROUP BY 1""",
    "kernel_stamp_span": "SELECT user_id, min(ts) AS first_stamp, max(ts) AS last_stamp FROM events GROUP BY 1",
    "kernel_latest_stamp": "SELECT event_type, max(ts) AS last_stamp FROM events GROUP BY 1",
    "kernel_first_seen_groups": "SELECT event_type, min(event_id) AS first_seen, count(*) AS n_members, row_number() OVER (ORDER BY min(event_id)) AS group_no FROM events GROUP BY 1",
    "kernel_distinct_refs_max": "SELECT l_suppkey, l_partkey, min(l_orderkey * 8 + l_linenumber) AS first_seen, max(l_quantity::BIGINT) AS most FROM lineitem WHERE l_partkey <> 0 GROUP BY 1, 2",
    "kernel_ref_left_join_miss": """
        SELECT l_orderkey, l_linenumber, l_partkey AS partkey, p_partkey IS NOT NULL AS found, p_size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""",
    "kernel_duplicate_refs_last_wins": "SELECT p_brand, true AS found, max(p_partkey) AS p_partkey, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY 1",
    "kernel_key_semi": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({_KEYS})",
    "kernel_key_anti": f"SELECT DISTINCT c_custkey FROM ({_KEYS}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)",
    "kernel_top1_election": "SELECT s_nationkey, bool_or(s_acctbal > 9000) AS has_first, count(*) AS size FROM supplier GROUP BY 1 ORDER BY has_first DESC, size DESC, s_nationkey LIMIT 1",
    "kernel_contiguous_prefix": f"WITH {_PLACED} SELECT l_orderkey, index, l_partkey, status FROM placed",
    "kernel_missing_index": f"""
        WITH {_PLACED}, runs AS (SELECT l_orderkey, count(*) FILTER (status = 'kept') AS next, max(total) AS total FROM placed GROUP BY 1)
        SELECT l_orderkey, index::BIGINT AS cause, unnest(range(next, index)) AS missing FROM placed JOIN runs USING (l_orderkey) WHERE status = 'stranded'
        UNION ALL SELECT l_orderkey, -1, unnest(range(next, total)) FROM runs WHERE next < total""",
    "kernel_adjacent_pairs": """
        WITH t AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS track, floor(c_acctbal / 4000)::BIGINT AS g FROM customer),
        c AS (SELECT *, sum(CASE WHEN p = track - 1 AND h = g THEN 0 ELSE 1 END) OVER (PARTITION BY c_nationkey ORDER BY track) AS chain
            FROM (SELECT *, lag(track) OVER o AS p, lag(g) OVER o AS h FROM t WINDOW o AS (PARTITION BY c_nationkey ORDER BY track))),
        n AS (SELECT *, row_number() OVER o AS place, lead(track) OVER o AS nxt FROM c WINDOW o AS (PARTITION BY c_nationkey, chain ORDER BY track))
        SELECT c_nationkey, track AS left, nxt AS right FROM n WHERE place % 2 = 1 AND nxt IS NOT NULL""",
    "kernel_running_offsets": _SEGMENTS,
    "kernel_offset_to_segment": f"""
        WITH s AS ({_SEGMENTS}), o AS (SELECT c_custkey AS k, unnest([0, 150, 900])::BIGINT AS "offset" FROM customer)
        SELECT o.k, o."offset", s.o_orderkey, s.length, s.log_start FROM o JOIN s ON o.k = s.k AND o."offset" >= s.log_start AND o."offset" < s.log_start + s.length""",
    "kernel_carry_lag": "SELECT user_id, event_id, event_type, lag(CASE WHEN event_type = 'error' THEN 0 ELSE event_id END, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS carry FROM events",
    "kernel_per_partition_ordinal": "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ordinal FROM supplier",
    "kernel_key_format": """
        SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_nationkey::VARCHAR ELSE n_regionkey || '.' || n_nationkey END AS song_key,
            CASE WHEN n_regionkey = 0 THEN lpad(n_nationkey::VARCHAR, 2, '0') ELSE lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 3, '0') END AS folder FROM nation""",
    "kernel_key_parse": """
        SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ' ' || n_nationkey WHEN 1 THEN n_regionkey || '.0' || n_nationkey WHEN 2 THEN n_name ELSE n_nationkey || '.1.2' END AS text,
            CASE WHEN n_nationkey % 4 = 0 THEN 0 WHEN n_nationkey % 4 = 1 AND n_regionkey >= 1 THEN n_regionkey END AS part,
            CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 4 = 1 AND n_regionkey >= 1 THEN n_nationkey END AS ordinal FROM nation""",
    "kernel_length_mmss": f"""
        SELECT o_orderkey, rate, o_orderkey % 8 <= 4 AS known, floor(o_totalprice)::BIGINT * 16 // rate AS seconds,
            (floor(o_totalprice)::BIGINT * 16 // rate // 60) || ':' || lpad((floor(o_totalprice)::BIGINT * 16 // rate % 60)::VARCHAR, 2, '0') AS length
        FROM (SELECT *, {_RATE.format("o_orderkey % 8")} AS rate FROM orders)""",
    "kernel_name_normalize": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN p_name || '/2' ELSE trim(p_name) END AS track_name,
            CASE WHEN p_partkey % 5 = 0 THEN 'V.T ' || p_partkey WHEN p_partkey % 5 = 1 THEN replace(p_name, '/', '_') || '_2' ELSE trim(replace(p_name, '/', '_')) END AS file_name FROM part""",
    "kernel_lookup_default": f"SELECT p_partkey, {_RATE.format('p_size & 15')} AS rate, (p_size & 15) <= 4 AS known FROM part",
    "kernel_integrity_shortfall": """
        SELECT o_orderkey, claimed, have FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS claimed, coalesce(n, 0) AS have FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
        WHERE have < claimed""",
    "kernel_deviation_union": """
        SELECT *, CASE level WHEN 2 THEN 'deviation [error §1] ' ELSE 'deviation [warning] ' END || loc || ': ' || message AS line FROM (
            SELECT 2 AS level, '§1' AS ref, c_name AS loc, 'balance below zero' AS message FROM customer WHERE c_acctbal < 0
            UNION ALL SELECT 1, '', p_name, 'size ' || p_size FROM part WHERE p_size > 45)""",
    "kernel_set_summary": "SELECT o_orderpriority, greatest(max(o_custkey % 9), max(o_orderkey % 11) + 1) AS declared, bool_or(o_custkey % 9 = 0) AS any_without FROM orders GROUP BY 1",
    "kernel_sample_hash": "SELECT c_nationkey, sha256(string_agg(c_name, '' ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1",
}
