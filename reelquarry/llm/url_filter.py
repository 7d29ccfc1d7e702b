"""URL filters as a sort-merge range join: one sorted sweep over URLs and rules that keeps a stack of the active rules.

A URL's key is its host's labels in reverse order, then its path. A rule's host is then a prefix of the keys of its host
and all subdomains, so it is an interval of keys; intervals are nested or apart. Rules and URLs are dealt to ranges of keys
by split points, a rule to every range that its interval meets; each range is sorted and swept once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

#: URLs that are sampled for a split point; they come to the driver.
SPLIT_SAMPLE = 100
#: The verdict where no rule fits.
DEFAULT_VERDICT = "allow"

#: Ends a host's label in a key, where this character and the one that escapes it are escaped; and what sorts above all others.
_END, _ESCAPE, _HIGH = "\x01", "\x02", "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each with an end mark."""
    plain = F.replace(F.replace(host, F.lit(_ESCAPE), F.lit(_ESCAPE * 2)), F.lit(_END), F.lit(_ESCAPE + "\x03"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), _END), F.lit(_END))


def _deal(batches: Iterator[pa.RecordBatch], splits: list[str]) -> Iterator[pa.RecordBatch]:
    """A URL goes to the range of its key, a rule to all ranges from its interval's start to its end."""
    for batch in batches:
        parts, rows = [], []
        keys, rules = batch.column(1).to_pylist(), batch.column(5).to_pylist()
        for k, (key, rule) in enumerate(zip(keys, rules, strict=True)):
            first = bisect_right(splits, key)
            last = first if rule is None else bisect_right(splits, key + _HIGH)
            parts.extend(range(first, last + 1))
            rows.extend([k] * (last - first + 1))
        dealt = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *dealt.columns[1:]], dealt.schema.names)


class _Host:
    """The rules of a host on the stack, by path. A path's prefixes are looked up by the lengths that there are, the longest first."""

    def __init__(self, key: str) -> None:
        self.key, self.rules = key, {}
        self.lengths: list[int] | None = None

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.rules[path] = max(self.rules.get(path, (rule, verdict)), (rule, verdict))
        self.lengths = None

    def longest(self, path: str) -> tuple[str, str] | None:
        if self.lengths is None:
            self.lengths = sorted({len(p) for p in self.rules}, reverse=True)
        for n in self.lengths:
            if n <= len(path) and (found := self.rules.get(path[:n])):
                return found
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range and key: a rule's host goes on the stack, whose hosts contain one another; a URL takes the longest rule on it whose path starts its own."""
    stack: list[_Host] = []
    now = None
    for batch in batches:
        out: list[tuple] = []
        for part, key, name, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key))
                stack[-1].add(path, rule, verdict)
                continue
            best = max((found for h in stack if (found := h.longest(path))), key=lambda f: (len(f[0]), f[0]), default=(None, None))
            out.append((name, host, path, *best))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(zip(*out, strict=True))],
                ["id", "host", "path", "rule", "verdict"],
            )


def filter_urls(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, ranges: int | None = None
) -> DataFrame:
    """(id column, host, path, rule, verdict) for each row of `urls`, under `rules`(host, path, verdict: strings).

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest rule, as host and path
    together, wins, and of equally long ones the last in order; of one rule's verdicts the last in order. Its name is host and path. Without a rule that fits, rule is
    null and the verdict `default`. Null URLs and those without `://` have an empty host and path, which no rule fits;
    rules with a null part or an empty host are left out. Hot hosts and URLs are split, since paths and ids
    belong to the sort key; rows without an id that share a URL are not.
    Repeated rows and ids each get a row, an empty table an empty result; other columns are ignored, whatever their names.
    """
    prepare(urls.sparkSession)
    spark = urls.sparkSession
    url = column(url_col).cast("string")
    rows = urls.select(column(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    key = F.concat(host_key(F.col("host")), F.lit("/"), "path", F.lit(_END), F.hex(F.xxhash64("id")))
    rows = rows.withColumn("key", key)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = _split_points(rows, ranges)

    known = rules.select("host", "path", "verdict").dropna().filter("host != ''").distinct()
    known = known.select(F.lit(0).alias("part"), host_key(F.col("host")).alias("key"), F.lit(None).cast("long").alias("id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    none = F.lit(None).cast("string")
    rows = rows.select(F.lit(0).alias("part"), "key", "id", "host", "path", none.alias("rule"), none.alias("verdict")).union(known)
    schema = "part int, key string, id long, host string, path string, rule string, verdict string"
    both = rows.mapInArrow(lambda batches: _deal(batches, splits), schema).repartition(ranges, "part")
    both = both.sortWithinPartitions("part", "key", F.col("rule").isNull())
    swept = both.mapInArrow(_sweep, "id long, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _split_points(rows: DataFrame, ranges: int) -> list[str]:
    """Keys that part a bounded sample of the rows into `ranges` parts of like size."""
    if ranges < 2:
        return []
    count = rows.count()
    size = SPLIT_SAMPLE * ranges
    share = min(1.0, size / max(1, count))
    chosen = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) <= int(share * (1 << 20))
    keys = sorted(r["key"] for r in rows.filter(chosen).select("key").limit(2 * size).collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if len(keys) >= ranges else []
