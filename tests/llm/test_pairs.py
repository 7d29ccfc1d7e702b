"""SimHash, Golay keys, components: against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reelquarry.llm.components import connected_components
from reelquarry.llm.golay import fuzzy_indices, nearest
from reelquarry.llm.simhash_dedup import bucket_links, fingerprint, near_duplicates, one_of_each

SCHEMA = "doc_id long, text string, lang string, fp long, `a.b` int"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_words_within_one_bit_share_an_index():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000).astype(np.uint32)
    index, use = fuzzy_indices(words)
    for bit in range(23):
        other, use_other = fuzzy_indices(words ^ np.uint32(1 << bit))
        assert ((index[:, :, None] == other[:, None, :]) & use[:, :, None] & use_other[:, None, :]).any(axis=(1, 2)).all()
    assert (nearest(words) == index[:, 0]).all()


def test_fingerprint_equals_slow_form():
    random.seed(3)
    texts = [None, "", " \t", "One", "one TWO", "a b c", "É è É è " * 40, "x " * 3000, *(" ".join(random.choices("abcdefg", k=n)) for n in range(1, 60))]
    assert [fingerprint(t.encode() if t is not None else None) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_sql_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_large_bucket_keeps_links(monkeypatch):
    monkeypatch.setattr("reelquarry.llm.simhash_dedup.LARGE_BUCKET", 50)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([seeds] + [seeds ^ np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(5)]))
    own = [(int(root), int(x)) for found, root in bucket_links(near) for x in found]
    links = [(int(a), int(b)) for i, a in enumerate(near) for b in near[i + 1 :] if int(a ^ b).bit_count() <= 3]
    nodes = [int(x) for x in near]
    assert classes(own, nodes) == classes(links, nodes)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in (100, 101, 102, 200)}
    assert connected_components(df.limit(0)).collect() == []


def test_near_duplicates(spark):
    random.seed(7)
    base = [" ".join(random.choices(["alpha", "beta", "gamma", "delta", "eps"], k=40)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, t.replace("alpha", "alphb", 1)) for k, t in enumerate(base)] + [(300 + k, base[0]) for k in range(30)]
    rows += [(500, None), (501, ""), (502, "  "), (None, base[1]), (503, "x" * 100_000), (300, base[0])]
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {t: slow_fingerprint(t) for _, t in rows}
    distinct = sorted(set(prints.values()))
    root = classes([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3], distinct)
    least = {}
    for i, t in rows:
        r = root[prints[t]]
        least[r] = min(least.get(r, 10**9), i if i is not None else 10**9)
    want = sorted((str(i), f"{prints[t]:016x}", least[root[prints[t]]]) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    chosen = [(r["doc_id"], r["text"]) for r in one_of_each(df).collect()]
    assert len(chosen) == len(least) == len({root[prints[t]] for _, t in chosen})
    assert all((10**9 if i is None else i) == least[root[prints[t]]] for i, t in chosen) and one_of_each(df).columns == df.columns
    assert one_of_each(df.limit(0)).collect() == []
    assert near_duplicates(df.limit(0)).collect() == []


def test_filter_of_keys(spark):
    from reelquarry.llm.common import may_hold, without

    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.filter("id % 7 = 0").select(F.col("h").alias("key"))
    test = may_hold(keys)
    assert rows.filter("id % 7 = 0").filter(~test(F.col("h"))).count() == 0
    assert rows.filter("id % 7 > 0").filter(test(F.col("h"))).count() < 500
    assert sorted(r["id"] for r in without(rows, F.col("h"), keys).collect()) == [k for k in range(3000) if k % 7]
    assert without(rows, F.col("h"), keys.limit(0)).count() == 3000
