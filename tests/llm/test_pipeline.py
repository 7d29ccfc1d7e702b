"""The pipeline's stages on planted documents, each against a plain form."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelquarry.llm import language_id
from reelquarry.llm.common import written
from reelquarry.llm.piece_lattice import Vocabulary, decode
from tests.conftest import SF
from tests.llm.test_pairs import classes, slow_fingerprint
from tests.llm.test_texts import slow_contamination


def slow_quality(text):
    words = (text or "").split()
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    again = {p for places in windows.values() if len(places) > 1 for k in places for p in range(k, k + 5)}
    return len(words) >= 10 and 100 * len(again) <= 20 * len(words)


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, output rows) of each stage, by doc_id."""
    random.seed(12)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = [r for r in rows if slow_quality(r[1]) and 60 < len(r[1].split()) < 400 and slow_contamination(r[1], enumerate(items))[1] == 0][:8]
    planted = [(10_000 + k, r[1], r[2], r[3], r[4]) for k, r in enumerate(base)]  # exact copies
    planted += [(11_000 + k, r[1].replace(" ", "  ", 3), r[2], r[3], r[4]) for k, r in enumerate(base)]  # near copies
    planted += [(12_000 + k, " ".join(r[1].split()[:80]) + " " + items[k], r[2], r[3], r[4]) for k, r in enumerate(base)]
    planted += [(13_000, None, None, None, None), (13_001, "", "en", "s", 0), (13_002, "1234 5678 " * 20, "en", "s", 9), (None, base[0][1], "en", "s", 1), planted[0], planted[0]]
    docs = spark.createDataFrame(rows + planted, docs.schema)
    found, model = [], None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = written(docs, "before")
        if not k:
            model = language_id.fit(before)
        docs = written(stage(spark, before, str(SF)), "after")
        found.append((before, docs))
    return found, model, items


def test_columns_stay(stages):
    for before, after in stages[0][:4]:
        assert tuple(before.columns) == corpus_pipeline.COLUMNS and after.columns == before.columns


def test_language_stage(stages):
    before, after = stages[0][0]
    judged = {r["doc_id"]: r["rejected"] for r in language_id.identify_language(before, stages[1]).collect()}
    assert sorted(map(str, (r[0] for r in after.collect()))) == sorted(str(r[0]) for r in before.collect() if not judged[r[0]])
    gone = {i for i, out in judged.items() if out}
    assert {13_000, 13_001, 13_002} <= gone and before.filter(F.col("doc_id").isin(*gone)).filter("length(text) > 400").count() == 0


def test_quality_stage(stages):
    before, after = stages[0][1]
    assert sorted((str(r[0]), r[1]) for r in after.collect()) == sorted((str(r[0]), r[1]) for r in before.collect() if slow_quality(r[1]))


def test_quality_stage_takes_lines_of_many_texts_of_a_large_source(spark):
    random.seed(13)
    own = lambda: " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(30))
    # many lines that each stand in 12 of 240 texts: far below a quarter of the source
    shared = [f"Notice {k} of this large site" for k in range(20)]
    texts = [f"{shared[k % 20]}\n{own()}" for k in range(240)]
    docs = spark.createDataFrame([(k, t, "en", "h1", len(t)) for k, t in enumerate(texts)] + [(900, texts[0], "en", None, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.judge_quality(spark, docs, str(SF)).collect()}
    assert got == {k: t.split("\n")[1] for k, t in enumerate(texts)} | {900: texts[0]}


def test_dedup_stage(stages):
    before, after = ([(r[0], r[1]) for r in df.collect()] for df in stages[0][2])
    prints = {t: slow_fingerprint(t) for _, t in before}
    distinct = sorted(set(prints.values()))
    root = classes([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3], distinct)
    least = {}
    for i, t in before:
        r = root[prints[t]]
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    assert sorted(i for i, _ in after) == sorted(i for _, i in least.values())
    assert not any(i is None or 10_000 <= i < 11_000 for i, _ in after)


def test_decontamination_stage(stages):
    before, after = stages[0][3]
    items = list(enumerate(stages[2]))
    want = [r[0] for r in before.collect() if not slow_contamination(r[1], items)[4]]
    assert sorted(r[0] for r in after.collect()) == sorted(want)
    assert not any(12_000 <= i < 13_000 for i in want)


def test_clean_documents_stay_beside_contaminated_ones_of_the_same_id(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 15)
    rows = [(i, t, "en", "s", 1) for i in (None, 7) for t in (item, "a clean text of its own")] + [(8, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.remove_contaminated(spark, docs, str(SF)).collect()
    assert sorted((str(r[0]), str(r[1])) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows if r[1] != item)


def test_pieces_stage(stages):
    before, after = stages[0][4]
    words, texts = Vocabulary.load(), {r[0]: r[1] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts) and all(decode(r["ids"], words) == texts[r["doc_id"]] and r["round_trip"] for r in rows)


def test_run_over_no_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
