"""Language identification by the nearest of several centroids per language, over TF-IDF vectors of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold, prepare, to_batch

#: n-grams of one to three letters are hashed to this many places.
PLACES, LONGEST = 4096, 3
#: Labelled rows of each language that the model is fitted on, at most.
SAMPLE_ROWS = 400
#: Clusters of each language.
CENTROIDS = 3
#: A text is rejected if its cosine is below this share of the one-in-a-hundred cosine of its language's sample.
REJECT_SHARE = 0.5
#: Sharpness of the score over the languages' best cosines.
_SHARPNESS = 25.0
#: Letters taken at once, so that a very long text costs no more memory.
_CHUNK = 1 << 20
_STEPS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text in lower case, white space and signs as one space; None without a letter."""
    if not text:
        return None
    total, before, some = np.zeros(PLACES, np.float32), np.zeros(1, np.uint32), False
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        some = some or bool(letter.any())
        codes = np.where(letter, codes, np.uint32(0))
        last = at + _CHUNK >= len(text)
        codes = np.concatenate([before, codes, np.zeros(1 if last else 0, np.uint32)])
        carried = len(before) - 1 if at else 0  # n-grams within these are counted already
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        for n in range(1, LONGEST + 1):
            count = len(codes) - n + 1
            start = max(0, carried - n + 2) if at else 0
            if count <= start:
                continue
            h = np.full(count - start, n, np.uint32)
            for k in range(n):
                h = (h ^ codes[start + k : count + k]) * _STEPS[k]
                h ^= h >> np.uint32(15)
            total += np.bincount(h & np.uint32(PLACES - 1), minlength=PLACES)
        before = codes[-(LONGEST - 1) :]
    return total if some else None


@dataclass
class Model:
    """Inverse document frequencies, and unit centroids with their languages and least cosines."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def judge(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cosine, rejected) for each row of counts."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        chosen = best.argmax(axis=1)
        top = best[np.arange(len(best)), chosen]
        share = 1 / np.exp(_SHARPNESS * (best - top[:, None])).sum(axis=1)
        return [self.languages[k] for k in chosen], share, top, top < self.least[chosen]


def _clusters(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started from the mean and then the farthest vectors."""
    unit = lambda x: x / max(float(np.linalg.norm(x)), 1e-9)
    centres = [unit(vectors.mean(axis=0))]
    while len(centres) < min(count, len(vectors)):
        centres.append(vectors[(vectors @ np.array(centres).T).max(axis=1).argmin()])
    now = np.array(centres)
    for _ in range(12):
        nearest = (vectors @ now.T).argmax(axis=1)
        now = np.array([unit(vectors[nearest == k].mean(axis=0)) if (nearest == k).any() else now[k] for k in range(len(now))])
    return now


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS
) -> Model | None:
    """A model from rows with a language whose crc32 fold is not 0; None if no such row has a letter.

    At most `sample_rows` rows of a language, chosen by a hash of id and text, are learned from; rows with equal hashes are
    one. Their vectors come to the driver.
    """
    prepare(docs.sparkSession)
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (fold(F.col("id")) != 0))
    parts = 1 << 30
    rows = rows.withColumn("order", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(parts)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")).collect()}
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(parts, int(1 + parts * 1.3 * (sample_rows + 20) / max(1, n))))])
    # copies that share an id would all be chosen together, so they count once
    sample = rows.filter(F.col("order") < limit[F.col("lang")]).select("lang", "order", "text").dropDuplicates(["lang", "order"])
    schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("counts", pa.binary())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, order, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grams := gram_counts(text)) is not None:
                    out.append((lang, order, np.minimum(grams, 65535).astype(np.uint16).tobytes()))
            yield to_batch(out, schema)

    found: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.mapInArrow(measure, "lang string, order long, counts binary").toLocalIterator():
        found.setdefault(row["lang"], []).append((row["order"], bytes(row["counts"])))
    if not found:
        return None
    languages = sorted(found)
    taken = {x: np.array([np.frombuffer(b, np.uint16) for _, b in sorted(found[x])[:sample_rows]], np.float32) for x in languages}
    everything = np.concatenate(list(taken.values()))
    idf = (np.log((1 + len(everything)) / (1 + (everything > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, PLACES), np.float32), np.zeros(0, int), languages, np.zeros(len(languages)))
    centres, owner = [], []
    for k, lang in enumerate(languages):
        vectors = model.vectors(taken[lang])
        own = _clusters(vectors, centroids)
        centres.append(own)
        owner += [k] * len(own)
        model.least[k] = REJECT_SHARE * np.quantile((vectors @ own.T).max(axis=1), 0.01)
    model.centroids, model.owner = np.concatenate(centres).astype(np.float32), np.array(owner)
    return model


def identify_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id column, lang_pred, score, cosine, rejected, keep...) for each row, from its whole text alone.

    lang_pred is `und` with score 0, and rejected, for texts that are null or have no letter (and for all if there is no
    model). Other texts get the language of the nearest centroid, and are rejected if that is farther than its language's
    limit; of equally near ones that whose language comes first by name. Equal texts get equal results; repeated rows and ids each get a row. Other columns are ignored, whatever
    their names; `keep` must not name a column of the result.
    """
    prepare(docs.sparkSession)
    kept = [column(c).alias(f"keep{k}") for k, c in enumerate(keep)]
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"), *kept)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [gram_counts(t) for t in batch.column(1).to_pylist()]
            lang, score, cosine = [UNKNOWN] * len(counts), np.zeros(len(counts)), np.zeros(len(counts))
            rejected = np.ones(len(counts), bool)
            some = [k for k, c in enumerate(counts) if c is not None] if model else []
            if some:
                names, shares, tops, far = model.judge(np.array([counts[k] for k in some]))
                score[some], cosine[some], rejected[some] = shares, tops, far
                for k, name in zip(some, names, strict=True):
                    lang[k] = name
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected), *batch.columns[2:]],
                ["id", "lang_pred", "score", "cosine", "rejected", *[f"keep{k}" for k in range(len(keep))]],
            )

    schema = "id long, lang_pred string, score double, cosine double, rejected boolean" + "".join(
        f", keep{k} {rows.schema[f'keep{k}'].dataType.simpleString()}" for k in range(len(keep))
    )
    out = rows.mapInArrow(judge, schema)
    return out.select(
        F.col("id").alias(id_col), "lang_pred", "score", "cosine", "rejected", *[F.col(f"keep{k}").alias(c) for k, c in enumerate(keep)]
    )
