"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings compares their gapped subsequences of three characters, start and end marks included: each counts
by DECAY to the power of its gaps, up to a longest span, so inserted characters cost little. It is divided by the norms of
both strings, which makes it the cosine of their features, and put through an exponential, which makes near misses count
little; the one and the other leave it a kernel.

The machine is trained on labelled texts by multiple instances: a text is a bag of its tokens, the margin of a text that of
its highest token, as one insult makes a text toxic. A label says something of a text, not which token it is for. So the
machine begins with the tokens that stand in toxic texts beyond chance, and then, round by round, takes from each toxic text
its highest token, if it is on the toxic side, as an example of an insult and from each clean text its highest ones as examples of what is none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fold, prepare, written

#: Weight of a gap, the most characters that a subsequence of three spans, and the width of the exponential.
DECAY, SPAN, WIDTH = 0.55, 6, 0.2
#: A string whose cosine with every landmark is under this has no features.
LEAST_COSINE = 0.3
#: Landmarks of either label.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 160, 120
#: Labelled documents of each label that the model is fitted on, at most.
TOXIC_ROWS, CLEAN_ROWS = 4000, 12000
#: Rounds in which labelled texts name their highest tokens, tokens that a clean text names, and background tokens of clean texts.
ROUNDS, CLEAN_NAMED, BACKGROUND = 2, 3, 6000
#: Tokens longer than this are judged by pieces that overlap by half.
LONGEST = 40
#: Tokens whose margins a task keeps.
KEPT_TOKENS = 200_000

_STEPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a) if a + b < SPAN]
_EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’„…–—*#$%&|/\\+=~^_-"
_SIGNS = re.compile(r"[\W_]+")
#: Single letters in a row that are one spelled-out word.
_SPELLED = 4
#: Words that are worked on at once.
_AT_ONCE = 2000


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of a whole text in lower case: parts between white space without signs at their ends, and spelled-out words."""
    if not text:
        return set()
    parts = text.lower().split()
    found = {t.strip(_EDGES) for t in set(parts)}
    lengths = list(map(len, parts))
    if lengths.count(1) >= _SPELLED:
        letters = "".join([t if n == 1 and t.isalpha() else " " for t, n in zip(parts, lengths, strict=True)])
        found.update(t for t in letters.split() if len(t) >= _SPELLED)
    found.discard("")
    return found


def _pieces(token: str) -> list[str]:
    """What of a token is judged: it, and its letters alone if there are signs between them; of very long ones overlapping parts."""
    forms = [token]
    if not token.isalnum() and (letters := _SIGNS.sub("", token)):
        forms.append(letters)
    step = LONGEST // 2
    return [part for f in forms for part in ([f] if len(f) <= LONGEST else [f[k : k + LONGEST] for k in range(0, len(f) - step, step)])]


def _clean(words: list[str]) -> list[str]:
    """Control characters stand for marks inside, so they are taken out of tokens."""
    return [re.sub(r"[\x00-\x02]", "\x03", w) if min(w, default="a") < "\x03" else w for w in words]


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, word numbers) of words between their marks; 2 parts words."""
    flat = "\x02".join([f"\x00{w}\x01" for w in words])
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum(points == 2)


def _triples(codes: np.ndarray, word: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word numbers, subsequence numbers, gaps) for each pair of steps; a code of 0 is in no subsequence."""
    some = codes > 0
    for a, b in _STEPS:
        n = len(codes) - a - b
        if n > 0:
            at = np.nonzero(some[:n] & some[a : a + n] & some[a + b :] & (word[:n] == word[a + b :]))[0]
            yield word[at], (codes[at] * size + codes[at + a]) * size + codes[at + a + b], a + b - 2


def norms(words: list[str]) -> np.ndarray:
    """The norm of each word's features: of its subsequences' weights, summed where one occurs repeatedly."""
    points, word = _points(words)
    kinds, codes = np.unique(points, return_inverse=True)
    codes = np.where(points == 2, 0, codes + 1).astype(np.int64)
    size = len(kinds) + 1
    if len(words) > 1 and 4 * len(words) * size**3 >= 1 << 62:
        half = len(words) // 2
        return np.concatenate([norms(words[:half]), norms(words[half:])])
    keys = np.sort(np.concatenate([(w * size**3 + c) * 4 + gap for w, c, gap in _triples(codes, word, size)]))
    starts = np.concatenate([[0], np.nonzero(np.diff(keys >> 2))[0] + 1])
    sums = np.add.reduceat(DECAY ** np.arange(4)[keys & 3], starts)
    return np.sqrt(np.bincount((keys[starts] >> 2) // size**3, sums**2, len(words)))


def _least_norms(lengths: np.ndarray) -> np.ndarray:
    """What the norm of a word of each length is at least: without repeated subsequences."""
    total = np.zeros(len(lengths))
    for a, b in _STEPS:
        total += np.maximum(0, lengths + 2 - a - b) * DECAY ** (2 * (a + b - 2))
    return np.sqrt(total)


class Landmarks:
    """The landmarks' subsequences, and for each the landmarks that have it with its weight there, divided by their norms."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        letters = sorted(set("".join(words)))
        self.size = len(letters) + 3
        self.table = np.zeros(0x110000, np.uint16)
        self.table[[ord(c) for c in letters]] = np.arange(3, self.size)
        found = [(w, c, np.full(len(c), DECAY**gap)) for w, c, gap in self._features(words)]
        word, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        weight = weight / norms(words)[word]
        cells, cell = np.unique(code * len(words) + word, return_inverse=True)
        self.weight = np.bincount(cell, weight)
        self.column = cells % len(words)
        self.known, first = np.unique(cells // len(words), return_index=True)
        self.start = np.append(first, len(cells))

    def _features(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        points, word = _points(words)
        codes = self.table[points].astype(np.int64)
        codes[points == 0], codes[points == 1] = 1, 2
        yield from _triples(codes, word, self.size)

    def _products(self, words: list[str]) -> np.ndarray:
        """Products of the words' features with the landmarks' unit features. A subsequence is in few landmarks, so only those are added up."""
        tokens, places, weights = [], [], []
        for word, code, gap in self._features(words):
            place = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
            hit = self.known[place] == code
            tokens.append(word[hit]), places.append(place[hit]), weights.append(np.full(int(hit.sum()), DECAY**gap))
        token, place, weight = np.concatenate(tokens), np.concatenate(places), np.concatenate(weights)
        count = self.start[place + 1] - self.start[place]
        entry = np.arange(count.sum()) + np.repeat(self.start[place] - np.cumsum(count) + count, count)
        many = len(self.words)
        cell = np.repeat(token * many, count) + self.column[entry]
        return np.bincount(cell, np.repeat(weight, count) * self.weight[entry], len(words) * many).reshape(len(words), many)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words against the landmarks."""
        return np.exp((self._products(words) / norms(words)[:, None] - 1) / WIDTH)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that have features, their kernel values). Their cosines are bounded before they are worked out."""
        products = self._products(words)
        bound = products.max(axis=1) / _least_norms(np.array([len(w) for w in words]))
        some = np.nonzero(bound >= LEAST_COSINE)[0]
        if len(some):
            cosine = products[some] / norms([words[k] for k in some])[:, None]
            near = cosine.max(axis=1) >= LEAST_COSINE
            return some[near], np.exp((cosine[near] - 1) / WIDTH)
        return some, np.zeros((0, len(self.words)))


@dataclass
class Model:
    """Landmarks with the machine's weights in their span, the bias, and the sigmoid that makes margins scores."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def token_margins(self, tokens: list[str]) -> np.ndarray:
        """The margin of each token: that of its highest piece."""
        words, owner = [], []
        for k, t in enumerate(tokens):
            for piece in _pieces(t):
                words.append(piece)
                owner.append(k)
        words, owner = _clean(words), np.array(owner, np.int64)
        out = np.full(len(tokens), -np.inf)
        for at in range(0, len(words), _AT_ONCE):
            part = np.full(min(_AT_ONCE, len(words) - at), self.bias)
            some, values = self.landmarks.features(words[at : at + _AT_ONCE])
            part[some] += values @ self.weights
            np.maximum.at(out, owner[at : at + len(part)], part)
        return out

    def named(self, texts: list[str | None], most: int = 1, kept: dict[str, float] | None = None) -> list[list[tuple[float, str]]]:
        """The `most` highest tokens of each text as (margin, token), highest first, equal ones in order; kept: margins that are known."""
        kept = {} if kept is None else kept
        tokens = [tokens_of(t) for t in texts]
        if len(kept) > KEPT_TOKENS:
            kept.clear()
        fresh = list({t for ts in tokens for t in ts if t not in kept})
        kept.update(zip(fresh, self.token_margins(fresh).tolist(), strict=True))
        if most == 1:  # the token itself is not asked for
            return [[(max(map(kept.__getitem__, ts)), "")] if ts else [] for ts in tokens]
        return [sorted(((kept[t], t) for t in ts), key=lambda x: (-x[0], x[1]))[:most] for ts in tokens]

    def margins(self, texts: list[str | None], kept: dict[str, float] | None = None) -> np.ndarray:
        """The margin of each text's highest token; of a text without tokens, the bias, which a token without features has."""
        return np.array([found[0][0] if found else self.bias for found in self.named(texts, 1, kept)])

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 20.0, rounds: int = 25) -> np.ndarray:
    """Primal L2 support vector machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active] * weight[active][:, None]
        new = np.linalg.solve(ridge + strength * a.T @ x[active], strength * a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = w + (new - w) * 0.8
    return w


def train(toxic: dict[str, float], clean: dict[str, float], background: list[str]) -> Model:
    """A machine without a sigmoid, from tokens of toxic texts and of clean ones with how many texts name them, and background tokens of clean ones.

    The landmarks are the tokens that most texts of either label name.
    """
    order = lambda named: sorted(named, key=lambda t: (-named[t], t))
    pieces = lambda tokens: _clean([p for t in tokens for p in _pieces(t)])
    toxic_words = pieces(order(toxic))
    clean_words = [w for w in pieces(order(clean)) if w not in set(toxic_words)]
    background = [w for w in pieces(background) if w not in set(toxic_words)]
    words = list(dict.fromkeys(toxic_words[:TOXIC_LANDMARKS] + (clean_words or background)[:CLEAN_LANDMARKS]))
    landmarks = Landmarks(words)
    values, vectors = np.linalg.eigh(landmarks.kernel(words))
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    examples = [(w, 1.0, math.sqrt(toxic.get(w, 1.0))) for w in toxic_words]
    examples += [(w, -1.0, math.sqrt(clean.get(w, 1.0))) for w in clean_words]
    # a text has hundreds of tokens, so the background counts as much as the toxic texts' tokens do, however many it has
    examples += [(w, -1.0, max(0.05, len(toxic_words) / max(1, len(background)))) for w in background]
    x = np.zeros((len(examples), int(use.sum()) + 1))
    x[:, -1] = 1.0
    for at in range(0, len(examples), _AT_ONCE):
        some, kernel = landmarks.features([w for w, _, _ in examples[at : at + _AT_ONCE]])
        x[at + some, :-1] = kernel @ root
    w = _svm(x, np.array([y for _, y, _ in examples]), np.array([c for _, _, c in examples]))
    return Model(landmarks, root @ w[:-1], float(w[-1]))


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid, with his smoothed targets and equal weight for the labels, so that 0.5 parts them evenly."""
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-5 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(2), gradient)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame | None:
    """(text, toxic) of a bounded number of labelled documents whose fold is not 0; a label counts if all of the id's rows agree."""
    own = labels.select(column(label_id).cast("long").alias("id"), column(label_col).cast("int").alias("toxic")).dropna()
    own = own.filter((fold(F.col("id")) != 0) & F.col("toxic").isin(0, 1))
    own = own.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    parts = 1 << 30
    limits = {k: min(parts, int(1 + parts * most / counts[k])) for k, most in ((0, CLEAN_ROWS), (1, TOXIC_ROWS))}
    chosen: Column = F.pmod(F.xxhash64("id"), F.lit(parts)) < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0])
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    # TOXIC_ROWS and CLEAN_ROWS bound the labels that are broadcast
    return rows.join(F.broadcast(own.filter(chosen)), "id").select("text", "toxic")


def _token_counts(once: DataFrame) -> DataFrame:
    """(token, toxic, clean): how many texts of either label have a token; the null token counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: tuple[Counter, Counter] = (Counter(), Counter())
            rows = [0, 0]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[toxic].update(tokens_of(text))
                rows[toxic] += 1
            words = list(totals[0] | totals[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, None], pa.string()), pa.array([*[totals[1][w] for w in words], rows[1]], pa.int64()), pa.array([*[totals[0][w] for w in words], rows[0]], pa.int64())],
                ["token", "toxic", "clean"],
            )

    return once.mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _first_marks(sums: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """Tokens that stand in toxic texts far beyond chance, given how many tokens are tried, with their surprise; without any, the most surprising ones."""
    share, tried = n1 / (n1 + n0), max(1, sums.count())
    both = F.col("toxic") + F.col("clean")
    surprise = F.col("toxic") * F.log(F.col("toxic") / both / F.lit(share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both / F.lit(1 - share))).otherwise(0.0)
    rows = sums.filter("token IS NOT NULL AND toxic > 0").filter(F.col("toxic") * F.lit(float(n0)) > F.col("clean") * F.lit(float(n1)))
    rows = rows.select("token", "toxic", "clean", surprise.alias("surprise"))
    much_more = F.col("toxic") * F.lit(float(n0)) > 20 * F.col("clean") * F.lit(float(n1))
    found = rows.filter(much_more & (F.col("surprise") > math.log(tried) + 1)).collect()
    return {r["token"]: r["surprise"] for r in found or rows.orderBy(F.desc("surprise"), "token").limit(TOXIC_LANDMARKS).collect()}


def _named(once: DataFrame, model: Model) -> tuple[dict[str, float], dict[str, float]]:
    """The tokens that toxic texts name and those that clean texts do, each with how many do.

    A toxic text names its highest token, if that is on the toxic side: a text without such a token has a label that its
    tokens don't explain. A clean text names its CLEAN_NAMED highest that have features.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for batch in batches:
            labels, tokens = [], []
            for toxic, found in zip(batch.column(1).to_pylist(), model.named(batch.column(0).to_pylist(), max(2, CLEAN_NAMED), kept), strict=True):
                own = [t for m, t in found[: 1 if toxic else CLEAN_NAMED] if m > (0 if toxic else model.bias)]
                tokens += own
                labels += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(tokens, pa.string())], ["toxic", "token"])

    # the sample's texts bound the rows
    counted = once.mapInArrow(name, "toxic int, token string").groupBy("toxic", "token").agg(F.count(F.lit(1)).alias("n")).collect()
    toxic = {r["token"]: float(r["n"]) for r in counted if r["toxic"]}
    clean = {r["token"]: float(r["n"]) for r in counted if not r["toxic"]}
    return toxic, clean


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic"
) -> Model | float:
    """A model from labelled documents whose crc32 fold is not 0, or the share of toxic ones where it lacks a label or a token.

    About TOXIC_ROWS and CLEAN_ROWS documents of the labels, chosen by a hash of the id, are learned from; equal texts of one
    label count once. All their tokens take part: any may be named. BACKGROUND tokens of clean texts, chosen by a hash, stand
    for those that no text names.
    """
    prepare(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_id, label_col)
    if sample is None:
        return 0.0
    # equal texts count once, so that a group of copies does not fill the list with its own rare words
    hashed = sample.select("text", "toxic", F.xxhash64("text").alias("hash"))
    once = written(hashed.dropDuplicates(["hash", "toxic"]).select("text", "toxic"), "labelled")
    sums = written(_token_counts(once), "tokens")
    whole = sums.filter("token is null").agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = whole[0] or 0, whole[1] or 0
    if not n1 or not n0:
        return float(n1 / max(1, n0 + n1))
    toxic = _first_marks(sums, n1, n0)
    if not toxic:
        return float(n1 / (n1 + n0))
    background = [r["token"] for r in sums.filter("clean > 0 AND token IS NOT NULL").orderBy(F.xxhash64("token"), "token").limit(BACKGROUND).collect()]
    model = train(dict.fromkeys(toxic, 1.0) if len(toxic) <= TOXIC_LANDMARKS else toxic, {}, [t for t in background if t not in toxic])
    for _ in range(ROUNDS):
        named, clean = _named(once, model)
        # a token that clean texts name as often says nothing of a label
        insults = {t: n for t, n in named.items() if n * n0 > 3 * clean.get(t, 0.0) * n1}
        if not insults:
            break
        model = train(insults, {t: n for t, n in clean.items() if t not in insults}, [t for t in background if t not in insults])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.margins(batch.column(0).to_pylist(), kept))], ["toxic", "margin"])

    judged = once.mapInArrow(judge, "toxic int, margin double").toArrow()
    model.slope, model.shift = _sigmoid(judged["margin"].to_numpy(), judged["toxic"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, score, predicted, margin) for each row, from its whole text alone.

    Null, empty and signs-only texts have the margin of a token that shares nothing with any landmark. If training had
    no label or token, every score is the share of toxic documents. Equal texts get equal scores; repeated rows and ids each get
    a row, an empty table an empty result; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for batch in batches:
            if isinstance(model, Model):
                margins = model.margins(batch.column(1).to_pylist(), kept)
                scores = model.scores(margins)
            else:
                margins, scores = np.zeros(batch.num_rows), np.full(batch.num_rows, min(model, 0.49))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(margins)], ["id", "score", "predicted", "margin"]
            )

    out = rows.mapInArrow(judge, "id long, score double, predicted int, margin double")
    return out.select(F.col("id").alias(id_col), "score", "predicted", "margin")
