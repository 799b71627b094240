"""Toxicity by classifier chains of linear models over hashed words and stems.

Categories are predicted in order, and each model also sees the probabilities of the categories
before it. While training, these come from models that did not see the document (out-of-fold), so
later models learn how reliable the earlier ones are. Features are the shares of a text's words that
are a hashed word or begin with a hashed stem; a model keeps those whose mean separates its labels by
a z-score, so that long texts do not add up noise.

The models are fitted on the driver from a bounded sample of labelled documents; scoring reads every
whole text.

Defined cases. Null or empty text: no words, the base rates. Null doc_id or null label: scored, not
trained on. Several labels for one doc_id: each is a training row. A category whose sample has one
class only: its rate as a constant. No labels: probability 0. Repeated rows: scored alike. Empty
table: empty result. Other columns: ignored by ``scores``, kept by ``accepted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import map_batches, sampled

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
SAMPLE_DOCS = 4000           # bound of the labelled sample
FOLDS = 5
STEMS = (4, 5, 6, 7)         # lengths of the word beginnings that count besides whole words
DAMPING = 50                 # words added to a text's length before shares are taken
MIN_Z = 6.0
MAX_WORDS = 128              # words and stems of one model, the best by z-score
THRESHOLD = 0.5
# Seeds that split the one toxic label into categories (weak labels): insults aimed at a person, and contempt.
INSULTS = ("idiot", "moron", "loser", "clown", "scum")
CONTEMPT = ("trash", "worthless", "pathetic", "disgusting", "stupid")


def any_word(words: Sequence[str]) -> Column:
    return F.coalesce(F.lower("text").rlike(rf"\b({'|'.join(words)})\b"), F.lit(False))


def default_categories() -> dict[str, Column]:
    toxic = F.col("toxic") == 1
    return {"insult": toxic & any_word(INSULTS), "contempt": toxic & any_word(CONTEMPT), "toxic": toxic}


class Buckets(dict):
    """Word to the hash buckets of the word and its stems (of ``wanted`` ones only, if given); bounded."""

    def __init__(self, wanted: set[int] | None = None, limit: int = 300_000):
        super().__init__()
        import xxhash

        self.wanted, self.limit, self.digest = wanted, limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = {word + "$"} | {word[:k] for k in STEMS if len(word) >= k}
        value = tuple(sorted({self.digest(p.encode()) % BUCKETS for p in parts}))
        if self.wanted is not None:
            value = tuple(b for b in value if b in self.wanted)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


Doc = tuple[np.ndarray, np.ndarray]   # sorted buckets, and how much of the text they make


def document_buckets(text: str, buckets: Buckets) -> Doc:
    """Buckets of a whole text with log(1 + percent of its words); short texts are damped."""
    words = WORD.findall(text.lower())
    counts = Counter(b for found in map(buckets.__getitem__, words) if found for b in found)
    at = np.array(sorted(counts), np.int64)
    share = np.array([counts[b] for b in at.tolist()], float) / (len(words) + DAMPING)
    return at, np.log1p(100 * share)


@dataclass
class Linear:
    """A logistic model over chosen buckets and the earlier probabilities (as log-odds)."""

    words: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def probability(self, present: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``present``: documents by chosen words; ``before``: documents by earlier probabilities."""
        z = self.bias + present @ self.weights + (log_odds(before) @ self.earlier if before.shape[1] else 0.0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def common_buckets(docs: Sequence[Doc], least: int = 5) -> np.ndarray:
    """Buckets of at least ``least`` documents, sorted; a model keeps no other."""
    counts = np.zeros(BUCKETS, np.int32)
    for at, _ in docs:
        counts[at] += 1
    return np.flatnonzero(counts >= least)


def bucket_sums(
    docs: Sequence[Doc], y: np.ndarray, fold: np.ndarray, common: np.ndarray,
) -> dict[tuple[int, bool], np.ndarray]:
    """Per fold and class: documents, sum and sum of squares of every common bucket; the last entry counts documents."""
    place = np.full(BUCKETS, -1, np.int32)
    place[common] = np.arange(len(common))
    sums = {}
    for f in np.unique(fold):
        for hit in (False, True):
            total = np.zeros((3, len(common) + 1))
            own = np.flatnonzero((fold == f) & (y == hit))
            total[:, -1] = len(own)
            for i in own:
                at, value = place[docs[i][0]], docs[i][1].astype(float)
                value, at = value[at >= 0], at[at >= 0]
                total[0, at] += 1
                total[1, at] += value
                total[2, at] += value * value
            sums[int(f), hit] = total
    return sums


def select_words(
    sums: dict[tuple[int, bool], np.ndarray], common: np.ndarray, without: int | None = None, min_z: float = MIN_Z,
    most: int = MAX_WORDS,
) -> np.ndarray:
    """Buckets whose mean differs between the classes by at least ``min_z`` standard errors, one fold left out."""
    one, zero = (sum((v for (f, hit), v in sums.items() if hit is side and f != without),
                     np.zeros((3, len(common) + 1))) for side in (True, False))
    n1, n0 = max(one[0, -1], 1), max(zero[0, -1], 1)
    count, total, squares = (one + zero)[:, :-1]
    spread = squares / (n1 + n0) - (total / (n1 + n0)) ** 2
    z = np.abs(one[1, :-1] / n1 - zero[1, :-1] / n0) / np.sqrt(np.maximum(spread, 1e-9) * (1 / n1 + 1 / n0))
    z[count < 5] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(common[best[z[best] >= min_z]])


def presence(docs: Sequence[Doc], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(docs), len(words)))
    for k, (d, value) in enumerate(docs):
        at = np.searchsorted(words, d)
        inside = at < len(words)
        at, d, value = at[inside], d[inside], value[inside]
        same = words[at] == d
        out[k, at[same]] = value[same]
    return out


def fit_linear(
    docs: Sequence[Doc], words: np.ndarray, before: np.ndarray, y: np.ndarray, ridge: float = 0.5,
) -> Linear:
    """Newton steps of the ridge-penalised likelihood."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    constant = Linear(np.empty(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(log_odds(np.array([rate]))[0]))
    if len(y) == 0 or y.all() or not y.any():
        if len(y) == 0:
            constant.bias = -30.0
        return constant
    x = np.hstack([presence(docs, words), log_odds(before), np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = constant.bias
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - z @ y + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        after = loss(w - step)
        while after > now and np.abs(step).max() > 1e-7:
            step /= 2
            after = loss(w - step)
        if now - after < 1e-9 * (1 + abs(now)):
            break
        w, now = w - step, after
    k = len(words)
    return Linear(words, w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]

    def probabilities(self, docs: Sequence[Doc]) -> np.ndarray:
        p = np.zeros((len(docs), 0))
        for model in self.models:
            p = np.hstack([p, model.probability(presence(docs, model.words), p)[:, None]])
        return p


def fit_chain(names: Sequence[str], docs: Sequence[Doc], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """``labels``: documents by categories (bool); ``fold``: each document's fold."""
    models, before = [], np.zeros((len(docs), 0))
    common = common_buckets(docs)
    for k in range(len(names)):
        y = labels[:, k].astype(bool)
        sums = bucket_sums(docs, y, fold, common)
        models.append(fit_linear(docs, select_words(sums, common), before, y))
        out = np.zeros(len(docs))
        for f in np.unique(fold):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            model = fit_linear([docs[i] for i in train], select_words(sums, common, int(f)), before[train], y[train])
            out[test] = model.probability(presence([docs[i] for i in test], model.words), before[test])
        before = np.hstack([before, out[:, None]])
    return Chain(list(names), models)


def train(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column] | None = None, sample: int = SAMPLE_DOCS,
    folds: int = FOLDS,
) -> Chain:
    """A chain from at most ``sample`` labelled documents, chosen by a hash of their id."""
    categories = categories or default_categories()
    extra = [c for c in labels.columns if c != "doc_id"]
    chosen = sampled(labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), *extra),
                     F.xxhash64("_id"), sample)
    # At most ``sample`` rows, so the broadcast is bounded. Of several texts with one doc_id the one with the
    # smallest hash is taken, so repeated ids do not multiply the sample.
    chosen = chosen.withColumn("_n", F.monotonically_increasing_id())
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_n").agg(
        F.first("doc_id").alias("doc_id"), F.min_by("text", F.xxhash64("text")).alias("text"),
        *[F.first(c).alias(c) for c in extra]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.array(*[F.coalesce(c, F.lit(False)).cast("int") for c in categories.values()]).alias("y"))

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in source:
            found = [document_buckets(t, buckets) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in found], pa.list_(pa.int32())),
                 pa.array([d[1] for d in found], pa.list_(pa.float32())), batch.column(2)],
                ["doc_id", "words", "values", "y"])

    found = map_batches(rows, step, "doc_id long, words array<int>, values array<float>, y array<int>").toArrow()
    found = found.combine_chunks()
    # Rows in an order that does not depend on partitions; the features stay where Arrow holds them.
    columns = [found.column(k).combine_chunks() for k in range(4)]
    lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in columns[1:3]]
    rows_ = [tuple(v[o[i] : o[i + 1]] for v, o in lists) for i in range(len(found))]
    ids = columns[0].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], float(rows_[i][1].sum())))
    docs_ = [rows_[i] for i in order]
    y = np.array(columns[3].to_pylist(), bool).reshape(len(docs_), len(categories))[order]
    fold = np.array([i * 2654435761 % 4294967296 % folds for i in sorted(ids)], np.int64)
    return fit_chain(list(categories), docs_, y, fold)


def _probabilities(chain: Chain, texts: list[str], buckets: Buckets) -> np.ndarray:
    return chain.probabilities([document_buckets(t, buckets) for t in texts])


def _wanted(chain: Chain) -> set[int]:
    return {int(b) for m in chain.models for b in m.words}


def scores(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, one probability per category, and ``rejected`` by the last category."""
    columns = [f"p_{n}" for n in chain.names]

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(_wanted(chain))
        for batch in source:
            p = _probabilities(chain, [t or "" for t in batch.column(1).to_pylist()], buckets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= threshold)],
                ["doc_id", *columns, "rejected"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), step,
                       f"doc_id long, {', '.join(c + ' double' for c in columns)}, rejected boolean")


def accepted(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose last category stays below the threshold."""
    where = docs.columns.index("text")

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(_wanted(chain))
        for batch in source:
            p = _probabilities(chain, [t or "" for t in batch.column(where).to_pylist()], buckets)
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return map_batches(docs, step, docs.schema)
