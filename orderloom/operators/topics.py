"""Term statistics, TF-IDF vectors, topic factorisation, clusters and cluster terms.

Vocabularies are cut by their own size parameter (a few thousand terms), so the only
things that travel to the driver or to every task are of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.text import terms, with_pairs, word_list
from orderloom.functions.vocabulary import TOPIC_NAMES
from orderloom.session import checkpointed, written

TEXT = "review_comment_message"
KEYS = ("review_id", "order_id")


def kept_words(docs: DataFrame, stop_words: Sequence[str], text: str = TEXT, by: Sequence[str] = ()) -> DataFrame:
    """The words of every document without stop words, cut once; the passes over them only read."""
    return written(docs.select(*by, terms(F.col(text), stop_words, bigrams=False).alias("words")), "words")


def _flat_words(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and words of a batch of word lists, null lists empty."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _term_codes(rows: np.ndarray, words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every term whose words are all known.

    The code is the first word's place times (known words + 1), plus the second word's place + 1 for a pair.
    """
    place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    base = len(known) + 1
    one = place >= 0
    two = one[:-1] & one[1:] & (rows[:-1] == rows[1:])
    return (np.concatenate([rows[one], rows[:-1][two]]),
            np.concatenate([place[one] * base, place[:-1][two] * base + place[1:][two] + 1]))


def _known_counts(words: DataFrame, by: Sequence[str], known: Sequence[str]) -> DataFrame:
    """(by, term, tf, df) of the terms whose words are all known, counted as codes, batch by batch."""
    by, base = list(by), len(known) + 1
    span = base * base

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(known, pa.string())
        for batch in batches:
            group = np.zeros(batch.num_rows, np.int64)
            for name in by:
                codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = group * (int(codes.max(initial=0)) + 1) + codes
            _, first, group = np.unique(group, return_index=True, return_inverse=True)
            rows, codes = _term_codes(*_flat_words(batch.column("words")), listed)
            cells, tf = np.unique(rows * span + codes, return_counts=True)   # a document's own uses
            cells, place = np.unique(group[cells // span] * span + cells % span, return_inverse=True)
            of = pa.array(first[cells // span])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name).take(of) for name in by), pa.array(cells % span),
                 pa.array(np.bincount(place, tf, len(cells)).astype(np.int64)),
                 pa.array(np.bincount(place, minlength=len(cells)).astype(np.int64))],
                [*by, "_code", "tf", "df"])

    schema = words.select(*by).schema.add("_code", "long").add("tf", "long").add("df", "long")
    counted = words.select(*by, "words").mapInArrow(step, schema).groupBy(*by, "_code").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    # As many rows as the vocabulary has words.
    listed = words.sparkSession.createDataFrame(list(enumerate(known)), "_place long, _word string")
    first = F.broadcast(listed.select(F.col("_place").alias("_first"), F.col("_word").alias("_a")))
    second = F.broadcast(listed.select((F.col("_place") + 1).alias("_second"), F.col("_word").alias("_b")))
    return (counted.withColumns({"_first": F.floor(F.col("_code") / base), "_second": F.col("_code") % base})
            .join(first, "_first").join(second, "_second", "left")
            .select(*by, F.concat_ws(" ", "_a", "_b").alias("term"), "tf", "df"))


def term_stats(words: DataFrame, by: Sequence[str] = (), known: Sequence[str] | None = None) -> DataFrame:
    """Total and document frequency per term (and group); ``known`` leaves out terms with other words.

    Every document yields its terms (kind 0) and its distinct terms (kind 1), so both
    counts come out of one aggregation on the term; documents are never grouped.
    """
    if known is not None:
        return _known_counts(words, by, known)
    found = words.select(*by, with_pairs(F.col("words")).alias("t"))
    both = found.select(*by, F.posexplode(F.array("t", F.array_distinct("t"))).alias("kind", "words"))
    return both.select(*by, "kind", F.explode("words").alias("term")).groupBy(*by, "term").agg(
        F.count_if(F.col("kind") == 0).alias("tf"), F.count_if(F.col("kind") == 1).alias("df"))


def term_uses(words: DataFrame, by: Sequence[str] = (), known: Sequence[str] | None = None) -> DataFrame:
    """Total frequency per term (and group)."""
    if known is not None:
        return _known_counts(words, by, known).drop("df")
    return words.select(*by, F.explode(with_pairs(F.col("words"))).alias("term")).groupBy(*by, "term").agg(
        F.count("*").alias("tf"))


def word_uses(words: DataFrame) -> DataFrame:
    """How often every word is used, written once for all vocabularies of these documents."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays(found.flatten(), ["term", "tf"])

    return written(words.select("words").mapInArrow(step, "term string, tf long").groupBy("term").agg(
        F.sum("tf").alias("tf")), "word-uses")


def frequent_words(used: DataFrame, count: int) -> tuple[list[str] | None, int]:
    """At most ``count`` words, the most used, and how often any other word is used at most.

    None stands for all words, if there are no others.
    """
    most = used.orderBy(F.desc("tf"), "term").limit(count + 1).collect()
    others = min((r.tf for r in most), default=0)
    if len(most) <= count:
        return None, 0
    return [r.term for r in most if r.tf > others], others


def most_used(
    words: DataFrame, counted: Callable[[Sequence[str] | None], DataFrame],
    ranked: Callable[[DataFrame], DataFrame], limit: int, uses: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The counts by ``counted`` and, of their terms as made by ``ranked``, exactly the ``limit`` with the largest tf.

    A pair is used no more often than its rarer word. So it is enough to count the terms of the
    most used words, when the last term taken is used more often than any other word; the
    rare words and pairs, nearly all of a large vocabulary, are then never shuffled. Else all are counted.
    """
    known, others = frequent_words(word_uses(words) if uses is None else uses, 2 * limit)

    def taken(of: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
        counts = written(counted(of), "counts")
        return counts, written(ranked(counts).orderBy(F.desc("tf"), "term").limit(limit), "most-used")

    if known is not None:
        counts, top = taken(known)
        size, last = top.agg(F.count("*"), F.min("tf")).first()
        if size == limit and last > others:
            return counts, top
    return taken(None)


def smooth_idf(documents, df):
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + df)) + 1.0


def tfidf_vocabulary(
    docs: DataFrame, stop_words: Sequence[str], min_df: int = 5, max_df: float = 0.85,
    max_features: int = 3000, text: str = TEXT, words: DataFrame | None = None, uses: DataFrame | None = None,
) -> DataFrame:
    """(term, tf, df, idf) of the most frequent terms within the document frequency limits.

    ``words`` and ``uses``: the documents' ``kept_words`` and ``word_uses``, where they are there already.
    """
    words = kept_words(docs, stop_words, text) if words is None else words
    n_docs = words.agg(F.count("words")).scalar()

    def limited(known: Sequence[str] | None) -> DataFrame:
        return term_stats(words, known=known).where(
            (F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs))

    kept = most_used(words, limited, lambda counts: counts, max_features, uses)[1]
    return kept.orderBy(F.desc("tf"), "term").withColumn("idf", smooth_idf(n_docs, F.col("df")))


def tfidf_vectors(
    docs: DataFrame, vocabulary: DataFrame, stop_words: Sequence[str],
    text: str = TEXT, keys: Sequence[str] = KEYS, words: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """L2-normed sparse TF-IDF vectors and the terms by position; ``words``: the documents' ``kept_words`` by key."""
    rows = sorted(vocabulary.select("term", "idf").collect())  # at most max_features rows
    if not rows:
        raise ValueError("no term passes the document frequency limits")
    names, idf = [r.term for r in rows], np.array([r.idf for r in rows])
    # Terms with other words have no column.
    known = sorted({w for n in names for w in n.split(" ")})
    place = {w: k for k, w in enumerate(known)}
    parts = [[place[w] for w in n.split(" ")] for n in names]
    codes = np.array([p[0] * (len(known) + 1) + (p[1] + 1 if len(p) > 1 else 0) for p in parts], np.int64)
    order = np.argsort(codes)
    key_names, size = list(keys), len(names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, ranked = pa.array(known, pa.string()), codes[order]
        for batch in batches:
            at, found = _term_codes(*_flat_words(batch.column("words")), listed)
            near = np.minimum(np.searchsorted(ranked, found), size - 1)
            held = ranked[near] == found
            cells, times = np.unique(at[held] * size + order[near[held]], return_counts=True)
            at, cols = cells // size, cells % size
            values = times * idf[cols]
            values /= np.sqrt(np.bincount(at, values * values, batch.num_rows))[at]
            bounds = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=batch.num_rows))), pa.int32())
            features = pa.StructArray.from_arrays(
                [pa.array(np.zeros(batch.num_rows, np.int8)), pa.array(np.full(batch.num_rows, size, np.int32)),
                 pa.ListArray.from_arrays(bounds, pa.array(cols.astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(values))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*map(batch.column, key_names), features], [*key_names, "features"])

    words = docs.select(*keys, terms(F.col(text), stop_words, bigrams=False).alias("words")) if words is None else words
    schema = words.select(*keys).schema.add("features", VectorUDT())
    return words.select(*keys, "words").mapInArrow(step, schema), names


def _packed(lists: pa.Array) -> pa.Array:
    """Lists of numbers as the bytes of their numbers, so that later passes move them whole; null stays null."""
    numbers = lists.flatten()
    if numbers.null_count:
        raise ValueError("a vector holds a null")
    values = numbers.to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    bounds = pa.py_buffer(np.append(0, np.cumsum(sizes) * values.itemsize).astype(np.int32))
    valid = None if not lists.null_count else pc.is_valid(lists).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, bounds, pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(packed: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row holds, and all numbers."""
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(0, dtype)
    numbers = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]].view(dtype)
    return np.diff(bounds) // np.dtype(dtype).itemsize, numbers


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, column numbers and values of a batch of sparse rows."""
    sizes, cols = _unpacked(batch.column("indices"), "<i4")
    return np.repeat(np.arange(batch.num_rows), sizes), cols.astype(np.int64), _unpacked(batch.column("values"), "<f8")[1]


def _row_weights(rows, cols, values, n_rows: int, h: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative least squares weights of each row on the fixed topics, by coordinate descent."""
    k = h.shape[0]
    target = np.stack([np.bincount(rows, weights=values * h[j, cols], minlength=n_rows) for j in range(k)], axis=1)
    gram = h @ h.T
    w = np.zeros((n_rows, k))
    for _ in range(sweeps):
        for j in range(k):
            if gram[j, j] > 0:
                w[:, j] = np.maximum(0.0, w[:, j] + (target[:, j] - w @ gram[:, j]) / gram[j, j])
    return w


def nmf_topics(
    vectors: DataFrame, names: Sequence[str], topics: int = 8, max_iter: int = 300, tol: float = 1e-4,
    seed: int = 42, sweeps: int = 20, top_terms: int = 15, keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Non-negative factorisation by alternating least squares.

    Rows only meet the small topic-term matrix, which every task gets with the closure. A
    task returns its share of the two sums that the next matrix needs, Spark adds the
    shares up, and topics x terms numbers reach the driver per round. Returns the topic of
    every document, the top terms with document counts, and the loss of every round.
    """
    n_terms = len(names)
    key_names = list(keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_packed(batch.column(name)) for name in ("indices", "values")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, key_names), *lists], [*key_names, "indices", "values"])

    sparse = written(vectors.select(*keys, F.unwrap_udt("features").alias("v")).select(*keys, "v.indices", "v.values").mapInArrow(
        pack, vectors.select(*keys).schema.add("indices", "binary").add("values", "binary")), "sparse")
    h = np.random.default_rng(seed).random((topics, n_terms)) / np.sqrt(n_terms)
    gram_start, loss_at = n_terms, n_terms + topics

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, gram, loss = np.zeros((topics, n_terms)), np.zeros((topics, topics)), 0.0
        for batch in batches:
            rows, cols, values = _flat(batch)
            w = _row_weights(rows, cols, values, batch.num_rows, h, sweeps)
            here = np.stack([np.bincount(cols, weights=values * w[rows, j], minlength=n_terms) for j in range(topics)])
            inner = w.T @ w
            loss += float(values @ values) - 2.0 * float((here * h).sum()) + float((inner * (h @ h.T)).sum())
            cross += here
            gram += inner
        block = np.concatenate([cross, gram], axis=1)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(np.repeat(np.arange(topics), n_terms + topics), 0), pa.int32()),
            pa.array(np.append(np.tile(np.arange(n_terms + topics), topics), loss_at), pa.int32()),
            pa.array(np.append(block.ravel(), loss))], ["topic", "position", "amount"])

    losses: list[float] = []
    for _ in range(max_iter):
        summed = sparse.select("indices", "values").mapInArrow(
            shares, "topic int, position int, amount double").groupBy("topic", "position").agg(
            F.sum("amount").alias("amount")).toPandas()
        whole = np.zeros((topics, n_terms + topics + 1))
        whole[summed["topic"], summed["position"]] = summed["amount"]
        cross, gram = whole[:, :n_terms], whole[:, gram_start:loss_at]
        losses.append(float(whole[0, loss_at]))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tol * losses[0]:
            break
        fresh = h.copy()
        for _inner in range(sweeps):
            for j in range(topics):
                if gram[j, j] > 0:
                    fresh[j] = np.maximum(0.0, fresh[j] + (cross[j] - gram[j] @ fresh) / gram[j, j])
        h = fresh

    schema = sparse.select(*keys).schema.add("topic_id", T.IntegerType())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols, values = _flat(batch)
            w = _row_weights(rows, cols, values, batch.num_rows, h, sweeps)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, key_names), pa.array(w.argmax(axis=1).astype(np.int32))], [*key_names, "topic_id"])

    assigned = sparse.mapInArrow(assign, schema)
    best = [
        (j, [names[i] for i in np.lexsort((np.arange(n_terms), -h[j]))[:top_terms]]) for j in range(topics)]
    described = vectors.sparkSession.createDataFrame(best, "topic_id int, top_terms array<string>").join(
        assigned.groupBy("topic_id").agg(F.count("*").alias("review_count")), "topic_id", "left").na.fill(
        0, ["review_count"])
    return assigned, described, losses


def hashed_embeddings(docs: DataFrame, dimensions: int = 256, text: str = TEXT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Default encoder: hashed word counts on the unit sphere, all in the JVM."""
    staged = docs.select(*keys, word_list(F.lower(F.col(text))).alias("words"))
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=dimensions).transform(staged)
    return Normalizer(p=2.0, inputCol="counts", outputCol="unit").transform(hashed).select(
        *keys, vector_to_array("unit", "float32").alias("embedding"))


def encode_with_model(
    docs: DataFrame, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64,
    text: str = TEXT, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Embeddings from a pluggable encoder, loaded once per task; whole texts."""
    schema = docs.select(*keys).schema.add("embedding", T.ArrayType(T.FloatType()))
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for frame in frames:
            texts = frame[text].fillna("").astype(str).tolist()
            parts = [encoder(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]
            vectors = np.concatenate(parts).astype("float32")
            yield frame[names].assign(embedding=list(vectors))

    return docs.select(*keys, text).mapInPandas(run, schema)


def _nearest(points: np.ndarray, squares: np.ndarray, runs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For every run and point the place of the nearest centre, the first of equals, and its squared distance."""
    centers = np.concatenate(runs)
    apart = (centers * centers).sum(axis=1) - 2.0 * (points @ centers.T)
    place, low = [], []
    for own in np.split(apart, np.cumsum([len(c) for c in runs])[:-1], axis=1):
        place.append(own.argmin(axis=1))
        low.append(own[np.arange(len(own)), place[-1]])
    return np.stack(place), np.maximum(0.0, squares + np.stack(low))


def embedding_topics(
    embeddings: DataFrame, topics: int = 8, seed: int = 42, keys: Sequence[str] = ("vec_id",), max_iter: int = 300,
    starts: int = 10, tol: float = 1e-4,
) -> DataFrame:
    """k-means cluster per row: the best of ``starts`` runs by its distance to the centres.

    ``KMeans`` chooses the first centres of every run. The rounds of all runs then share their passes:
    a task returns its share of the sums of every cluster, Spark adds the shares up, and runs x
    topics x dimensions numbers reach the driver per round.
    """
    key_names = list(keys)
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    # Vectors for the JVM, and their numbers as bytes for the rounds; neither is taken apart again.
    vectors = checkpointed(embeddings.select(
        *keys, array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("values")
            if kind == "<f4":
                numbers = numbers.cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, key_names), _packed(numbers)], [*key_names, "packed"])

    rows = written(vectors.select(*keys, vector_to_array("features").alias("values")).mapInArrow(
        pack, vectors.select(*keys).schema.add("packed", "binary")), "points")
    runs = [np.array(KMeans(k=topics, seed=seed + k, maxIter=0, solver="row").fit(vectors.select("features")).clusterCenters())
            for k in range(starts)]
    dimensions = runs[0].shape[1]

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        points = _unpacked(batch.column("packed"), kind)[1].reshape(-1, dimensions).astype(np.float64)
        return points, (points * points).sum(axis=1)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [runs[r] for r in moving]
        sums = np.zeros((len(own) * topics, dimensions + 2))     # of the points, how many, of the distances
        for batch in batches:
            points, squares = numbers(batch)
            place, apart = _nearest(points, squares, own)
            cells = place + topics * np.arange(len(own))[:, None]
            member = np.zeros((len(sums), len(points)))
            member[cells, np.arange(len(points))] = 1.0
            sums[:, :dimensions] += member @ points
            sums[:, dimensions] += member.sum(axis=1)
            sums[:, dimensions + 1] += np.bincount(cells.ravel(), apart.ravel(), len(sums))
        block = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(block))), pa.array(block)], ["position", "amount"])

    costs, moving = [0.0] * starts, list(range(starts))
    for _ in range(max_iter):
        summed = rows.select("packed").mapInArrow(shares, "position long, amount double").groupBy("position").agg(
            F.sum("amount").alias("amount")).toPandas()
        whole = np.zeros(len(moving) * topics * (dimensions + 2))
        whole[summed["position"]] = summed["amount"]
        on = []
        for r, own in zip(moving, whole.reshape(len(moving), topics, -1)):
            held = own[:len(runs[r]), dimensions] > 0        # a cluster without points keeps its centre
            fresh = runs[r].copy()
            fresh[held] = own[:len(runs[r])][held, :dimensions] / own[:len(runs[r])][held, dimensions, None]
            costs[r] = own[:, dimensions + 1].sum()
            if (((fresh - runs[r]) ** 2).sum(axis=1) > tol * tol).any():
                on.append(r)
            runs[r] = fresh
        moving = on
        if not moving:
            break
    best = runs[min(range(starts), key=costs.__getitem__)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _nearest(*numbers(batch), [best])[0][0]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, key_names), pa.array(place.astype(np.int32))], [*key_names, "topic_id"])

    return rows.select(*keys, "packed").mapInArrow(assign, rows.select(*keys).schema.add("topic_id", "integer"))


def cluster_terms(
    docs: DataFrame, stop_words: Sequence[str], cluster: str = "topic_id", max_features: int = 5000,
    top: int = 15, text: str = TEXT, words: DataFrame | None = None, uses: DataFrame | None = None,
) -> DataFrame:
    """TF-IDF over clusters, each cluster one document: the top terms by rank.

    ``words`` and ``uses``: the ``kept_words`` by cluster and their ``word_uses``, where they are there already.
    """
    words = kept_words(docs, stop_words, text, by=[cluster]) if words is None else words

    def totals(counts: DataFrame) -> DataFrame:
        return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))

    # The vocabulary is cut before clusters are compared; max_features bounds this side.
    counts, found = most_used(words, lambda known: term_uses(words, [cluster], known), totals, max_features, uses)
    vocabulary = found.select("term", "df")
    n_clusters = words.agg(F.count_distinct(cluster)).scalar()
    raw = counts.join(vocabulary, "term").withColumn("raw", F.col("tf") * smooth_idf(n_clusters, F.col("df")))
    group = Window.partitionBy(cluster)
    rank = F.row_number().over(group.orderBy(F.desc("score"), "term"))
    scored = raw.withColumn("score", F.round(
        F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(group)), 9))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(cluster, "rank", "term", "tf", "score")


def topic_samples(
    docs: DataFrame, cluster: str = "topic_id", count: int = 5, excerpt: int = 300,
    text: str = TEXT, keys: Sequence[str] = KEYS,
) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(*keys))
    return docs.withColumn("position", rank).where(F.col("position") <= count).select(
        cluster, "position", *keys, F.substring(text, 1, excerpt).alias("sample"))


def topic_labels(ranked_terms: DataFrame, sizes: DataFrame, cluster: str = "topic_id") -> DataFrame:
    """"Topic i: a / b / c" and a sentence, from the ranked terms of each cluster."""
    ordered = ranked_terms.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("r"))
    terms_only = ordered.select(cluster, F.col("r.term").alias("representative_terms"))
    name = F.col(cluster).cast("string")
    return terms_only.join(sizes, cluster).select(
        cluster, "representative_terms", "review_count",
        F.concat(F.lit("Topic "), name, F.lit(": "), F.concat_ws(" / ", F.slice("representative_terms", 1, 3)))
        .alias("topic_label"),
        F.concat(F.lit("Cluster dominated by terms: "), F.concat_ws(", ", F.slice("representative_terms", 1, 5)),
                 F.lit(". Contains "), F.col("review_count").cast("string"), F.lit(" reviews.")).alias("interpretation"))


def aspect_mining(
    reviews: DataFrame, stop_words: Sequence[str], vocabulary: int = 200, min_df: int = 10, top: int = 30,
    text: str = TEXT, label: str = "sentiment_label",
) -> DataFrame:
    """Terms of negative reviews by their ratio to positive ones.

    A term outside the positive vocabulary counts as one positive use.
    """
    words = kept_words(reviews.where(F.col(label).isin("Negative", "Positive")), stop_words, text, by=[label])

    def side(name: str) -> DataFrame:
        own = words.where(F.col(label) == name)
        return most_used(
            own, lambda known: term_stats(own, known=known).where(F.col("df") >= min_df), lambda counts: counts,
            vocabulary)[1].select("term", "tf")

    negative = side("Negative").withColumnRenamed("tf", "negative_freq")
    positive = side("Positive").withColumnRenamed("tf", "positive_freq")
    ratio = F.col("negative_freq") / (F.coalesce("positive_freq", F.lit(1)) + 1)
    return negative.join(positive, "term", "left").withColumn("ratio", ratio).orderBy(
        F.desc("ratio"), F.desc("negative_freq"), "term").limit(top).select("term", "negative_freq", "ratio")


def topic_id_differences(topics: DataFrame, names: Mapping[int, str] = TOPIC_NAMES) -> DataFrame:
    """Ids that only the model output or only the name list has."""
    known = topics.sparkSession.createDataFrame(list(names.items()), "topic_id int, business_topic_name string")
    return topics.select("topic_id").distinct().join(known, "topic_id", "full").join(
        topics.select(F.col("topic_id"), F.lit(True).alias("in_model")).distinct(), "topic_id", "left").where(
        F.col("business_topic_name").isNull() | F.col("in_model").isNull()).select(
        "topic_id", F.coalesce("in_model", F.lit(False)).alias("in_model"))


def topic_dimension(topics: DataFrame, names: Mapping[int, str] = TOPIC_NAMES, strict: bool = True) -> DataFrame:
    """Business name per topic id; ``strict`` stops when the id sets differ."""
    if strict:
        odd = topic_id_differences(topics, names).collect()  # bounded by the number of topics
        if odd:
            raise ValueError(f"topic ids and names do not match: {sorted(r.topic_id for r in odd)}")
    known = topics.sparkSession.createDataFrame(list(names.items()), "topic_id int, business_topic_name string")
    return topics.join(known, "topic_id", "left").withColumn(
        "business_topic_name", F.coalesce("business_topic_name", F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))))
