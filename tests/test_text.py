import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import reviews_text, signals, topics
from orderloom.functions.vocabulary import SIGNAL_PATTERNS


@pytest.mark.parametrize("message,signal", [
    ("O tênis é falsificado e o selo é falso.", "Counterfeit or not original"),
    ("Veio uma réplica, não é original!", "Counterfeit or not original"),
    ("Caí num golpe, devolvam o dinheiro", "Scam or fraud"),
    ("Fui enganada por esta loja", "Scam or fraud"),
    ("Clonaram? Sim, cartão clonado.", "Stolen or cloned"),
])
def test_signal_is_found(spark, message, signal):
    row = signals.flag_signals(spark.createDataFrame([(message,)], f"{signals.TEXT} string")).first()
    assert row[signal] and row.any_signal


@pytest.mark.parametrize("message", ["Muito bom, chegou rápido", "O original é lindo", "Sem defeito, recomendo"])
def test_clean_text_has_no_signal(spark, message):
    row = signals.flag_signals(spark.createDataFrame([(message,)], f"{signals.TEXT} string")).first()
    assert not row.any_signal and not any(row[n] for n in SIGNAL_PATTERNS)


@pytest.fixture(scope="module")
def reviews(spark):
    themes = ["entrega rapida prazo", "produto quebrado defeito", "preco caro valor"]
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        words = themes[i % 3].split()
        rows.append((i, i // 2, int(i % 5) + 1, " ".join(rng.choice(words, 6)), i % 3))
    return spark.createDataFrame(rows, "review_id long, order_id long, review_score int, review_comment_message string, theme int")


def test_factorisation_finds_the_themes(reviews):
    vocabulary = topics.tfidf_vocabulary(reviews, [], min_df=2, max_df=0.9)
    vectors, names = topics.tfidf_vectors(reviews, vocabulary, [])
    assigned, described, losses = topics.nmf_topics(vectors, names, topics=3, max_iter=40, tol=1e-6, sweeps=30)
    assert all(later <= earlier + 1e-9 for earlier, later in zip(losses, losses[1:]))
    joined = assigned.join(reviews, ["review_id", "order_id"]).groupBy("theme", "topic_id").count().collect()
    assert sum(r["count"] for r in joined) == 120
    largest = {}
    for r in joined:
        largest[r.theme] = max(largest.get(r.theme, 0), r["count"])
    assert sum(largest.values()) >= 110
    assert sum(r.review_count for r in described.collect()) == 120


def test_vectors_have_unit_length(reviews):
    vectors, _ = topics.tfidf_vectors(reviews, topics.tfidf_vocabulary(reviews, [], 2, 0.9), [])
    squares = vectors.select(F.aggregate(
        F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, x: a + x * x).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in squares)


def test_clusters_cover_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(i % 4 * 10, 1, 8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sizes = topics.embedding_topics(df, topics=4).groupBy("topic_id").count().collect()
    assert sum(r["count"] for r in sizes) == 200 and len(sizes) == 4


def test_failed_batch_is_reported_not_invented(reviews):
    def load():
        def score(texts):
            if any("quebrado" in t for t in texts):
                raise RuntimeError("model down")
            return [("LABEL_positive", 0.98765)] * len(texts)
        return score

    got = reviews_text.score_with_model(reviews, load, batch_size=1).collect()
    bad = [r for r in got if r.error]
    assert len(got) == 120 and bad and all(r.sentiment_label is None for r in bad)
    assert {(r.sentiment_label, r.sentiment_score) for r in got if not r.error} == {("Positive", 0.9877)}


def test_model_sees_whole_texts_unless_clipped(spark):
    df = spark.createDataFrame([(1, 1, "x" * 5000)], "review_id long, order_id long, review_comment_message string")
    load = lambda: lambda texts: [("neutral", float(len(t))) for t in texts]
    assert reviews_text.score_with_model(df, load).first().sentiment_score == 5000.0
    assert reviews_text.score_with_model(df, load, clip=500).first().sentiment_score == 500.0


def test_increment_scores_only_new_reviews(reviews, tmp_path):
    calls = str(tmp_path / "store")
    load = reviews_text.word_share_scorer(["rapida"], ["quebrado"])
    first = reviews_text.score_increment(reviews.where("review_id < 50"), calls, load)
    assert first.count() == 50
    again = reviews_text.score_increment(reviews, calls, load)
    assert again.count() == 120 and again.select("review_id").distinct().count() == 120


def test_topic_names_must_match(spark):
    df = spark.createDataFrame([(0, 5), (9, 2)], "topic_id int, review_count long")
    with pytest.raises(ValueError, match="9"):
        topics.topic_dimension(df, {0: "Zero"})
    names = {r.topic_id: r.business_topic_name for r in topics.topic_dimension(df, {0: "Zero"}, strict=False).collect()}
    assert names == {0: "Zero", 9: "Topic 9"}


def test_most_used_terms_leave_rare_words_uncounted(spark):
    import collections
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") * 2 if draw.random() < 0.7 else f"rare{draw.randrange(4000)}" for _ in range(60))
             for _ in range(60)]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate([*texts, None, ""])], "topic_id int, review_comment_message string")
    words = topics.kept_words(docs, ["aa"], by=["topic_id"])
    expected, spread = collections.Counter(), collections.defaultdict(set)
    for i, t in enumerate(texts):
        kept = [w for w in t.split() if w != "aa"]
        for term in [*kept, *(f"{a} {b}" for a, b in zip(kept, kept[1:]))]:
            expected[term] += 1
            spread[term].add(i)
    ranked = sorted(expected.items(), key=lambda e: (-e[1], e[0]))

    def top(limit):
        return topics.most_used(words, lambda known: topics.term_stats(words, known=known), lambda c: c, limit)

    counts, found = top(5)  # ten words are looked at, seven of them often used
    assert [(r.term, r.tf, r.df) for r in found.orderBy(F.desc("tf"), "term").collect()] == [
        (t, n, len(spread[t])) for t, n in ranked[:5]]
    assert counts.count() < 200 < len(expected)
    counts, found = top(400)  # the last ranks are tied with words left out: all are counted
    assert [(r.term, r.tf) for r in found.orderBy(F.desc("tf"), "term").collect()] == ranked[:400]
    assert counts.count() == len(expected)
    counts, found = top(len(expected) + 1)
    assert found.count() == len(expected)


def test_known_words_are_counted_and_weighed_without_making_their_terms(spark, monkeypatch):
    """Terms of the most used words, and vectors, come from codes: no term of a rare word is ever spelled."""
    texts = ["aa bb aa bb cc", "bb aa zz bb", None, "", "cc bb aa", "zz"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "review_id long, order_id long, review_comment_message string")
    words = topics.kept_words(docs, [], by=["review_id", "order_id"])
    monkeypatch.setattr(topics, "with_pairs", None)
    got = {r.term: (r.tf, r.df) for r in topics.term_stats(words, known=["bb", "aa"]).collect()}
    assert got == {"aa": (4, 3), "bb": (5, 3), "aa bb": (2, 1), "bb aa": (3, 3)}
    per = topics.term_uses(words, ["review_id"], ["aa"]).collect()
    assert {(r.review_id, r.term, r.tf) for r in per} == {(0, "aa", 2), (1, "aa", 1), (4, "aa", 1)}
    vocabulary = spark.createDataFrame([("aa", 1.0), ("aa bb", 2.0), ("cc", 3.0)], "term string, idf double")
    vectors, names = topics.tfidf_vectors(docs, vocabulary, [])
    rows = {r.review_id: r.features for r in vectors.collect()}
    assert names == ["aa", "aa bb", "cc"] and len(rows) == 6
    expected = np.array([2.0, 4.0, 3.0]) / np.sqrt(29.0)
    assert np.allclose(rows[0].toArray(), expected) and rows[2].numNonzeros() == 0 == rows[5].numNonzeros()


def test_all_runs_of_a_clustering_share_their_rounds(spark, monkeypatch):
    """Every run's rounds are Lloyd's on the first centres that KMeans chose; KMeans itself makes none."""
    from pyspark.ml.clustering import KMeans

    asked, first = [], []

    class Watched(KMeans):
        def __init__(self, **options):
            asked.append(options["maxIter"])
            super().__init__(**options)

        def fit(self, frame):
            model = super().fit(frame)
            first.append(np.array(model.clusterCenters()))
            return model

    monkeypatch.setattr(topics, "KMeans", Watched)
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (300, 5))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.topic_id for r in topics.embedding_topics(df, topics=4, starts=3).collect()}
    assert asked == [0, 0, 0]
    ends = []
    for centers in first:
        for _ in range(300):
            apart = ((points[:, None] - centers) ** 2).sum(axis=2)
            place, cost = apart.argmin(axis=1), apart.min(axis=1).sum()
            fresh = np.array([points[place == k].mean(axis=0) if (place == k).any() else centers[k] for k in range(len(centers))])
            still = (((fresh - centers) ** 2).sum(axis=1) <= 1e-8).all()
            centers = fresh
            if still:
                break
        ends.append((cost, ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)))
    assert [got[i] for i in range(300)] == min(ends, key=lambda e: e[0])[1].tolist()
