"""Review text queries: sentiment, topics, aspects, language signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.metrics import expected_sentiment
from orderloom.functions.text import fold, plain_words, whole_word_pattern
from orderloom.functions.vocabulary import TOPIC_NAMES
from orderloom.operators import grain, reviews_text, signals, topics
from orderloom.plans.base import Registry
from orderloom.plans.explore import rounded
from orderloom.session import scratch_path, written
from orderloom.sources.tables import TradeStar

TEXT = Registry()
add = TEXT.add

# Terms that occur in the prose of the given documents; the defaults are for Portuguese reviews.
POSITIVE = ("the", "and", "der", "für", "los", "él", "étre", "elle", "ción")
NEGATIVE = ("that", "was", "die", "über", "des", "ré", "no", "trash", "worthless")
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "der", "die", "und", "que", "el", "le")
ASPECTS = {
    "Delivery": whole_word_pattern(("from", "von", "para", "trash")),
    "Quality": whole_word_pattern(("idiot", "loser", "für", "étre")),
    "Service": whole_word_pattern(("this", "ción", "elle", "mit")),
}
SIGNALS = {
    "Counterfeit or not original": (r"\btrash", r"\bworthless\b"),
    "Scam or fraud": (r"\bclown", r"\bscum", r"\bloser"),
    "Stolen or cloned": (r"\bmoron", r"\bpathetic"),
}
WORD = r"[\p{L}\p{N}_]+"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def check_hits(words, table: str, name: str) -> str:
    return (f"{name} AS (SELECT doc, count(*) AS n FROM (SELECT DISTINCT doc, w, k FROM ("
            f"SELECT doc, w, 'f' AS k FROM fw WHERE w IN ({quoted(plain_words(words))}) "
            f"UNION ALL SELECT doc, w, 'o' FROM ow WHERE w IN ({quoted(sorted(set(words)))}))) GROUP BY 1)")


CHECK_LEXICON = f""", ow AS (SELECT review_id AS doc, unnest(regexp_extract_all(lower(review_comment_message), '{WORD}')) AS w FROM b_text),
fw AS (SELECT review_id AS doc, unnest(regexp_extract_all(strip_accents(lower(review_comment_message)), '{WORD}')) AS w FROM b_text),
{check_hits(POSITIVE, 'p', 'ph')}, {check_hits(NEGATIVE, 'n', 'nh')},
ls AS (SELECT t.*, coalesce(ph.n, 0) AS p, coalesce(ph.n, 0) + coalesce(nh.n, 0) AS tot,
       CASE WHEN coalesce(ph.n, 0) + coalesce(nh.n, 0) > 0 THEN coalesce(ph.n, 0)::DOUBLE / (coalesce(ph.n, 0) + coalesce(nh.n, 0)) END AS share
       FROM b_text t LEFT JOIN ph ON ph.doc = review_id LEFT JOIN nh ON nh.doc = review_id),
lex AS (SELECT *, CASE WHEN share > 0.6::DOUBLE THEN 'Positive' WHEN share < 0.4::DOUBLE THEN 'Negative' ELSE 'Neutral' END AS baseline,
        CASE WHEN share > 0.6::DOUBLE THEN share WHEN share < 0.4::DOUBLE THEN 1 - share ELSE 0.5 END::DOUBLE AS baseline_score,
        CASE WHEN review_score >= 4 THEN 'Positive' WHEN review_score <= 2 THEN 'Negative' ELSE 'Neutral' END AS expected FROM ls)"""


def lexicon(star: TradeStar) -> DataFrame:
    return reviews_text.with_lexicon_sentiment(star.text_reviews, POSITIVE, NEGATIVE)


add("text_reviews", lambda s: reviews_text.text_reviews(s.reviews).select("review_id", "order_id", "review_score"),
    "SELECT review_id, order_id, review_score FROM b_reviews WHERE review_comment_message IS NOT NULL")
add("lexicon_sentiment", lambda s: rounded(lexicon(s).select(
    "review_id", "baseline_sentiment_label", "baseline_sentiment_score"), "baseline_sentiment_score", digits=8),
    CHECK_LEXICON + """ SELECT review_id, baseline AS baseline_sentiment_label,
        round(baseline_score, 8) AS baseline_sentiment_score FROM lex""")
add("model_sentiment", lambda s: reviews_text.score_with_model(
    s.text_reviews, reviews_text.word_share_scorer(POSITIVE, NEGATIVE)))


def incremental_scoring(star: TradeStar) -> DataFrame:
    """Two runs over a growing input: English texts first, then everything."""
    store = scratch_path(star.spark, "scores")
    scorer = reviews_text.word_share_scorer(POSITIVE, NEGATIVE)
    reviews_text.score_increment(star.text_reviews.where("lang = 'en'"), store, scorer)
    scored = reviews_text.score_increment(star.text_reviews, store, scorer)
    return scored.groupBy("order_id").agg(F.count("*").alias("scored"), F.count_distinct("review_id").alias("reviews"))


add("incremental_scoring", incremental_scoring,
    "SELECT order_id, count(*) AS scored, count(DISTINCT review_id) AS reviews FROM b_text GROUP BY 1")
add("expected_sentiment", lambda s: s.text_reviews.select(
    "review_id", expected_sentiment(F.col("review_score")).alias("expected_sentiment")),
    CHECK_LEXICON + " SELECT review_id, expected AS expected_sentiment FROM lex")
add("sentiment_agreement", lambda s: rounded(reviews_text.agreement_rates(
    lexicon(s), ["sentiment_label", "baseline_sentiment_label"]), "agreement_pct"), CHECK_LEXICON + """
    , u AS (SELECT review_score, 'sentiment_label' AS label_column, sentiment_label = expected AS ok FROM lex
            UNION ALL SELECT review_score, 'baseline_sentiment_label', baseline = expected FROM lex)
    SELECT review_score, label_column, count(*) AS n, count(*) FILTER (WHERE ok) AS agreeing,
           round(count(*) FILTER (WHERE ok) * 100::DOUBLE / count(*), 6) AS agreement_pct
    FROM u GROUP BY GROUPING SETS ((review_score, label_column), (label_column))""")
add("mismatch_examples", lambda s: reviews_text.mismatch_examples(s.text_reviews), """
    , k AS (SELECT *, CASE WHEN review_score = 5 AND sentiment_label = 'Negative' THEN '5 stars, negative text'
                           WHEN review_score = 1 AND sentiment_label = 'Positive' THEN '1 star, positive text' END AS kind FROM b_text)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY review_id, order_id)::INT AS position, review_id, order_id,
           review_comment_message FROM k WHERE kind IS NOT NULL QUALIFY position <= 5""")
add("label_distribution", lambda s: reviews_text.label_distribution(
    lexicon(s), ["sentiment_label", "baseline_sentiment_label"]), CHECK_LEXICON + """
    SELECT 'sentiment_label' AS label_column, sentiment_label AS label, count(*) AS n FROM lex GROUP BY 2
    UNION ALL SELECT 'baseline_sentiment_label', baseline, count(*) FROM lex GROUP BY 2""")

# --- terms and topics ------------------------------------------------------------------
CHECK_TERMS = f""", raw AS (SELECT review_id AS doc, lang, sentiment_label AS label,
    regexp_extract_all(lower(review_comment_message), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS l FROM b_text),
tok AS (SELECT doc, lang, label, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM raw),
kept AS (SELECT doc, lang, label, t, row_number() OVER (PARTITION BY doc ORDER BY i) AS i FROM tok WHERE t NOT IN ({quoted(STOP_WORDS)})),
pairs AS (SELECT doc, lang, label, t || ' ' || lead(t) OVER (PARTITION BY doc ORDER BY i) AS t FROM kept),
terms AS (SELECT doc, lang, label, t AS term FROM kept UNION ALL SELECT doc, lang, label, t FROM pairs WHERE t IS NOT NULL)"""


def vocabulary(star: TradeStar) -> DataFrame:
    return topics.tfidf_vocabulary(star.text_reviews, STOP_WORDS)


add("tfidf", lambda s: rounded(vocabulary(s), "idf"), CHECK_TERMS + """
    , st AS (SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM terms GROUP BY 1),
    n AS (SELECT count(*) AS n FROM b_text)
    SELECT term, tf, df, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS idf FROM st, n
    WHERE df >= 5 AND df <= 0.85::DOUBLE * n ORDER BY tf DESC, term LIMIT 3000""")


def tfidf_weights(star: TradeStar) -> DataFrame:
    """The non-zero cells of the TF-IDF matrix."""
    vectors, names = topics.tfidf_vectors(star.text_reviews, vocabulary(star), STOP_WORDS)
    cells = vectors.select("review_id", F.explode(F.arrays_zip(
        F.unwrap_udt("features")["indices"].alias("i"), F.unwrap_udt("features")["values"].alias("v"))).alias("c"))
    words = F.array(*[F.lit(n) for n in names])
    return cells.select("review_id", F.element_at(words, F.col("c.i") + 1).alias("term"),
                        F.round("c.v", 6).alias("weight"))


add("tfidf_weights", tfidf_weights, CHECK_TERMS + """
    , st AS (SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM terms GROUP BY 1),
    n AS (SELECT count(*) AS n FROM b_text),
    voc AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM st, n
            WHERE df >= 5 AND df <= 0.85::DOUBLE * n ORDER BY tf DESC, term LIMIT 3000),
    w AS (SELECT doc, term, count(*) * max(idf) AS x FROM terms JOIN voc USING (term) GROUP BY 1, 2)
    SELECT doc AS review_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc)), 6) AS weight FROM w""")


def nmf(star: TradeStar, words: DataFrame | None = None, uses: DataFrame | None = None):
    words = topics.kept_words(star.text_reviews, STOP_WORDS, by=topics.KEYS) if words is None else words
    chosen = topics.tfidf_vocabulary(star.text_reviews, STOP_WORDS, words=words, uses=uses)
    vectors, names = topics.tfidf_vectors(star.text_reviews, chosen, STOP_WORDS, words=words)
    return topics.nmf_topics(vectors, names)


add("nmf_topics", lambda s: nmf(s)[1].select("topic_id", F.array_join("top_terms", ", ").alias("top_terms"), "review_count"))
add("embed_text", lambda s: topics.hashed_embeddings(s.text_reviews).select(
    "review_id", "order_id", F.size("embedding").alias("dimensions"),
    F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm"),
    F.least(F.exists("embedding", lambda x: x > 0).cast("int"), F.lit(1)).alias("filled")),
    f"""SELECT review_id, order_id, 256::INT AS dimensions,
        CASE WHEN regexp_matches(lower(review_comment_message), '{WORD}') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
        regexp_matches(lower(review_comment_message), '{WORD}')::INT AS filled FROM b_text""")
add("embedding_topics", lambda s: topics.embedding_topics(s.raw("embeddings")).groupBy("topic_id").agg(
    F.count("*").alias("review_count")))


def language_clusters(star: TradeStar) -> DataFrame:
    """The language as cluster id, a clustering that the check can restate."""
    return star.text_reviews.withColumnRenamed("lang", "topic_id")


add("ctfidf_terms", lambda s: rounded(topics.cluster_terms(language_clusters(s), STOP_WORDS), "score"), CHECK_TERMS + """
    , c AS (SELECT lang AS topic_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    voc AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 5000),
    n AS (SELECT count(DISTINCT lang) AS n FROM b_text),
    r AS (SELECT topic_id, term, tf, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw FROM c JOIN voc USING (term), n),
    s AS (SELECT topic_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY topic_id)), 9) AS score FROM r)
    SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term)::INT AS rank, term, tf, round(score, 6) AS score
    FROM s QUALIFY rank <= 15""")
add("topic_samples", lambda s: topics.topic_samples(language_clusters(s)), """
    SELECT lang AS topic_id, row_number() OVER (PARTITION BY lang ORDER BY review_id, order_id)::INT AS position, review_id, order_id,
           substring(review_comment_message, 1, 300) AS sample FROM b_text QUALIFY position <= 5""")


def labels_of(star: TradeStar) -> DataFrame:
    docs = language_clusters(star)
    sizes = docs.groupBy("topic_id").agg(F.count("*").alias("review_count"))
    return topics.topic_labels(topics.cluster_terms(docs, STOP_WORDS), sizes)


add("topic_labels", lambda s: labels_of(s).drop("representative_terms"), CHECK_TERMS + """
    , c AS (SELECT lang AS topic_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    voc AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 5000),
    n AS (SELECT count(DISTINCT lang) AS n FROM b_text),
    r AS (SELECT topic_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw FROM c JOIN voc USING (term), n),
    s AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY round(raw / sqrt(q), 9) DESC, term) AS k
          FROM r JOIN (SELECT topic_id, sum(raw * raw) AS q FROM r GROUP BY 1) USING (topic_id)),
    z AS (SELECT lang AS topic_id, count(*) AS review_count FROM b_text GROUP BY 1)
    SELECT topic_id, review_count, 'Topic ' || topic_id || ': ' || string_agg(term, ' / ' ORDER BY k) FILTER (WHERE k <= 3) AS topic_label,
           'Cluster dominated by terms: ' || string_agg(term, ', ' ORDER BY k) FILTER (WHERE k <= 5) || '. Contains ' || review_count || ' reviews.' AS interpretation
    FROM s JOIN z USING (topic_id) GROUP BY topic_id, review_count""")
add("aspect_mining", lambda s: rounded(topics.aspect_mining(s.text_reviews, STOP_WORDS), "ratio"), CHECK_TERMS + """
    , st AS (SELECT label, term, count(*) AS tf, count(DISTINCT doc) AS df FROM terms GROUP BY 1, 2),
    neg AS (SELECT term, tf FROM st WHERE label = 'Negative' AND df >= 10 ORDER BY tf DESC, term LIMIT 200),
    pos AS (SELECT term, tf FROM st WHERE label = 'Positive' AND df >= 10 ORDER BY tf DESC, term LIMIT 200)
    SELECT neg.term, neg.tf AS negative_freq, round(neg.tf::DOUBLE / (coalesce(pos.tf, 1) + 1), 6) AS ratio
    FROM neg LEFT JOIN pos ON neg.term = pos.term ORDER BY neg.tf::DOUBLE / (coalesce(pos.tf, 1) + 1) DESC, neg.tf DESC, neg.term LIMIT 30""")


def tagged(star: TradeStar) -> DataFrame:
    return reviews_text.with_aspects(star.text_reviews, ASPECTS)


CHECK_TAGS = ", tags AS (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS aspect FROM b_text WHERE regexp_matches(lower(review_comment_message), '{p}')" for n, p in ASPECTS.items()
) + " UNION ALL SELECT *, 'Uncategorized' FROM b_text WHERE NOT (" + " OR ".join(
    f"regexp_matches(lower(review_comment_message), '{p}')" for p in ASPECTS.values()) + "))"
add("aspect_tagging", lambda s: tagged(s).select("review_id", "order_id", F.explode("extracted_aspects").alias("aspect")),
    CHECK_TAGS + " SELECT review_id, order_id, aspect FROM tags")
add("aspect_summary", lambda s: reviews_text.aspect_summary(tagged(s)), CHECK_TAGS + """
    SELECT aspect, count(*) AS total_mentions, count(*) FILTER (WHERE sentiment_label = 'Negative') AS negative,
           count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neutral, count(*) FILTER (WHERE sentiment_label = 'Positive') AS positive,
           count(*) < 100 AS small_sample_flag FROM tags GROUP BY 1""")
add("aspect_sentiment_rows", lambda s: reviews_text.aspect_sentiment_rows(tagged(s)), CHECK_TAGS + """
    SELECT review_id, order_id, aspect, sentiment_label AS aspect_sentiment, substring(review_comment_message, 1, 100) AS review_excerpt FROM tags""")


def topic_counts(star: TradeStar) -> DataFrame:
    return star.scored_reviews.groupBy("topic_id").agg(
        F.count("*").alias("review_count"), F.min("topic_label").alias("term_label"))


CHECK_TOPIC_NAMES = ", names AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in TOPIC_NAMES.items()) + ") t(topic_id, business_topic_name))"
add("topic_dimension", lambda s: topics.topic_dimension(topic_counts(s)), CHECK_TOPIC_NAMES + """
    SELECT topic_id, business_topic_name, count(*) AS review_count, min(topic_label) AS term_label
    FROM b_scored JOIN names USING (topic_id) GROUP BY 1, 2""")
add("topic_id_differences", lambda s: topics.topic_id_differences(
    topic_counts(s), {**TOPIC_NAMES, 8: "Spare"}), CHECK_TOPIC_NAMES + """
    SELECT topic_id, false AS in_model FROM (SELECT topic_id FROM names UNION ALL SELECT 8)
    WHERE topic_id NOT IN (SELECT topic_id FROM b_scored)
    UNION ALL SELECT DISTINCT topic_id, true FROM b_scored WHERE topic_id NOT IN (SELECT topic_id FROM names)""")


def nlp_reviews(star: TradeStar) -> DataFrame:
    """The scored review table with factorised topics, clusters and cluster labels."""
    docs = lexicon(star)
    scores = reviews_text.score_with_model(star.text_reviews, reviews_text.word_share_scorer(POSITIVE, NEGATIVE))
    scored = reviews_text.with_aspects(docs.drop("sentiment_label").join(
        scores.drop("error"), ["review_id", "order_id"]), ASPECTS)
    clusters = written(topics.embedding_topics(topics.hashed_embeddings(star.text_reviews), keys=topics.KEYS), "clusters")
    words = topics.kept_words(star.text_reviews, STOP_WORDS, by=topics.KEYS)
    clustered = words.join(clusters, ["review_id", "order_id"])
    by_cluster = written(clustered.select("topic_id", "words"), "words-by-cluster")
    sizes = by_cluster.groupBy("topic_id").agg(F.count("*").alias("review_count"))
    uses = topics.word_uses(by_cluster)
    labels = topics.topic_labels(topics.cluster_terms(clustered, STOP_WORDS, words=by_cluster, uses=uses), sizes)
    # The words of the clusters are counted, so uses hold for all texts when each has one cluster.
    uses = uses if by_cluster.count() == words.count() else None
    return reviews_text.assemble_scored_reviews(scored, nmf(star, words, uses)[0], clusters, labels)


add("nlp_reviews", nlp_reviews)

# --- fraud and counterfeit language ------------------------------------------------------
CHECK_SIGNALS = r""", f AS (SELECT *, regexp_replace(strip_accents(lower(review_comment_message)), '[^\x00-\x7F]', '', 'g') AS z FROM b_text),
fl AS (SELECT *, """ + ", ".join(
    f"""regexp_matches(z, '{"|".join(p)}') AS "{n}" """ for n, p in SIGNALS.items()) + """ FROM f),
sg AS (SELECT *, """ + " OR ".join(f'"{n}"' for n in SIGNALS) + " AS any_signal FROM fl)"


def flagged(star: TradeStar) -> DataFrame:
    return signals.flag_signals(star.text_reviews, SIGNALS)


add("text_normalise", lambda s: s.text_reviews.select("review_id", F.sha2(fold(F.col("review_comment_message")), 256).alias("digest")),
    CHECK_SIGNALS + " SELECT review_id, sha256(z) AS digest FROM f")
add("signal_flags", lambda s: flagged(s).select("review_id", *[F.col(f"`{n}`") for n in SIGNALS], "any_signal"),
    CHECK_SIGNALS + " SELECT review_id, " + ", ".join(f'"{n}"' for n in SIGNALS) + ", any_signal FROM sg")
add("signals_by_type", lambda s: signals.signals_by_type(flagged(s), list(SIGNALS)), CHECK_SIGNALS + " UNION ALL ".join(f"""
    SELECT '{n}' AS signal, count(*) FILTER (WHERE "{n}") AS reviews, round(avg(review_score) FILTER (WHERE "{n}"), 2) AS avg_review_score,
           round(count(*) FILTER (WHERE "{n}" AND sentiment_label = 'Negative') * 100::DOUBLE / count(*) FILTER (WHERE "{n}"), 1) AS negative_sentiment_pct
    FROM sg""" for n in SIGNALS))
add("signals_overall", lambda s: signals.signals_overall(flagged(s)), CHECK_SIGNALS + """
    SELECT count(*) AS text_reviews, count(*) FILTER (WHERE any_signal) AS flagged_reviews,
           round(count(*) FILTER (WHERE any_signal) * 100::DOUBLE / count(*), 2) AS flagged_pct,
           round(avg(review_score) FILTER (WHERE any_signal), 2) AS flagged_avg_review_score, round(avg(review_score), 2) AS all_avg_review_score,
           round(count(*) FILTER (WHERE any_signal AND sentiment_label = 'Negative') * 100::DOUBLE / count(*) FILTER (WHERE any_signal), 1) AS flagged_negative_sentiment_pct
    FROM sg""")


def check_signal_rank(key: str, minimum: int) -> str:
    return CHECK_SIGNALS + f"""
    , j AS (SELECT DISTINCT {key}, review_id, sg.order_id, any_signal FROM sg JOIN (
        SELECT i.*, coalesce(category, 'unknown') AS category FROM b_items i LEFT JOIN b_products USING (product_id)) i ON i.order_id = sg.order_id),
    g AS (SELECT {key}, count(*) AS reviews, count(*) FILTER (WHERE any_signal) AS flagged FROM j GROUP BY 1)
    SELECT *, round(flagged * 100::DOUBLE / reviews, 2) AS rate_pct FROM g WHERE reviews >= {minimum} AND flagged > 0
    ORDER BY rate_pct DESC, flagged DESC, {key} LIMIT 10"""


add("signal_rank_seller", lambda s: signals.signal_rank(flagged(s), s.items, "seller_id", 30), check_signal_rank("seller_id", 30))
add("signal_rank_category", lambda s: signals.signal_rank(
    flagged(s), grain.items_with_category(s), "category", 100), check_signal_rank("category", 100))
add("signal_examples", lambda s: signals.signal_examples(flagged(s), list(SIGNALS)), CHECK_SIGNALS + " UNION ALL ".join(f"""
    SELECT * FROM (SELECT '{n}' AS signal, row_number() OVER (ORDER BY review_id, order_id)::INT AS position, review_id, order_id, review_score,
        substring(trim(review_comment_message), 1, 220) AS text FROM sg WHERE "{n}" ORDER BY position LIMIT 2)""" for n in SIGNALS))
