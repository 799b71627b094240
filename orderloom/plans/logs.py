"""Conversation, request log and streaming queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions import vocabulary as v
from orderloom.functions.vocabulary import (
    FOLLOW_UP_CUES, GENERIC_WORDS, HISTORY_MESSAGES, INJECTION_PATTERNS, MESSAGE_CHARS,
)
from orderloom.operators import conversations, requests, reviews_text
from orderloom.plans.base import Registry
from orderloom.plans.text import NEGATIVE, POSITIVE
from orderloom.session import scratch_path
from orderloom.sources.tables import TradeStar
from orderloom.streaming import limiter, scoring

LOGS = Registry()
add = LOGS.add

TERMS = ("order", "ertion", "keit", "theorou", "von", "le", "of the", "in-der", "review")
SALT = "orderloom"
LOOK_BEHIND = r"(?<![\w.])"


def turns(star: TradeStar) -> DataFrame:
    return conversations.clean_turns(star.raw("conversations"))


def names(star: TradeStar) -> DataFrame:
    """Real category, segment and state names."""
    return star.raw("part").select(F.col("p_type").alias("name")).unionByName(
        star.raw("customer").select(F.col("c_mktsegment").alias("name"))).unionByName(
        star.raw("nation").select(F.col("n_name").alias("name"))).unionByName(
        star.raw("part").select(F.col("p_name").alias("name"))).distinct()


def vocabulary(star: TradeStar) -> DataFrame:
    return conversations.project_vocabulary(star.spark, names(star), TERMS)


def classified(star: TradeStar) -> DataFrame:
    return conversations.classify_turns(conversations.spoken_turns(star.raw("conversations")), vocabulary(star))


def check_normalise(text: str) -> str:
    """Collapse repeats one character at a time: the checking engine has no back-references."""
    expr = f"strip_accents(lower({text}))"
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789$%-":
        shown = f"[{ch}]" if ch in "$" else ch
        expr = f"regexp_replace({expr}, '{shown}{{3,}}', '{ch}', 'g')"
    expr = f"regexp_replace({expr}, '''{{3,}}', '''', 'g')"
    return f"trim(regexp_replace(regexp_replace({expr}, '[^a-z0-9$%''\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def plain(term: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9$%'\s-]", " ", term.lower())).strip()


CHECK_TURNS = f""", ct AS (SELECT conv_id, turn, role, substring(text, 1, {MESSAGE_CHARS}) AS text FROM conversations
  WHERE role IN ('user', 'assistant') AND length(regexp_replace(text, '\\s+', '', 'g')) > 0
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {HISTORY_MESSAGES})"""
CHECK_SPOKEN = f""", nm AS (SELECT *, {check_normalise('text')} AS norm FROM conversations
  WHERE role IN ('user', 'assistant') AND length(regexp_replace(text, '\\s+', '', 'g')) > 0)"""
CHECK_VOCABULARY = f""", li(term) AS (VALUES {', '.join(f"('{plain(t)}')" for t in TERMS)}),
na AS (SELECT DISTINCT {check_normalise("regexp_replace(name, '[_/]', ' ', 'g')")} AS term FROM (
  SELECT p_type AS name FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT n_name FROM nation UNION SELECT p_name FROM part)),
nw AS (SELECT unnest(string_split(term, ' ')) AS term FROM na),
voc AS (SELECT 'phrase' AS kind, term FROM li WHERE regexp_matches(term, '[ $-]') UNION SELECT 'phrase', term FROM na WHERE regexp_matches(term, '[ $-]')
  UNION SELECT 'prefix', term FROM li WHERE NOT regexp_matches(term, '[ $-]') AND length(term) >= 4
  UNION SELECT 'exact', term FROM li WHERE NOT regexp_matches(term, '[ $-]') AND length(term) < 4
  UNION SELECT 'exact', term FROM na WHERE NOT regexp_matches(term, '[ $-]') AND length(term) >= 5
  UNION SELECT 'exact', term FROM nw WHERE length(term) >= 5 AND term NOT IN ({', '.join(f"'{w}'" for w in GENERIC_WORDS)}))"""
CHECK_INTENTS = CHECK_SPOKEN + CHECK_VOCABULARY + f""", tw AS (SELECT conv_id, turn, norm, unnest(string_split(norm, ' ')) AS w FROM nm WHERE role = 'user'),
hit AS (SELECT conv_id, turn FROM tw JOIN voc ON kind = 'exact' AND w = term
  UNION SELECT conv_id, turn FROM tw JOIN voc ON kind = 'prefix' AND starts_with(w, term)
  UNION SELECT conv_id, turn FROM nm JOIN voc ON kind = 'phrase' AND contains(' ' || norm || ' ', ' ' || term || ' ') WHERE role = 'user'),
own AS (SELECT nm.*, CASE WHEN role <> 'user' THEN NULL WHEN norm = '' THEN 'greeting' WHEN hit.conv_id IS NOT NULL THEN 'project'
    WHEN len(string_split(norm, ' ')) <= 14 AND regexp_matches(norm, '\\b({'|'.join(FOLLOW_UP_CUES)})\\b') THEN 'follow_up' ELSE 'off_topic' END AS own
  FROM nm LEFT JOIN hit ON hit.conv_id = nm.conv_id AND hit.turn = nm.turn),
cl AS (SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN 'project' WHEN own = 'follow_up' THEN
    coalesce(last_value(CASE WHEN own IN ('project', 'off_topic') THEN own END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'off_topic')
    ELSE own END AS intent FROM own)"""

add("turns_clean", turns, CHECK_TURNS + " SELECT * FROM ct")
add("chat_normalise", lambda s: s.raw("conversations").select(
    "conv_id", "turn", conversations.chat_normalise(F.col("text")).alias("norm")),
    f"SELECT conv_id, turn, {check_normalise('text')} AS norm FROM conversations")
add("project_vocabulary", vocabulary, CHECK_VOCABULARY + " SELECT kind, term FROM voc")
add("intent_classify", lambda s: classified(s).drop("text"), CHECK_INTENTS + " SELECT * FROM cl")
SMALL_TALK = {"Hello there": "greeting", "thanks a lot!!!": "thanks", "Goodbye, see you": "farewell", "What can you do?": "capabilities"}


def small_talk(star: TradeStar) -> DataFrame:
    """The conversations with short phrases in place of four user turns of five; intents of all turns."""
    turns = star.raw("conversations")
    said = F.get(F.array(*[F.lit(t) for t in SMALL_TALK]), F.pmod("turn", F.lit(5)).cast("int"))
    changed = turns.withColumn("text", F.when(
        (F.col("role") == "user") & (F.pmod("turn", F.lit(5)) < len(SMALL_TALK)), said).otherwise(F.col("text")))
    return conversations.classify_turns(conversations.spoken_turns(changed), vocabulary(star)).select("conv_id", "turn", "intent")


SAID = "CASE turn % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(SMALL_TALK)) + " ELSE text END"
MEANT = "CASE nm.turn % 5 " + " ".join(f"WHEN {k} THEN '{i}'" for k, i in enumerate(SMALL_TALK.values())) + " END"
add("intent_small_talk", small_talk, f""", chg AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {SAID} ELSE text END AS text FROM conversations)""" + CHECK_INTENTS.replace(
    "FROM conversations", "FROM chg").replace(
    "WHEN norm = '' THEN 'greeting'", f"WHEN nm.turn % 5 < {len(SMALL_TALK)} THEN {MEANT} WHEN norm = '' THEN 'greeting'")
    + " SELECT conv_id, turn, intent FROM cl")
add("model_history", lambda s: conversations.model_history(classified(s)).drop("text"), CHECK_INTENTS + """
    , h AS (SELECT *, last_value(CASE WHEN role = 'user' THEN intent END IGNORE NULLS) OVER (
            PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS lu FROM cl)
    SELECT conv_id, turn, role, intent FROM h WHERE lu = 'project'""")
add("injection_patterns", lambda s: s.raw("documents").select("doc_id", F.array_join(
    conversations.injection_matches(F.col("text")), "|").alias("matched")), "SELECT doc_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in INJECTION_PATTERNS.items()) + ") AS matched FROM documents")

# --- request and event logs ---------------------------------------------------------------
HEX_SECRET = (r"\b[0-9a-f]{30,}",)
add("secret_redaction", lambda s: s.raw("documents").select("doc_id", requests.redact(F.col("text"), HEX_SECRET).alias("t")).select(
    "doc_id", F.sha2("t", 256).alias("digest"), (F.length("t") - F.length(F.replace(F.col("t"), F.lit("[REDACTED]"), F.lit(""))))
    .alias("redacted_chars")), rf""", r AS (SELECT doc_id, regexp_replace(text, '{HEX_SECRET[0]}', '[REDACTED]', 'g') AS t FROM documents)
    SELECT doc_id, sha256(t) AS digest, (length(t) - length(replace(t, '[REDACTED]', '')))::INT AS redacted_chars FROM r""")


def check_paths() -> str:
    """RE2 has no look-behind: the character before a path is captured and put back."""
    def replaced(text: str, pattern: str, kept: str) -> str:
        before = pattern.startswith(LOOK_BEHIND)
        pattern = (r"(^|[^\w.])" + pattern.removeprefix(LOOK_BEHIND) if before else pattern).replace("'", "''")
        kept = r"\1" + kept.replace(r"\1", r"\2") if before else kept
        return f"regexp_replace({text}, '{pattern}', '{kept}', 'g')"

    def shortened(text: str) -> str:
        return replaced(replaced(text, v.WINDOWS_PATH, r"…/\1"), v.UNIX_PATH, r"…/\1")

    hidden = "url"
    for pattern in v.HIDDEN_PATHS:
        hidden = replaced(hidden, pattern, v.HIDDEN_PATH)
    detail = shortened("'open /srv/shop/data/' || page_id || '.csv'")
    return f"SELECT page_id, sha256({shortened(hidden)}) AS digest, {detail} AS detail FROM pages"


add("path_shortening", lambda s: s.raw("pages").select("page_id", F.sha2(
    requests.shorten_paths(requests.hide_paths(F.col("url"))), 256).alias("digest"), requests.shorten_paths(F.concat(
        F.lit("open /srv/shop/data/"), F.col("page_id").cast("string"), F.lit(".csv"))).alias("detail")), check_paths())
add("client_pseudonym", lambda s: s.raw("events").select("user_id").distinct().select(
    "user_id", requests.client_pseudonym(F.col("user_id").cast("string"), SALT).alias("client")),
    f"SELECT DISTINCT user_id, 'client-' || left(sha256('{SALT}' || user_id), 12) AS client FROM events")


def events(star: TradeStar) -> DataFrame:
    return star.raw("events").select(
        "event_id", F.col("ts").alias("time"), F.col("event_type").alias("type"), F.col("event_type").alias("route"),
        F.col("user_id").alias("client"), F.col("props").alias("detail"))


def telling_events(star: TradeStar) -> DataFrame:
    """Events whose detail also names a key and two paths."""
    key = F.sha2(F.col("event_id").cast("string"), 256)
    number = F.col("event_id").cast("string")
    return events(star).withColumn("detail", F.concat(
        F.col("detail"), F.lit(" key sk-proj-"), key, F.lit(" open /srv/shop/data/"), number, F.lit(".csv or D:\\shop\\x"), number,
        F.lit(".txt")))


add("event_log_build", lambda s: requests.event_log(telling_events(s), SALT), f"""
    SELECT ts AS time, event_type AS type, event_type AS route, 'client-' || left(sha256('{SALT}' || user_id), 12) AS client,
           left(props || ' key [REDACTED] open …/' || event_id || '.csv or …/x' || event_id || '.txt', 300) AS detail FROM events""")
SHAPES = ("gsk_", "AIza", "sk-", "sk-proj-", "sk-ant-")
add("secret_shapes", lambda s: s.raw("documents").select("doc_id", F.sha2(requests.redact(F.concat_ws(
    " ", F.col("text"), *[F.concat(F.lit(p), F.sha2(F.col("doc_id").cast("string"), 256)) for p in SHAPES])), 256).alias("digest")),
    f"SELECT doc_id, sha256(text || '{' [REDACTED]' * len(SHAPES)}') AS digest FROM documents")
add("event_counts", lambda s: requests.event_counts(events(s), ("click", "purchase", "refund", "view")), """
    SELECT t.type, count(event_id) AS n FROM (VALUES ('click'), ('purchase'), ('refund'), ('view')) t(type)
    LEFT JOIN events ON event_type = t.type GROUP BY 1""")
add("recent_events", lambda s: requests.recent_events(events(s)).select("event_id", "time", "type"),
    "SELECT event_id, ts AS time, event_type AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")


def request_rows(star: TradeStar) -> DataFrame:
    """All events as requests of their user; one route, so that limits are reached."""
    return star.raw("events").select(
        "event_id", "ts", F.lit("all").alias("route"), F.col("user_id").alias("client"))


add("request_volume", lambda s: requests.trailing_volume(request_rows(s), 3600).select("event_id", "in_window"), """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window
    FROM events""")
# With two requests per hour the state is the last two admitted times and the last logged one.
CHECK_LIMIT = """, e AS (SELECT event_id, ts, user_id AS client, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
lim AS (SELECT * FROM (WITH RECURSIVE r AS (
    SELECT event_id, ts, client, rn, false AS blocked, false AS logged, us AS newer, NULL::BIGINT AS older, NULL::BIGINT AS lg FROM e WHERE rn = 1
    UNION ALL
    SELECT event_id, ts, client, rn, blocked, logged, CASE WHEN blocked THEN newer ELSE us END, CASE WHEN blocked THEN older ELSE newer END,
           CASE WHEN logged THEN us ELSE lg END
    FROM (SELECT n.event_id, n.ts, n.client, n.rn, n.us, r.newer, r.older, r.lg, coalesce(n.us - r.older < 3600000000, false) AS blocked,
                 coalesce(n.us - r.older < 3600000000, false) AND coalesce(n.us - r.lg >= 3600000000, true) AS logged
          FROM r JOIN e n ON n.client = r.client AND n.rn = r.rn + 1)) SELECT * FROM r))"""
add("rate_limit_flags", lambda s: requests.rate_limit(request_rows(s), 2, 3600).select("event_id", "client", "blocked"),
    CHECK_LIMIT + " SELECT event_id, client, blocked FROM lim")
add("rate_limit_log_once", lambda s: requests.rate_limit(request_rows(s), 2, 3600).where("logged").select("event_id", "client", "ts"),
    CHECK_LIMIT + " SELECT event_id, client, ts FROM lim WHERE logged")
add("oversize_requests", lambda s: requests.oversize_requests(s.raw("events").select(
    "event_id", F.col("event_type").alias("route"), F.col("value").alias("size")), {"click": 100.0, "view": 150.0}), """
    SELECT event_id, event_type AS route, value AS size, m AS max_size
    FROM events JOIN (VALUES ('click', 100::DOUBLE), ('view', 150::DOUBLE)) l(t, m) ON event_type = t WHERE value > m""")


# --- streams --------------------------------------------------------------------------------
def _stream_to_table(star: TradeStar, build, name: str) -> DataFrame:
    """Run a stream over the event file to its end and read what it wrote."""
    spark = star.spark
    source = spark.readStream.schema(star.raw("events").schema).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", 1000).parquet(star.folder)
    rows = source.select("event_id", "ts", F.col("event_type").alias("route"), F.col("user_id").alias("client"))
    store = scratch_path(spark, name)
    with limiter.keyed_state(spark):
        query = build(rows).writeStream.format("parquet").outputMode("append").option("path", store).option(
            "checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    scoring.run_to_end(query)
    return spark.read.parquet(store)


add("stream_rate_limit", lambda s: _stream_to_table(
    s, lambda rows: limiter.stream_rate_limit(rows.withColumn("route", F.lit("all")), 2, 3600), "limits").select(
    "event_id", "client", "blocked"), CHECK_LIMIT + " SELECT event_id, client, blocked FROM lim")
# The last hour is still open when the stream ends: windows close behind the watermark.
add("stream_volume", lambda s: _stream_to_table(
    s, lambda rows: limiter.stream_volume(rows, "1 day"), "volumes").select(
    F.col("window_start").cast("timestamp_ntz").cast("date").cast("string").alias("day"), "route", "requests"), """
    SELECT ts::DATE::VARCHAR AS day, event_type AS route, count(*) AS requests FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")


def stream_scoring(star: TradeStar) -> DataFrame:
    """Score the text files that have arrived, twice; the second run finds nothing new."""
    spark = star.spark
    source, store, state = (scratch_path(spark, n) for n in ("arrivals", "scored", "scoring-state"))
    rows = star.text_reviews.select("review_id", "order_id", reviews_text.TEXT)
    rows.write.parquet(source)
    for _ in range(2):
        scoring.run_to_end(scoring.score_new_files(
            spark, source, rows.schema, store, state, reviews_text.word_share_scorer(POSITIVE, NEGATIVE)))
    return spark.read.parquet(store).groupBy("order_id").agg(F.count("*").alias("scored"))


add("stream_scoring", stream_scoring, "SELECT order_id, count(*) AS scored FROM b_text GROUP BY 1")
