"""Conversation turns: cleaning, vocabulary, intents, model history, injection patterns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.functions import vocabulary as v
from orderloom.functions.text import literal_array, matched_names, once, unaccent
from orderloom.session import written

TURN = ("conv_id", "turn")
PHRASE_MARK = r"[ $-]"


def clean_turns(
    turns: DataFrame, keep: int = v.HISTORY_MESSAGES, clip: int = v.MESSAGE_CHARS
) -> DataFrame:
    """User and assistant turns with text: the last ``keep`` of each conversation, clipped.

    The row number is limited while rows are still unshuffled (group limit), so a
    conversation of any length sends at most ``keep`` rows per task.
    """
    spoken = turns.where(F.col("role").isin("user", "assistant") & (F.length(F.regexp_replace("text", r"\s+", "")) > 0))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return spoken.withColumn("_back", rank).where(F.col("_back") <= keep).select(
        *TURN, "role", F.substring("text", 1, clip).alias("text"))


def spoken_turns(turns: DataFrame) -> DataFrame:
    """All user and assistant turns with text, whole."""
    return turns.where(
        F.col("role").isin("user", "assistant") & (F.length(F.regexp_replace("text", r"\s+", "")) > 0)
    ).select(*TURN, "role", "text")


def carried(df: DataFrame, value: Column, name: str, cell: int = 256) -> DataFrame:
    """Add the last known ``value`` at or before each turn of its conversation.

    Turns are cut into cells of ``cell`` turn numbers. A window never holds more than a cell, and
    the cells of a conversation hand over one value each, so a conversation of any length is
    shared by many tasks.
    """
    staged = df.withColumn("_value", value).withColumn("_cell", F.floor(F.col("turn") / F.lit(cell)))
    ends = staged.where(F.col("_value").isNotNull()).groupBy("conv_id", "_cell").agg(
        F.max_by("_value", "turn").alias("_end"))
    cells = staged.select("conv_id", "_cell").distinct().join(ends, ["conv_id", "_cell"], "left")
    earlier = Window.partitionBy("conv_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("conv_id").alias("_conv"), F.col("_cell").alias("_of"),
        F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("conv_id", "_cell").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    here = staged.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return here.join(cells, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_cell").eqNullSafe(F.col("_of"))).select(
        *df.columns, F.coalesce("_inside", "_before").alias(name))


def chat_normalise(text: Column) -> Column:
    """Lower case without accents, repeats of three or more collapsed, symbols to spaces."""
    plain = unaccent(F.lower(text))
    collapsed = F.regexp_replace(plain, r"(.)\1{2,}", "$1")
    kept = F.regexp_replace(collapsed, r"[^a-z0-9$%'\s-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def words_of(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: F.length(w) > 0)


def project_vocabulary(
    spark: SparkSession, names: DataFrame, terms: Sequence[str] = v.DOMAIN_TERMS,
    generic: Sequence[str] = v.GENERIC_WORDS, name_column: str = "name",
) -> DataFrame:
    """(kind, term): phrases, word prefixes and exact words of a term list and of real names.

    ``names`` holds readable category, state, aspect and topic names, one per row.
    """
    listed = spark.createDataFrame([(t,) for t in terms], "name string").select(
        chat_normalise(F.col("name")).alias("term"), F.lit(True).alias("listed"))
    named = names.select(chat_normalise(F.regexp_replace(name_column, "[_/]", " ")).alias("term"),
                         F.lit(False).alias("listed")).distinct()
    every = listed.unionByName(named).where(F.length("term") > 0)
    phrase = F.col("term").rlike(PHRASE_MARK)
    size = F.length("term")
    kinds = F.array_compact(F.array(
        F.when(phrase, F.struct(F.lit("phrase").alias("kind"), F.col("term"))),
        F.when(~phrase & F.col("listed") & (size >= 4), F.struct(F.lit("prefix").alias("kind"), F.col("term"))),
        F.when(~phrase & F.col("listed") & (size < 4), F.struct(F.lit("exact").alias("kind"), F.col("term"))),
        F.when(~phrase & ~F.col("listed") & (size >= 5), F.struct(F.lit("exact").alias("kind"), F.col("term"))),
    ))
    direct = every.select(F.explode(kinds).alias("k")).select("k.kind", "k.term")
    words = named.select(F.explode(words_of(F.col("term"))).alias("term")).where(
        (F.length("term") >= 5) & ~F.col("term").isin(*generic)).select(F.lit("exact").alias("kind"), "term")
    return direct.unionByName(words).distinct()


def mentions(turns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keys of the turns that use the vocabulary.

    Every turn offers its words, and the beginnings and word runs of the lengths that the
    vocabulary's prefixes and phrases have (a few numbers on the driver); one equi-join against the
    vocabulary decides.
    """
    measure = F.when(F.col("kind") == "phrase", F.size(words_of(F.col("term")))).otherwise(F.length("term"))
    lengths: dict[str, list[int]] = {"phrase": [], "prefix": []}
    for row in vocabulary.where("kind <> 'exact'").select("kind", measure.alias("n")).distinct().collect():
        lengths[row.kind].append(row.n)

    def runs_of(words: Column, size: int) -> Column:
        """All runs of ``size`` neighbouring words."""
        starts = F.sequence(F.lit(1), F.size(words) - size + 1)
        return F.when(F.size(words) >= size, F.transform(
            starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    def runs(words: Column) -> Column:
        return F.flatten(F.array(F.array().cast("array<string>"), *[runs_of(words, n) for n in sorted(lengths["phrase"])]))

    def starts_of(words: Column, size: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.left(w, F.lit(size)))

    def beginnings(words: Column) -> Column:
        return F.flatten(F.array(F.array().cast("array<string>"), *[starts_of(words, n) for n in sorted(lengths["prefix"])]))

    def offer(kind: str, items: Column) -> Column:
        return F.transform(F.array_distinct(items), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    def offers(words: Column) -> Column:
        return F.concat(offer("exact", words), offer("prefix", beginnings(words)), offer("phrase", runs(words)))

    offered = turns.select(*TURN, F.explode(once(words_of(F.col("norm")), offers)).alias("o")).select(
        *TURN, "o.kind", "o.term")
    return offered.join(vocabulary, ["kind", "term"], "left_semi").select(*TURN).distinct()


def _all_in(words: Column, known: Iterable[str], at_most: int) -> Column:
    return (F.size(words) <= at_most) & (F.size(F.array_except(words, literal_array(known))) == 0)


def _cue(words: Sequence[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def classify_turns(
    turns: DataFrame, vocabulary: DataFrame,
    greetings: Sequence[str] = v.GREETING_WORDS, thanks: Sequence[str] = v.THANKS_WORDS,
    farewells: Sequence[str] = v.FAREWELL_WORDS, farewell_cues: Sequence[str] = v.FAREWELL_CUES,
    capabilities: Sequence[str] = v.CAPABILITY_PATTERNS, follow_ups: Sequence[str] = v.FOLLOW_UP_CUES,
    small_talk_words: int = v.SMALL_TALK_MAX_WORDS, follow_up_words: int = v.FOLLOW_UP_MAX_WORDS,
    anywhere: Sequence[str] = tuple(t for t in v.DOMAIN_TERMS if "$" in t),
) -> DataFrame:
    """Intent of every turn. Terms of ``anywhere`` count inside words, too.

    A short follow-up takes over the last real intent (project or off topic) of its
    conversation. Since the copy equals what it copies, the carry is the last known
    intent before the row and needs no loop.
    """
    # Two branches read the folded turns, so they are folded once and written.
    normed = written(turns.withColumn("norm", chat_normalise(F.col("text"))), "turns")
    users = normed.where("role = 'user'").select(*TURN, "norm")
    hit = mentions(users, vocabulary).select(*[F.col(k).alias(f"_hit_{k}") for k in TURN], F.lit(True).alias("mentions"))
    same = [F.col(k).eqNullSafe(F.col(f"_hit_{k}")) for k in TURN]
    words = F.col("_words")
    norm = F.col("norm")
    capable = F.lit(False)
    for pattern in capabilities:
        capable = capable | norm.rlike(pattern)
    used = F.coalesce("mentions", F.lit(False))
    for term in anywhere:
        used = used | F.contains(norm, F.lit(term))
    own = (
        F.when(F.size(words) == 0, "greeting")
        .when(_all_in(words, greetings, small_talk_words), "greeting")
        .when(_all_in(words, farewells, small_talk_words) & norm.rlike(_cue(farewell_cues)), "farewell")
        .when(_all_in(words, thanks, small_talk_words), "thanks")
        .when(capable, "capabilities")
        .when(used, "project")
        .when((F.size(words) <= follow_up_words) & norm.rlike(_cue(follow_ups)), "follow_up")
        .otherwise("off_topic"))
    user_intent = F.when(F.col("role") == "user", own)
    staged = normed.join(hit, same, "left").drop(*[f"_hit_{k}" for k in TURN]).withColumn("_words", words_of(norm)).withColumn("_own", user_intent)
    real = F.when(F.col("_own").isin("project", "off_topic"), F.col("_own"))
    intent = (
        F.when(F.col("role") != "user", "project")
        .when(F.col("_own") == "follow_up", F.coalesce("_known", F.lit("off_topic")))
        .otherwise(F.col("_own")))
    return carried(staged, real, "_known").select(*TURN, "role", "text", intent.alias("intent"))


def model_history(classified: DataFrame) -> DataFrame:
    """Project questions and the answers that follow them."""
    last_user = F.when(F.col("role") == "user", F.col("intent"))
    return carried(classified, last_user, "_last").where(F.col("_last") == "project").drop("_last")


def injection_matches(text: Column, patterns: Mapping[str, str] = v.INJECTION_PATTERNS) -> Column:
    """Names of the prompt-injection patterns in the text."""
    return matched_names(text, patterns, flags="(?i)")
