"""Text expressions built from native functions: folding, tokens, lexicon, patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.vocabulary import NEGATIVE_WORDS, NO_ASPECT, POSITIVE_WORDS

WORD = r"[\p{L}\p{N}_]+"          # a run of letters, digits and underscores in any script
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


@lru_cache(maxsize=1)
def _plain_forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has one ASCII character, those characters, and
    the few that stand for several (ligatures, fractions, signs)."""
    marked, plain, several = [], [], {}
    for code in (*range(0x00A0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        letter = chr(code)
        ascii_ = "".join(c for c in unicodedata.normalize("NFKD", letter) if c.isascii())
        if len(ascii_) == 1:
            marked.append(letter)
            plain.append(ascii_)
        elif ascii_:
            several[letter] = ascii_
    return "".join(marked), "".join(plain), several


def unaccent(text: Column) -> Column:
    """Compatibility forms and accented letters as their ASCII characters; combining marks go."""
    marked, plain, several = _plain_forms()
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    # Texts with such characters are rare: a translation that drops them finds those texts, and only they are taken apart.
    whole = F.when(F.translate(text, "".join(several), "") != text, spelled).otherwise(text)
    return F.when(is_ascii(text), text).otherwise(F.regexp_replace(F.translate(whole, marked, plain), r"\p{Mn}", ""))


def is_ascii(text: Column) -> Column:
    """Whether a text has as many bytes as characters."""
    return F.octet_length(text) == F.char_length(text)


def fold(text: Column) -> Column:
    """Lower case without accents, ASCII only."""
    lowered = F.lower(text)
    return F.when(is_ascii(lowered), lowered).otherwise(F.regexp_replace(unaccent(lowered), r"[^\x00-\x7F]", ""))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_list(text: Column) -> Column:
    """The words of a text, as ``tokens`` finds them, cut in one pass."""
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def literal_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def plain_words(words: Iterable[str]) -> list[str]:
    """Distinct unaccented spellings of a word list."""
    spelled = {
        unicodedata.normalize("NFD", w).encode("ascii", "ignore").decode() for w in words}
    return sorted(spelled)


def lexicon_counts(
    text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> tuple[Column, Column]:
    """Hits of both lists: distinct unaccented words plus distinct words as written.

    A word that is spelled without accents therefore counts in both rounds.
    """
    as_written = (sorted(set(positive)), sorted(set(negative)))
    folded = (plain_words(positive), plain_words(negative))

    def listed(words: Column, lists: tuple[list[str], list[str]]) -> Column:
        """The few words of a text that are on either list, each once."""
        return F.array_intersect(words, literal_array([*lists[0], *lists[1]]))

    # An ASCII text is its own unaccented form, so its words serve for both rounds.
    found = once(F.lower(text), lambda lowered: once(word_list(lowered), lambda words: F.struct(
        listed(words, as_written).alias("written"),
        listed(F.when(is_ascii(lowered), words).otherwise(word_list(unaccent(lowered))), folded).alias("folded"))))

    def hits(side: int) -> Column:
        return (F.size(F.array_intersect(found["folded"], literal_array(folded[side])))
                + F.size(F.array_intersect(found["written"], literal_array(as_written[side]))))

    return hits(0), hits(1)


def lexicon_sentiment(positive_hits: Column, negative_hits: Column) -> tuple[Column, Column]:
    """(label, score) from the hit counts."""
    total = positive_hits + negative_hits
    share = F.try_divide(positive_hits.cast("double"), total)
    label = F.when(share > 0.6, "Positive").when(share < 0.4, "Negative").otherwise("Neutral")
    score = F.when(share > 0.6, share).when(share < 0.4, F.lit(1.0) - share).otherwise(F.lit(0.5))
    return label, score


def terms(text: Column, stop_words: Sequence[str], min_length: int = 2, bigrams: bool = True) -> Column:
    """Lower-case words of some length without stop words, then the pairs of neighbours that remain."""
    def kept_word(w: Column) -> Column:
        long_enough = F.length(w) >= min_length
        return long_enough & ~w.isin(*stop_words) if stop_words else long_enough

    words = F.filter(F.split(F.lower(text), BETWEEN_WORDS), kept_word)
    return with_pairs(words) if bigrams else words


def with_pairs(words: Column) -> Column:
    """The words, then the pairs of neighbours."""
    def paired(kept: Column) -> Column:
        pairs = F.greatest(F.size(kept) - 1, F.lit(0))
        return F.concat(kept, F.zip_with(
            F.slice(kept, F.lit(1), pairs), F.slice(kept, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)))

    return once(words, paired)


def whole_word_pattern(words: Sequence[str]) -> str:
    """A pattern for any of the words standing alone, in any script."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:$|[^\p{L}\p{N}_])"


def matched_names(text: Column, patterns: Mapping[str, str], flags: str = "(?U)") -> Column:
    """Names of the patterns found in the text, in the order given."""
    return F.array_compact(F.array(*[F.when(text.rlike(flags + p), F.lit(n)) for n, p in patterns.items()]))


def tag_aspects(
    text: Column, patterns: Mapping[str, str], fallback: str = NO_ASPECT, unaccented: bool = False
) -> Column:
    """Aspects whose pattern occurs in the lower-case text, or the fallback."""
    lowered = F.lower(text)
    found = matched_names(unaccent(lowered) if unaccented else lowered, patterns)
    return once(found, lambda names: F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(fallback))))


def any_pattern(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)
