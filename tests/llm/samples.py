"""Small tables with the awkward cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, class int, h string, part string"


def prose(seed: int, words: int) -> str:
    import random

    rng = random.Random(seed)
    parts = ["lorem", "sunt", "velit", "quiver", "amber", "stone", "river", "the", "of", "and", "march", "delta"]
    return " ".join("".join(rng.choices(parts, k=2)) if rng.random() < 0.6 else rng.choice(parts) for _ in range(words))


def rows(texts, ids=None, sources=None):
    ids = ids if ids is not None else range(len(texts))
    sources = sources if sources is not None else ["a"] * len(texts)
    return [(i, t, None, s, None if t is None else len(t), "x", 1, "y", "z") for i, t, s in zip(ids, texts, sources)]


def awkward():
    """Null, empty and blank texts, copies, a near copy, a very long text, repeated and null ids, null source."""
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:90] + ["changed"] + words[91:])
    long = prose(2, 30_000)
    texts = [base, None, "", " \t\n\u000b ", base, near, long, "one two", "One TWO", prose(3, 120), "x" * 50_000, base, None]
    ids = [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 10, None]
    sources = ["a", "a", None, "b", None, "b", "a", "c", "c", "b", "c", "a", None]
    return rows(texts, ids, sources)
