"""Removing long passages that occur in an earlier document, found by recompression.

Words get 64-bit names. Rounds then rename the sequence: every third round names runs of equal
symbols, each round puts symbols on a left or right side by a hash of their name and names every
(left, right) pair. A name is a hash of what it stands for, so it is the same in every document and
task without a dictionary, and equal passages get equal symbols inside. Only the symbols at a
passage's edges depend on what surrounds it: with each symbol travels the range of words that
decided it (its context).

A symbol found in one text only shows that no window of words that holds its whole context occurs
anywhere else. All windows without such a symbol are candidates; their word sequences are compared
by hash, and a window goes when it also starts in a document with a smaller doc_id. The result is
exact whatever the number of rounds, which only decides how few candidates are left.

Equal texts form one class: only the class's smallest doc_id takes part, the others lose every
window. Symbols and windows that repeat within a batch of documents leave the map task once, so a
passage that a third of all documents share is not gathered in one task.

Defined cases. Null, empty or blank text: no words, nothing removed, hash of the empty string. Fewer
words than a window: nothing removed. Null doc_id: neither removes nor loses words. Rows with one
doc_id do not remove from each other. Empty table: empty result. Other columns: ignored by
``repeats``, kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import map_batches, mix, named_slices, rolling, signed, text_bytes, written

WINDOW = 50
SIZES = 1 << 16              # a context's size, or a run of windows, within a packed place
ROUNDS = 7
RUNS_EVERY = 3
PAIR_A, PAIR_B, RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def symbols(names: np.ndarray, begins: np.ndarray, rounds: int = ROUNDS, runs_every: int = RUNS_EVERY):
    """Symbols of several documents after all rounds: name, context start, context end, document.

    ``names`` holds the documents' words one after the other, ``begins`` where each starts. A
    context that depends on a document's edge reaches over it.
    """
    size = len(names)
    name = names.copy()
    doc = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, size)))
    low, high = np.arange(size), np.arange(1, size + 1)
    first_word = begins - 1                     # one word before the document
    last_word = np.append(begins[1:], size) + 1

    for k in range(rounds):
        if len(name) == 0:
            break
        if k % runs_every == 0:
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(name)))
            lo, hi = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
            name, doc = name[start], doc[start]
            run = length > 1
            name[run] = mix(name[run] * RUN + length[run].astype(np.uint64))
            same = doc[1:] == doc[:-1]
            low, high = lo.copy(), hi.copy()
            # A run ends where a different symbol stands on both sides.
            low[1:] = np.where(same, np.minimum(lo[1:], lo[:-1]), first_word[doc[1:]])
            high[1:] = np.where(same, np.maximum(hi[1:], hi[:-1]), hi[1:])
            low[:-1] = np.where(same, np.minimum(low[:-1], lo[1:]), low[:-1])
            high[:-1] = np.where(same, np.maximum(high[:-1], hi[1:]), last_word[doc[:-1]])
            low[0] = first_word[doc[0]]
            high[-1] = last_word[doc[-1]]
        turn = np.uint64((k + 1) * int(PAIR_A) % 2**64)
        left_side = (mix(name + turn) & np.uint64(1)).astype(bool)
        same = doc[1:] == doc[:-1]
        pair = left_side[:-1] & ~left_side[1:] & same
        starts_pair, ends_pair = np.append(pair, False), np.insert(pair, 0, False)
        lo, hi = low.copy(), high.copy()
        # A pair needs nothing else; a single left symbol depends on what follows, a right one on what precedes.
        lo[:-1] = np.where(pair, np.minimum(low[:-1], low[1:]), lo[:-1])
        hi[:-1] = np.where(pair, np.maximum(high[:-1], high[1:]), hi[:-1])
        alone = left_side & ~starts_pair
        nexts = np.append(same, False)
        at = np.flatnonzero(alone & nexts)
        lo[at], hi[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        at = np.flatnonzero(alone & ~nexts)
        hi[at] = last_word[doc[at]]
        alone = ~left_side & ~ends_pair
        befores = np.insert(same, 0, False)
        at = np.flatnonzero(alone & befores)
        lo[at], hi[at] = np.minimum(low[at], low[at - 1]), np.maximum(high[at], high[at - 1])
        at = np.flatnonzero(alone & ~befores)
        lo[at] = first_word[doc[at]]
        joined = np.flatnonzero(pair)
        name[joined] = mix(mix(name[joined] * PAIR_A) + name[joined + 1] * PAIR_B)
        keep = ~ends_pair
        name, low, high, doc = name[keep], lo[keep], hi[keep], doc[keep]
    return name, low, high, doc


def text_symbols(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """symbol, class, place: the symbols whose context a window can hold, once per text and task.

    ``place`` is the context's start and size in one number, -1 for a symbol of several texts.
    """

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in source:
            fresh = []
            for k, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    fresh.append(k)
                    if len(seen) < 500_000:
                        seen.add(c)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh, pa.int64()))
            classes = batch.column(0).to_numpy()
            for first, last, words, edges in named_slices(batch.column(1)):
                begins, ends = edges[:-1], edges[1:]
                name, low, high, doc = symbols(words, begins, rounds)
                use = (high - low <= window) & (low >= begins[doc]) & (high <= ends[doc])
                name, low, high, doc = name[use], low[use], high[use], doc[use]
                own = classes[first:last][doc]
                place = (low - begins[doc]) * SIZES + (high - low)
                # Of a symbol that several texts of the slice share, one row tells the others so.
                order = np.lexsort((own, name))
                name_, own_ = name[order], own[order]
                start = np.flatnonzero(np.append(True, name_[1:] != name_[:-1])) if len(name_) else np.empty(0, np.int64)
                end = np.append(start[1:], len(name_)) - 1
                shared = own_[start] != own_[end] if len(start) else np.empty(0, bool)
                single = np.sort(order[np.repeat(~shared, end - start + 1)])
                several = start[shared]
                yield pa.RecordBatch.from_arrays(
                    [signed(np.append(name[single], name_[several])), pa.array(np.append(own[single], own_[several])),
                     pa.array(np.append(place[single], np.full(len(several), -1)))], ["symbol", "class", "place"])

    return map_batches(docs.select("class", "text"), step, "symbol long, class long, place long")


def candidate_windows(reps: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows that no text's own symbol rules out: hash, class, doc_id, place.

    ``place`` is a start and a run of windows in one number; a run of 0 is one window to compare,
    others are runs of windows that an earlier document of the same batch already has.
    """

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hashes, classes, ids, starts = [], [], [], []
            named = ((names, begins[k], begins[k + 1]) for first, last, names, begins in named_slices(batch.column(2))
                     for k in range(last - first))
            for c, doc_id, own, (names, b, e) in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), named):
                n = e - b - window + 1
                if n <= 0:
                    continue
                open_ = np.ones(n, bool)
                if own.is_valid and len(own.values):
                    low, size = np.divmod(own.values.to_numpy(zero_copy_only=False), SIZES)
                    ruled = np.zeros(n + 1, np.int64)
                    np.add.at(ruled, np.clip(low + size - window, 0, n), 1)
                    np.add.at(ruled, np.minimum(low + 1, n), -1)
                    open_ = np.cumsum(ruled)[:n] <= 0
                at = np.flatnonzero(open_)
                if len(at):
                    hashes.append(rolling(names[b:e], window)[at])
                    starts.append(at)
                    classes.append(np.full(len(at), c, np.int64))
                    ids.append(np.full(len(at), doc_id, np.int64))
            if not hashes:
                continue
            h, c, d, s = map(np.concatenate, (hashes, classes, ids, starts))
            order = np.lexsort((s, d, h))
            h, c, d, s = h[order], c[order], d[order], s[order]
            new = np.append(True, h[1:] != h[:-1])
            first_doc = d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            late = d > first_doc
            keep = np.flatnonzero(~late)
            keep = keep[np.lexsort((s[keep], c[keep]))]     # neighbours stay together and compress well
            parts = [(h[keep], c[keep], d[keep], s[keep] * SIZES)]
            if late.any():
                c2, d2, s2 = c[late], d[late], s[late]
                order = np.lexsort((s2, c2))
                c2, d2, s2 = c2[order], d2[order], s2[order]
                at = np.flatnonzero(np.append(True, (c2[1:] != c2[:-1]) | (s2[1:] != s2[:-1] + 1)))
                run = np.diff(np.append(at, len(s2)))
                more = -(-run // (SIZES - 1))               # long runs in parts
                at, left = np.repeat(at, more), np.repeat(run, more)
                part = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
                begin = s2[at] + part * (SIZES - 1)
                run = np.minimum(left - part * (SIZES - 1), SIZES - 1)
                parts.append((mix(c2[at].view(np.uint64) + begin.astype(np.uint64)), c2[at], d2[at], begin * SIZES + run))
            h, c, d, place = map(np.concatenate, zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [signed(h), pa.array(c), pa.array(d), pa.array(place)], ["hash", "class", "doc_id", "place"])

    return map_batches(reps, step, "hash long, class long, doc_id long, place long")


def _kept(window: int, full: bool):
    """Words that stay, per document: their number and hash, or the text itself."""

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            doc_id, texts, copies = (batch.column(k).to_pylist() for k in range(3))
            counts, removed, out = [], [], []
            for text, copy, runs in zip(texts, copies, batch.column(3)):
                words = text.split()
                n = len(words)
                stay = words
                if copy and n >= window:
                    stay = []
                elif runs.is_valid and len(runs.values):
                    start, run = np.divmod(runs.values.to_numpy(zero_copy_only=False), SIZES)
                    run = np.maximum(run, 1)
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + run - 1 + window, -1)
                    gone = np.cumsum(cover)[:n] > 0
                    stay = [w for w, g in zip(words, gone.tolist()) if not g]
                counts.append(n)
                removed.append(n - len(stay))
                kept = b" ".join(stay)
                out.append((kept if n > len(stay) else text).decode() if full else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(out, pa.string()), *(batch.column(k) for k in range(4, batch.num_columns))],
                ["doc_id", "n_words", "n_removed", "kept", *batch.schema.names[4:]])

    return step


def _joined(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """doc_id, text (bytes), copy, runs and the other columns of every row."""
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*others).alias("_rest")] if others else []
    for seed in range(4):
        name, check = F.xxhash64(F.lit(seed), "text"), F.xxhash64("text", F.lit(seed))
        texts = docs.select("doc_id", text_bytes().alias("text"), *rest).withColumn("class", name)
        marks = written(texts.where("doc_id is not null").select("doc_id", "class", check.alias("check")), "classes")
        classes = marks.groupBy("class").agg(
            F.min("doc_id").alias("first"), (F.min("check") != F.max("check")).alias("clash"))
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("text names clash")
    one = Window.partitionBy("symbol")
    own = (text_symbols(texts.where("doc_id is not null"), window, rounds)
           .select("class", "place", F.min("class").over(one).alias("lo"), F.max("class").over(one).alias("hi"),
                   F.min("place").over(one).alias("least")).where("lo = hi and least >= 0")
           .groupBy("class").agg(F.collect_list("place").alias("own")))
    reps = classes.select("class", "first").join(own, "class", "left").select(
        F.col("class").alias("c"), F.col("first").alias("d"), "own")
    base = texts.where("doc_id is not null").select("doc_id", "class", "text")
    # In a fixed order, so that a repeated task settles the same windows inside its batches.
    windows = candidate_windows(
        base.join(reps, (base["doc_id"] == F.col("d")) & (base["class"] == F.col("c")))
        .select("class", "doc_id", "text", "own").sortWithinPartitions("doc_id", "class"), window)
    same = Window.partitionBy("hash")
    gone = windows.select("class", "place", "doc_id", F.min("doc_id").over(same).alias("least")).where(
        F.expr(f"place % {SIZES} > 0 or least < doc_id"))
    runs = gone.groupBy("class").agg(F.collect_list("place").alias("runs"))
    info = (marks.select("doc_id", "class").distinct().join(classes.select("class", "first"), "class")
            .join(runs, "class", "left").select(
                F.col("doc_id").alias("d"), F.col("class").alias("c"), (F.col("doc_id") > F.col("first")).alias("copy"),
                F.when(F.col("doc_id") == F.col("first"), F.col("runs")).alias("runs")))
    carried = ["_rest"] * bool(rest)
    left = base if not rest else texts.where("doc_id is not null").select("doc_id", "class", "text", *carried)
    known = left.join(info, (left["doc_id"] == F.col("d")) & (left["class"] == F.col("c")), "left").select(
        "doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "runs", *carried)
    return known.unionByName(texts.where("doc_id is null").select(
        "doc_id", "text", *carried, F.lit(False).alias("copy"), F.lit(None).cast(known.schema["runs"].dataType).alias("runs")))


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    joined = _joined(docs.select("doc_id", "text"), window, rounds)
    return map_batches(joined, _kept(window, False), "doc_id long, n_words long, n_removed long, kept string"
                       ).withColumnRenamed("kept", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The rows with the repeated words taken out of ``text``; untouched texts stay as they are."""
    joined = _joined(docs, window, rounds)
    rest = [f for f in joined.schema if f.name == "_rest"]
    schema = "doc_id long, n_words long, n_removed long, kept string" + "".join(
        f", _rest {f.dataType.simpleString()}" for f in rest)
    out = map_batches(joined, _kept(window, True), schema)
    return out.select(*[F.col("doc_id") if c == "doc_id" else F.col("kept").alias("text") if c == "text"
                        else F.col("_rest")[c].alias(c) for c in docs.columns])
