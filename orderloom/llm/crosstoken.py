"""Alignment of two tokenizers' ids over the same bytes, anchored at tokens that begin with a blank.

A byte-level BPE (A) and a sentence-piece BPE (B) both begin a token at a blank between a character that
is no blank and one that is no white space: A's word pattern begins a word there, and no piece of B
holds a mark behind another character. Such anchors cut a text into windows whose ids do not depend
on each other. A worker tokenises and aligns the windows that it has not seen yet, many in one run of
either tokenizer, checks every cut on the byte offsets of both sides, and remembers them by their
text. Tokenizers for which this does not hold (another word pattern, normaliser or kind of pieces)
get each text as one window, and so does a text with a window whose tokens do not spell it.

Inside a window, offsets where tokens of both sides end close a group; the last A and B token of a
group end together, which links them. How often a pair of ids is linked is counted over all
documents: documents are dealt to blocks of bounded size when they are written, a block keeps each
of its pairs once, the pairs' counts come back to the blocks, and every document adds up its own.
So what is shuffled is the distinct pairs of blocks, and a pair that all documents hold is one row a
block.

Defined cases. Null or empty text, and texts whose tokens do not spell a blank and the text on both
sides (such as texts with U+2581): no tokens, zeros and an empty digest. Null doc_id: kept. Repeated
rows or ids: each row counts. Texts of any length: whole. Empty table: empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import map_batches, written

BLOCK_LINKS = 1_000_000      # links after which a block of documents is closed
BLOCK_DOCS = 4_000
HELD_WINDOWS = 300_000       # window alignments that a worker keeps; as many older ones stay until these are full
LONGEST = 100                # characters of a window that is kept
RUN_CHARS = 16_000           # characters of new windows, or one window, that are tokenised together
SLICE_CHARS = 1 << 20        # characters of documents, or one document, that are cut together
# The word pattern of byte-level vocabularies (a fixed value).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"              # how sentence pieces write a blank
ANCHOR = re.compile(rf"(?<=[^ {MARK}]) (?=\S)")
BARE_BLANK = re.compile(rf"{MARK}| \s|^ | $").search      # texts in which a blank may be no anchor
BARE_ENDS = {"", " ", MARK}                                # ends of windows behind which no anchor can stand


class Side:
    """A tokenizer as id lists, with the bytes of every id.

    ``lossless``: its tokens spell every text by construction, so their lengths are check enough.
    ``anchored``: what stands before and behind an anchor is tokenised independently.
    """

    def __init__(self, pieces: list[bytes], encode, lossless: bool = False, anchored: bool = False):
        self.pieces, self.encode, self.lossless, self.anchored = pieces, encode, lossless, anchored
        self.widths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.begins = np.cumsum(self.widths) - self.widths

    def spell(self, ids: np.ndarray, ends: np.ndarray, text: bytes) -> bool:
        """Whether the tokens, which end at ``ends``, spell ``text``."""
        if len(ids) == 0 or ends[-1] != len(text):
            return False
        if self.lossless:
            return True
        place = np.repeat(self.begins[ids] - ends + self.widths[ids], self.widths[ids]) + np.arange(len(text))
        return np.array_equal(self.bytes[place], np.frombuffer(text, np.uint8))


def byte_level_side(path: str) -> Side:
    """A byte-level BPE file; special tokens count as plain text.

    When the ids follow the order of the merges, as training leaves them, merging by the smallest
    joined id is the same as merging by rank, and the faster encoder of ranks serves.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()

    def exact(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    model, before = spec["model"], spec["pre_tokenizer"] or {}
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    letters = {chr(b) if b in set(prints) else chr(next(spare)): b for b in range(256)}
    pieces = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        pieces[i] = bytes(map(letters.__getitem__, token))
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = (
        [model["vocab"][a + b] for a, b in merged] == list(range(256, 256 + len(merged)))
        and all(len(p) == 1 for p in pieces[:256]) and len(set(pieces)) == len(pieces)
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and spec["normalizer"] is None)
    if in_order:
        import tiktoken

        ranks = tiktoken.Encoding(
            "ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
        long_gap = re.compile(r"\s{2000}").search      # the encoder of ranks recurses once per blank
        # The pattern takes every character and merges only join bytes: nothing of a text is lost.
        return Side(
            pieces, lambda text: exact(text) if long_gap(text) else ranks.encode_to_numpy(text, disallowed_special=()), True, True)
    return Side(pieces, exact)


def sentence_piece_side(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
        else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.get_piece_size())]
    return Side(pieces, model.encode_as_numpy, anchored=_merges_stop_at_marks(model))


def _merges_stop_at_marks(model) -> bool:
    """Whether a model merges pairs of the text as it is, and never over a mark behind another character.

    Without the protobuf library the model cannot be read for it: then texts stay whole.
    """
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    rules, trained = spec.normalizer_spec, spec.trainer_spec
    return (
        trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
        and not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces))


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    return byte_level_side(a_path), sentence_piece_side(b_path)


class Aligner:
    """Cuts texts at anchors into windows and aligns each distinct window once."""

    def __init__(self, a: Side, b: Side, held: int = HELD_WINDOWS):
        self.a, self.b, self.held, self.anchored = a, b, held, a.anchored and b.anchored
        # An id as it stands in the groups' text, with what follows it: more of its side, the other side,
        # the next group, the next window.
        self.names = [f"{i}{c}" for side, ends in ((a, ",|"), (b, ",;\n")) for i in range(len(side.pieces)) for c in ends]
        self.known: dict[str, tuple[str, bytes, int]] = {}     # groups, links, number of ids of A << 32 and of B
        self.older: dict[str, tuple[str, bytes, int]] = {}

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or none when they do not spell a blank and the text."""
        if not text:
            return None
        first, second = self.a.encode(" " + text), self.b.encode(text)
        first, second = np.asarray(first, "<i4"), np.asarray(second, "<i4")
        spelled = (" " + text).encode()
        for side, ids in ((self.a, first), (self.b, second)):
            if not side.spell(ids, np.cumsum(side.widths[ids]), spelled):
                return None
        return first, second

    def windows(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[str, np.ndarray]:
        """Groups of a whole text, and its links in order."""
        (groups,), links, *_ = self._groups(a_ids, b_ids, self.a.widths[a_ids].sum(keepdims=True))
        return groups, links

    def _groups(self, a_ids: np.ndarray, b_ids: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
        """The groups' text of each window, all links, and how many links, ids of A and ids of B each window has.

        ``ends``: the byte offsets where windows end.
        """
        a_ends, b_ends = np.cumsum(self.a.widths[a_ids]), np.cumsum(self.b.widths[b_ids])
        at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        if not (np.array_equal(a_ends[at_a], ends) and np.array_equal(b_ends[at_b], ends)):
            raise AssertionError("an anchor is not a token end on both sides")
        closing = np.zeros((2, int(ends[-1]) + 1), bool)
        closing[0, a_ends] = closing[1, b_ends] = True
        closing = closing[0] & closing[1]
        closes_a, closes_b = closing[a_ends], closing[b_ends]
        last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        # In the text each group's ids of A stand before its ids of B.
        shape = np.empty(len(a_ids) + len(b_ids), np.int64)
        place = np.arange(len(a_ids)) + np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))
        shape[place] = 2 * a_ids.astype(np.int64) + closes_a
        follows = closes_b.astype(np.int64)
        follows[at_b] = 2
        place = np.arange(len(b_ids)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        shape[place] = 2 * len(self.a.pieces) + 3 * b_ids.astype(np.int64) + follows
        texts = "".join(map(self.names.__getitem__, shape.tolist())).split("\n")[:-1]
        links = a_ids[last_a].astype(np.int64) << 32 | b_ids[last_b]
        return texts, links, [np.diff(x, prepend=-1) for x in (np.searchsorted(last_a, at_a), at_a, at_b)]

    def cut(self, text: str) -> list[str]:
        """The windows of a text, without the blanks before them."""
        if not self.anchored:
            return [text]
        return text.split(" ") if BARE_BLANK(text) is None else ANCHOR.split(text)

    def _learn(self, new: list[str]) -> Iterator[tuple[str, tuple[str, bytes, int] | None]]:
        """Each window with its alignment, or none when its tokens do not spell it."""
        ids = self.tokens(joined := " ".join(new))
        if ids is None and len(new) > 1:
            half = len(new) // 2
            yield from self._learn(new[:half])
            yield from self._learn(new[half:])
            return
        if ids is None:
            yield new[0], None
            return
        widths = map(len, new) if joined.isascii() else (len(w.encode()) for w in new)
        texts, links, (n_links, n_a, n_b) = self._groups(*ids, np.cumsum(np.fromiter(widths, np.int64, len(new)) + 1))
        raw, bounds = links.tobytes(), np.append(0, 8 * np.cumsum(n_links)).tolist()
        sizes = (n_a << 32 | n_b).tolist()
        yield from zip(new, zip(texts, [raw[p:q] for p, q in zip(bounds, bounds[1:])], sizes))

    def _found(self, windows: Iterable[str]) -> dict[str, tuple[str, bytes, int] | None]:
        """The alignments of distinct windows: remembered, or worked out now."""
        found, new, run, size = {}, [], [], 0
        known, older = self.known.get, self.older.get
        for window in windows:
            own = known(window)
            if own is None:
                own = older(window)
                if own is None:
                    new.append(window)
                    continue
                self._keep(window, own)
            found[window] = own
        for window in new:
            if not self.anchored or window[-1:] in BARE_ENDS or window[0].isspace():   # no anchor would part it from another
                found.update(self._learn([window]))
                continue
            run.append(window)
            size += len(window) + 1
            if size >= RUN_CHARS:
                found.update(self._learn(run))
                run, size = [], 0
        if run:
            found.update(self._learn(run))
        for window in new:
            if found[window] is not None and len(window) <= LONGEST:
                self._keep(window, found[window])
        return found

    def _keep(self, window: str, own: tuple[str, bytes, int]) -> None:
        if len(self.known) >= self.held:
            self.older, self.known = self.known, {}
        self.known[window] = own

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray] | None]:
        """Of each text the number of ids of A and of B, its groups, and its links in order."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < SLICE_CHARS):
                size += len(texts[last] or "")
                last += 1
            cut = [self.cut(t) if t else [] for t in texts[first:last]]
            found = self._found(set().union(*cut))
            for text, windows in zip(texts[first:last], cut):
                own = list(map(found.__getitem__, windows))
                if own and None not in own:
                    sizes = [f[2] for f in own]
                    links = np.frombuffer(b"".join([f[1] for f in own]), np.int64)
                    both = sum(sizes)
                    yield both >> 32, both & 0xFFFFFFFF, ";".join([f[0] for f in own]), links
                elif (ids := self.tokens(text)) is not None:
                    yield len(ids[0]), len(ids[1]), *self.windows(*ids)
                else:
                    yield None
            first = last


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process, so that the next task finds the windows of the one before."""
    return Aligner(*sides(a_path, b_path))


DOC_ROWS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups", pa.string()), ("groups_sha256", pa.string()), ("held", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
DOC_COLUMNS = ("block long, doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, "
               "held array<int>, times array<int>, pairs array<long>, counts array<long>")


def alignments(
    docs: DataFrame, a_path: str, b_path: str, texts: bool = False, block_links: int = BLOCK_LINKS, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row per document with its groups, and one per block with the block's pairs.

    A document's ``held`` are places in the ``pairs`` of its block (sorted), ``times`` how often it
    links each. A block's row has no ``n_a``. ``texts`` keeps the groups themselves.
    """
    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        task = TaskContext.get().partitionId() << 32
        block, size = 0, 0
        rows: list[tuple] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []     # a document's pairs, and how often it links each

        def closed() -> pa.RecordBatch:
            nonlocal block, size
            pairs, place = np.unique(np.concatenate([x for x, _ in links]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n in links]), len(pairs)).astype(np.int64)
            number, out = task + block, []
            for row, held, (_, times) in zip(rows, np.split(place, np.cumsum([len(x) for x, _ in links])[:-1]), links):
                out.append((number, *row, held.astype(np.int32), times.astype(np.int32), None, None))
            out.append((number, *[None] * 8, pairs, counts))
            rows.clear()
            links.clear()
            block, size = block + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), DOC_ROWS)], schema=DOC_ROWS)

        for batch in source:
            for doc_id, found in zip(batch.column(0).to_pylist(), aligner.aligned(batch.column(1).to_pylist())):
                if found is None:
                    own = np.empty(0, np.int64)
                    rows.append((doc_id, 0, 0, 0, "" if texts else None, ""))
                else:
                    n_a, n_b, groups, own = found
                    rows.append((doc_id, n_a, n_b, len(own), groups if texts else None, hashlib.sha256(groups.encode()).hexdigest()))
                links.append(np.unique(own, return_counts=True))
                size += len(own)
                if size >= block_links or len(rows) >= block_docs:
                    yield closed()
        if rows:
            yield closed()

    return map_batches(docs.select("doc_id", "text"), step, DOC_COLUMNS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): links of each pair over all documents; best: none of its B id has more."""
    totals = (blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n")))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = F.max("n").over(Window.partitionBy(b_id))
    return totals.select(
        F.shiftright("pair", 32).cast("int").alias("a_id"), b_id.cast("int").alias("b_id"), "n", (F.col("n") == most).alias("best"))


def _add_up(docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    values = values.sort_values("place")
    n, best = values["n"].to_numpy(np.int64), values["best"].to_numpy(bool)
    sums, bests = [], []
    for held, times in zip(docs["held"], docs["times"]):
        held, times = np.asarray(held, np.int64), np.asarray(times, np.int64)
        sums.append(int((n[held] * times).sum()))
        bests.append(int(times[best[held]].sum()))
    return docs.drop(columns=["held", "times"]).assign(n_best=bests, count_sum=sums)


def aligned(docs: DataFrame, a_path: str, b_path: str, texts: bool = False, **blocks: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups) of every document.

    A block brings at most ``BLOCK_LINKS`` links of several documents, or one document, to a task.
    """
    rows = written(alignments(docs, a_path, b_path, texts, **blocks), "aligned")
    totals = pair_counts(rows).select(
        (F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("pair"), "n", "best")
    places = rows.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("place", "pair"))
    values = places.join(totals, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    found = rows.where("pairs IS NULL").select(
        "block", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups", "groups_sha256", "held", "times")
    result = found.groupBy("block").cogroup(values.groupBy("of")).applyInPandas(
        _add_up, "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
                 "groups_sha256 string, n_best long, count_sum long")
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                         *(["groups"] if texts else []))
