"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words of all documents are counted; the most frequent ones are compiled into a minimal acyclic
transducer: equal suffixes share states, ids that words have in common are put out as early as the
letters decide them. The transducer is one array file, which Spark's file server hands to the
executors and which every worker process maps into memory. The distinct words that a worker does not
remember walk through it together; words that it does not hold are merged exactly, pair by pair, in the
order of the tokenizer's merges, many words at a time. How many words it holds (``words``) decides the
speed alone, never an id.

Texts of ASCII and Latin-1 characters are cut into words by the tokenizer's own pattern on Python
strings; all other texts by the tokenizer's own normaliser and pre-tokenizer, piece by piece between
its added tokens. A tokenizer of another kind is refused.

Defined cases. Null or empty text: no ids, decoded to the empty text. Null doc_id: kept. Repeated
rows or ids: each row is encoded. Texts of any length: whole. Empty table: empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import batches, map_batches
from orderloom.operators.ordering import running_totals

LEXICON_WORDS = 100_000      # words in the transducer; more costs the driver time, fewer the tasks
LONGEST = 64                 # bytes of a word in it
SHORT = 64                   # bytes of a word that is merged by looking at all its pairs each time
TOGETHER = 20_000            # words that are merged in one table
FEW = 32                     # words that are merged one by one
HELD_CHUNKS = 150_000        # encoded chunks that a worker keeps; as many older ones stay until these are full
HELD_WORDS = 300_000         # distinct words that a counting task holds before it hands them on
# The tokenizer's normaliser, word pattern and word end (fixed values).
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# The same pattern for texts that hold only ASCII and these Latin-1 letters and signs.
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^ \t\n\r0-9{LETTER}]+"
NOT_PLAIN = r"[^\x20-\x7e\t\n\r\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {chr(b) if b in set(prints) else chr(next(spare)): b for b in range(256)}


class Merges:
    """A word tokenizer's file: normaliser, word pattern, vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("byte_fallback")
            and not model.get("ignore_merges") and spec["decoder"] is None and steps == ["Split", "ByteLevel"]
            and (spec["normalizer"] or {}).get("normalizers") == NORMALISER
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": PATTERN}
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        if not known:
            raise ValueError(f"{path}: not a byte-level BPE with word ends, lower case and no decoder")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.joined = [vocab[a + b] for a, b in pairs]
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + WORD_END] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = np.append(keys[order], np.int64(1) << 62), np.append(order, len(pairs)).astype(np.int32)
        self.known: dict[str | bytes, bytes] = {}     # ids of the chunks that this worker has met
        self.older: dict[str | bytes, bytes] = {}

    def ids(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the earliest merge first, the leftmost of equals."""
        if not word:
            return []
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > SHORT:
            return self._long(ids)
        get, none = self.rank.get, len(self.joined)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k] = new = self.joined[best]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((new, ids[k + 1]), none)
            if k:
                ranks[k - 1] = get((ids[k - 1], new), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        rank = self.rank
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        # Entries: (rank, place, left id, right id); a stale one no longer finds its two ids.
        waiting = [(r, k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, k, a, b = heapq.heappop(waiting)
            n = after[k]
            if ids[k] != a or n >= len(ids) or ids[n] != b:
                continue
            ids[k], ids[n] = new, _ = self.joined[r], -1
            after[k] = n = after[n]
            if n < len(ids):
                before[n] = k
                if (r := rank.get((new, ids[n]))) is not None:
                    heapq.heappush(waiting, (r, k, new, ids[n]))
            p = before[k]
            if p >= 0 and (r := rank.get((ids[p], new))) is not None:
                heapq.heappush(waiting, (r, p, ids[p], new))
        return [i for i in ids if i >= 0]


    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, behind all when it has none; negative ids have none."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], np.int32(len(self.joined)))

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words as little-endian 32-bit numbers; an added token ends in a byte that ends no UTF-8 text."""
        out: list[bytes] = [b""] * len(words)
        bands: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if word.endswith(b"\xff"):
                out[k] = pack("<i", self.added[word[:-1].decode()])
            else:
                bands.setdefault(0 if len(word) > SHORT else max(8, 1 << (len(word) - 1).bit_length()), []).append(k)
        for width, places in bands.items():
            if width == 0 or len(places) < FEW:
                for k in places:
                    ids = self.ids(words[k])
                    out[k] = pack(f"<{len(ids)}i", *ids)
                continue
            for first in range(0, len(places), TOGETHER):
                some = places[first : first + TOGETHER]
                data, cuts = self._merged([words[k] for k in some], width)
                for k, a, b in zip(some, cuts, cuts[1:]):
                    out[k] = data[a:b]
        return out

    def _merged(self, words: list[bytes], width: int) -> tuple[bytes, list[int]]:
        """Ids of words of at most ``width`` bytes as one run of bytes, and where each word's begin in it.

        One word a row, with an empty place (-1) before and behind it. Each round merges in every row
        that still has one the pair of the earliest merge, the leftmost of equals. The right one's
        place becomes empty; ``after`` and ``before`` lead past it.
        """
        n, none = len(words), len(self.joined)
        sizes = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((n, width + 2), -1, np.int64)
        ids[:, 1:-1][np.arange(width) < sizes[:, None]] = np.array(self.inner)[letters]
        ends = np.flatnonzero(sizes)
        ids[ends, sizes[ends]] = np.array(self.last)[letters[np.cumsum(sizes)[ends] - 1]]
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        ranks = np.full((n, width + 2), none, np.int32)
        held = ids[:, 1:] >= 0
        held[:, 1:] &= held[:, :-1].copy()
        held[:, 0] = False                   # pairs of two letters, by the place of the second
        row, place = np.nonzero(held)
        ranks[row, place] = self.ranks(ids[row, place], ids[row, place + 1])
        joined = np.array(self.joined, np.int64)
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            more = best < none
            live, at, best = live[more], at[more], best[more]
            gone = after[live, at]
            right, left = after[live, gone], before[live, at]
            ids[live, at] = new = joined[best]
            ids[live, gone] = -1
            ranks[live, gone] = none
            after[live, at], before[live, right] = right, at
            ranks[live, at] = self.ranks(new, ids[live, right])
            ranks[live, left] = self.ranks(ids[live, left], new)
        kept = ids >= 0
        return ids[kept].astype("<i4").tobytes(), np.append(0, 4 * np.cumsum(kept.sum(axis=1))).tolist()

    def keep(self, chunk: str | bytes, ids: bytes) -> None:
        if len(self.known) >= HELD_CHUNKS:
            self.older, self.known = self.known, {}
        self.known[chunk] = ids


class Splitter:
    """Cuts a text into chunks, and chunks into words as bytes."""

    def __init__(self, path: str, added: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalise, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.marks = tuple(added)
        self.other, self.words = re.compile(NOT_PLAIN).search, re.compile(PLAIN_WORDS).findall
        self.byte = byte_letters()

    def chunks(self, text: str) -> list[str | bytes]:
        """Chunks between blanks of a plain text; words (bytes) and added tokens (str) of another."""
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return [c for k, p in enumerate(parts) for c in ([p.encode() + b"\xff"] if k % 2 else self._part(p))]
        return self._part(text)

    def _part(self, text: str) -> list[str | bytes]:
        if self.other(text) is None:
            return text.lower().split()
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.cut(self.normalise(text))]

    def of(self, chunk: str | bytes) -> list[bytes]:
        """The words of a chunk; an added token is its text and a byte that ends no word."""
        if isinstance(chunk, bytes):
            return [chunk]
        return [chunk.encode()] if chunk.isalpha() else [w.encode() for w in self.words(chunk)]


def frequent_words(docs: DataFrame, tokenizer: str, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The ``limit`` most frequent words of all documents as bytes, equal counts by word.

    Every word of every text is counted: in the map task first, then by word. A task hands its
    counts on when it holds many words.
    """
    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer, Merges(tokenizer).added)
        seen: Counter = Counter()

        def counted() -> Iterable[tuple]:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for word in splitter.of(chunk):
                    if len(word) <= LONGEST:
                        words[word] += n
            seen.clear()
            return ((w, n) for w, n in words.items())

        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        for batch in source:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(splitter.chunks(text))
            if len(seen) > HELD_WORDS:
                yield from batches(counted(), schema)
        yield from batches(counted(), schema)

    counts = map_batches(docs.select("text"), step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # The place of a word in the order comes from a range sort; only the words wanted leave the tasks.
    placed = running_totals(counts.withColumn("_one", F.lit(1)), [F.desc("n"), F.col("word")], {"_one": "_place"})
    return [bytes(r.word) for r in placed.where(F.col("_place") <= limit).orderBy("_place").select("word").collect()]


def compile_transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal acyclic transducer of sorted distinct words with their ids, as one array.

    Words come in order, so a state is complete once the next word leaves it; a complete state
    equal to a known one (same end, same letters, targets and outputs) becomes that one.

    Layout: five counts (arcs, states, outputs, ids, bytes of the longest word); per arc its key (256 * state + letter, sorted),
    target and output; per state its final output (-1: no word ends here); where each output begins;
    the ids of the outputs. Output 0 is empty; the start is the last state.
    """
    known: dict[tuple, int] = {}
    outputs: dict[tuple, int] = {(): 0}
    states: list[tuple] = []

    def settle(state: list) -> int:
        ends, arcs = state
        key = (ends, tuple((letter, to, out) for letter, (to, out) in arcs.items()))
        found = known.get(key)
        if found is None:
            found = known[key] = len(states)
            states.append(key)
        return found

    path: list[list] = [[None, {}]]          # states of the last word: [final output, {letter: [target, output]}]
    last, longest = b"", 0
    for word, ids in entries:
        longest = max(longest, len(word))
        shared = len(os.path.commonprefix([last, word]))
        for k in range(len(last), shared, -1):
            path[k - 1][1][last[k - 1]][0] = settle(path[k])
        del path[shared + 1 :]
        left = tuple(ids)
        for k in range(shared):
            # What this arc puts out stays if the new word has it too; the rest moves behind it.
            arc = path[k][1][word[k]]
            common = 0
            while common < min(len(arc[1]), len(left)) and arc[1][common] == left[common]:
                common += 1
            rest, arc[1] = arc[1][common:], arc[1][:common]
            if rest:
                behind = path[k + 1]
                if behind[0] is not None:
                    behind[0] = rest + behind[0]
                for other in behind[1].values():
                    other[1] = rest + other[1]
            left = left[common:]
        for k in range(shared, len(word)):
            path[k][1][word[k]] = [-1, left]
            left = ()
            path.append([None, {}])
        path[len(word)][0] = left
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1][last[k - 1]][0] = settle(path[k])
    settle([path[0][0], dict(path[0][1])])
    number = lambda out: outputs.setdefault(out, len(outputs))
    arcs = sorted((256 * s + letter, to, number(out)) for s, (_, row) in enumerate(states) for letter, to, out in row)
    final = [-1 if ends is None else number(ends) for ends, _ in states]
    begins = np.cumsum([0] + [len(o) for o in outputs])
    flat = [i for o in outputs for i in o]
    table = np.array(arcs, np.int32).reshape(-1, 3)
    return np.concatenate([
        np.array([len(arcs), len(states), len(outputs), len(flat), longest], np.int32), table[:, 0], table[:, 1], table[:, 2],
        np.array(final, np.int32), begins.astype(np.int32), np.array(flat, np.int32)])


class Transducer:
    """Looks words up in a compiled transducer, many at a time."""

    def __init__(self, array: np.ndarray):
        arcs, states, outputs, _, self.longest = array[:5].tolist()
        cuts = np.cumsum([5, arcs, arcs, arcs, states, outputs + 1])
        self.keys, self.targets, self.outs, self.final, self.begins, self.ids = np.split(array, cuts)[1:]
        self.start = states - 1

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, begins, ids): whether each word is held, and where its ids stand in ``ids``."""
        n = len(words)
        widths = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(widths) - widths
        # No longer word is held, so none is followed: that bounds the table of outputs.
        follow = (widths > 0) & (widths <= self.longest)
        live = np.flatnonzero(follow)
        longest = int(widths[live].max()) if len(live) else 0
        states = np.where(follow, self.start, -1)
        outs = np.zeros((longest + 1, n), np.int32)
        for k in range(longest):
            live = live[widths[live] > k]
            if not len(live):
                break
            wanted = states[live] * 256 + letters[first[live] + k]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            states[live[~hit]] = -1
            live, at = live[hit], at[hit]
            states[live] = self.targets[at]
            outs[k, live] = self.outs[at]
        ends = np.where(states >= 0, self.final[states], -1)
        found = ends >= 0
        outs[longest] = np.maximum(ends, 0)
        outs[:, ~found] = 0
        flat = outs.T.ravel()
        lengths = (self.begins[flat + 1] - self.begins[flat]).astype(np.int64)
        ids = self.ids[np.repeat(self.begins[flat] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        return found, np.append(0, np.cumsum(lengths.reshape(n, -1).sum(axis=1))) if n else np.zeros(1, np.int64), ids


@lru_cache(maxsize=2)
def _mapped(name: str) -> Transducer:
    """The transducer file of this executor, mapped into memory once per worker process."""
    return Transducer(np.memmap(SparkFiles.get(name), np.int32, "r"))


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Merges, Splitter]:
    merges = Merges(path)
    return merges, Splitter(path, merges.added)


def batch_ids(texts: list[str | None], merges: Merges, splitter: Splitter, lexicon: Transducer) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    cut = [splitter.chunks(t) if t else [] for t in texts]
    whole, new = {}, []
    known, older = merges.known.get, merges.older.get
    for chunk in set().union(*cut):
        own = known(chunk)
        if own is None:
            own = older(chunk)
            if own is None:
                new.append(chunk)
                continue
            merges.keep(chunk, own)
        whole[chunk] = own
    parts = [splitter.of(c) for c in new]
    words = list(set().union(*parts))
    found, begins, ids = lexicon.walk(words)
    data, cuts = ids.astype("<i4").tobytes(), (4 * begins).tolist()
    value = {word: data[a:b] for word, a, b in zip(words, cuts, cuts[1:])}
    unseen = [words[k] for k in np.flatnonzero(~found).tolist()]
    value.update(zip(unseen, merges.packed(unseen)))
    for chunk, part in zip(new, parts):
        whole[chunk] = own = value[part[0]] if len(part) == 1 else b"".join(map(value.__getitem__, part))
        if len(chunk) <= LONGEST:
            merges.keep(chunk, own)
    return [b"".join(map(whole.__getitem__, c)) for c in cut]


def encoded(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    sc = docs.sparkSession.sparkContext
    merges = Merges(tokenizer)
    held = [w for w in sorted(frequent_words(docs, tokenizer, words)) if not w.endswith(b"\xff")]
    entries = [(w, tuple(memoryview(ids).cast("i"))) for w, ids in zip(held, merges.packed(held))]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(prefix="orderloom-"), name)
    compile_transducer(entries).tofile(file)
    sc.addFile(file)

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, lexicon = _tools(tokenizer), _mapped(name)
        for batch in source:
            data = batch_ids(batch.column(1).to_pylist(), *tools, lexicon)
            bounds = np.append(0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) // 4))
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text that the tokenizer makes of them: the tokens, joined by blanks."""
    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tools(tokenizer)[0].tokens
        names = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_string())
        for batch in source:
            ids = batch.column(1)
            spelled = pa.ListArray.from_arrays(ids.offsets, names.take(ids.values))
            text = pc.binary_join(spelled, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, text], ["doc_id", "ids", "decoded"])

    return map_batches(encodings.select("doc_id", "ids"), step, "doc_id long, ids array<int>, decoded string")


def op11(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return decoded(encoded(docs, tokenizer), tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
