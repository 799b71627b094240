"""Best-fit packing of documents into sequences, improved by swap-based local search.

A document is its token ids and a closing id. Documents longer than a sequence are cut into
sequence-long pieces. Pieces are dealt evenly over groups of bounded size; a group is packed best
fit first, longest piece first, and then improved: documents move, or are exchanged one for one and
two for one, between bins that are not full, whenever that raises the sum of squared fills, until
no exchange of any two bins improves or the lower bound of sequences is reached. The loosely filled bins of all groups are packed once more
together, so that the cut into groups costs no sequences.

Defined cases. Null or empty text: the closing id alone, one piece of length 1. Null doc_id: kept.
Repeated rows: packed as often as they occur. Empty table: empty result. Other columns: ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import batches, map_batches, written

CAPACITY = 2048
GROUP_PIECES = 20_000        # pieces that one task packs
LOOSE = 0.95                 # bins filled less are packed again across groups
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, slot long")
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                          ("length", pa.int64()), ("ids_crc32", pa.int64()), ("slot", pa.int64())])
# The tokenizer's word pattern (a fixed value) for texts of these characters only; other texts go
# to the tokenizer whole.
OTHER = r"[^\x20-\x7e\t\n\r\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
WORDS = rf"[{LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\r0-9{LETTER}]+"


class WordIds(dict):
    """Token ids (little-endian 32-bit) of texts, by chunks between blanks and their words; emptied when ``limit`` is reached."""

    def __init__(self, path: str, limit: int = 500_000):
        import re

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, limit
        self.other, self.words = re.compile(OTHER).search, re.compile(WORDS).findall
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        # How the byte level shows each character outside ASCII.
        self.shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}

    def __missing__(self, chunk: str) -> bytes:
        words = self.words(chunk)
        if len(words) == 1:
            shown = chunk if chunk.isascii() else chunk.translate(self.shown)
            ids = [t.id for t in self.model.tokenize(shown)]
            value = pack(f"<{len(ids)}I", *ids)
        else:
            value = b"".join(map(self.__getitem__, words))
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = value
        return value

    def encode(self, text: str) -> bytes:
        if self.other(text) or "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, text.lower().split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; ``slot`` numbers them evenly."""
    closing = int(closing_id).to_bytes(4, "little")

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer)
        slot = (TaskContext.get().partitionId() * 7919) % 100_003

        def rows() -> Iterable[tuple]:
            nonlocal slot
            for batch in source:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = encoder.encode(text or "") + closing
                    for piece, begin in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[begin : begin + 4 * capacity]
                        yield doc_id, piece, begin // 4, len(cut) // 4, zlib.crc32(cut), slot
                        slot += 1

        yield from batches(rows(), PIECE_SCHEMA)

    return map_batches(docs.select("doc_id", "text"), step, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; longest item first into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied = 0                      # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = occupied >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                occupied &= ~(1 << room)
            bins[chosen].append(i)
        else:
            room, chosen = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            by_room[room].append(chosen)
            occupied |= 1 << room
    return bins


class OpenBins:
    """The bins that are not full, with an index of what each of them can take.

    ``take[0][o, b]`` is the most that bin b's fill can rise by when it takes one piece of length o
    and gives nothing, one or two pieces back; ``take[1]`` is the same for two pieces of length o
    together and at most one piece back. 0: it cannot rise.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.bins = bins
        self.fill = np.array([sum(size[i] for i in b) for b in bins], np.int64)
        kind = np.int16 if capacity < 1 << 15 else np.int32
        self.take = [np.zeros((capacity + 1, len(bins)), kind) for _ in range(2)]
        self.lengths = np.arange(capacity + 1)
        self.ones: list[int] = [0] * len(bins)     # bit s: a piece of length s
        self.twos: list[int] = [0] * len(bins)     # bit s: two pieces of length s together
        for k in range(len(bins)):
            self.index(k)

    def values(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes(self.capacity // 8 + 1, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))

    def index(self, k: int) -> None:
        ones = again = twos = 0
        for i in self.bins[k]:
            bit = 1 << self.size[i]
            again |= ones & bit
            ones |= bit
        left = ones
        while left:
            bit = left & -left
            left ^= bit
            twos |= (left | (again & bit)) << (bit.bit_length() - 1)
        self.ones[k], self.twos[k] = ones, twos
        room = self.capacity - int(self.fill[k])
        for take, back in ((self.take[0], 1 | ones | twos), (self.take[1], 1 | ones)):
            back = self.values(back)
            least = np.append(back, 2 * self.capacity)[np.searchsorted(back, self.lengths - room)]
            take[:, k] = np.maximum(self.lengths - least, 0)

    def best(self, a: int, takers: np.ndarray | None) -> tuple[int, int, int, int] | None:
        """The exchange from bin ``a`` that gains most: (pieces given less 1, their length, taker, rise)."""
        found, most = None, 0
        fill = self.fill if takers is None else self.fill[takers]
        for given, bits in enumerate((self.ones[a], self.twos[a])):
            lengths = self.values(bits)
            for part in np.array_split(lengths, max(1, len(lengths) * len(fill) // 4_000_000)):
                rise = self.take[given][part] if takers is None else self.take[given][np.ix_(part, takers)]
                # Half the rise of the sum of squares when ``rise`` goes from a to the taker.
                gain = rise * (fill - self.fill[a] + rise)
                if takers is None:
                    gain[:, a] = 0
                at = int(gain.argmax()) if gain.size else 0
                if gain.size and gain.flat[at] > most:
                    row, b = divmod(at, len(fill))
                    most = gain.flat[at]
                    found = given, int(part[row]), b if takers is None else int(takers[b]), int(rise[row, b])
        return found

    def _pick(self, k: int, count: int, length: int) -> list[int] | None:
        """``count`` pieces of bin k of that length together."""
        if count == 0:
            return [] if length == 0 else None
        seen: dict[int, int] = {}
        for i in self.bins[k]:
            s = self.size[i]
            if count == 1 and s == length:
                return [i]
            if count == 2 and length - s in seen:
                return [seen[length - s], i]
            seen[s] = i
        return None

    def exchange(self, a: int, given: int, length: int, b: int, rise: int) -> None:
        out = self._pick(a, given + 1, length)
        back = next(p for n in range(3 - given) if (p := self._pick(b, n, length - rise)) is not None)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        self.fill[a] -= rise
        self.fill[b] += rise
        self.index(a)
        self.index(b)


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills of the bins that are not full until no exchange helps.

    A bin is compared with all others when it has changed, and else with those that have changed
    since its last turn. The sum rises with every exchange, so the search ends.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-int(sizes.sum()) // capacity)
    live = sum(1 for b in bins if b)
    if live <= least:
        return [b for b in bins if b]
    full = [b for b, f in zip(bins, fill) if f >= capacity]
    open_ = OpenBins([list(b) for b, f in zip(bins, fill) if b and f < capacity], size, capacity)
    changes: list[int] = []                      # bins in the order of their changes
    last = [-1] * len(open_.bins)                # how many changes a bin has seen; -1: it changed itself
    active = True
    while active and live > least:
        active = False
        for a in np.argsort(open_.fill, kind="stable").tolist():     # the emptiest bins give
            while open_.bins[a] and live > least and last[a] < len(changes) + (last[a] < 0):
                takers = None if last[a] < 0 else np.unique(changes[last[a] :])
                best = open_.best(a, takers)
                last[a] = len(changes)
                if best is None:
                    break
                b = best[2]
                open_.exchange(a, *best)
                changes += [a, b]
                last[a] = last[b] = -1
                active = True
                live -= not open_.bins[a]
    return full + [b for b in open_.bins if b]


def _packer(capacity: int):
    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        fill = np.empty(len(sizes), np.int64)
        for k, members in enumerate(bins):
            lengths = sizes[members]
            sequence[members] = k
            offset[members] = np.cumsum(lengths) - lengths
            fill[members] = lengths.sum()
        group = int(frame["grp"].iloc[0])
        return frame.assign(sequence_id=sequence + (group << 32), offset=offset, fill=fill)

    return pack_group


PACKED = PIECES + ", grp long, sequence_id long, offset long, fill long"


def _pack_groups(items: DataFrame, count: int, capacity: int, group_pieces: int, first: int) -> DataFrame:
    groups = max(1, -(-count // group_pieces))
    return (items.withColumn("grp", F.pmod("slot", F.lit(groups)) + first)
            .groupBy("grp").applyInPandas(_packer(capacity), PACKED))


def packed_sequences(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    count = cut.count()
    packed = written(_pack_groups(cut, count, capacity, group_pieces, 0), "packed")
    loose = F.col("fill") < LOOSE * capacity
    items = packed.where(loose)
    left = items.count()
    if count > group_pieces and left:
        again = _pack_groups(items.select(cut.columns), left, capacity, group_pieces, -(-count // group_pieces) + 1)
        packed = packed.where(~loose).unionByName(again)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
