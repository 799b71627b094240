"""Near-duplicate join on word n-grams by parity sketches.

A document's set holds its distinct five-word shingles (the whole sequence when it has fewer words).
Two sets link when 100 * intersection >= 75 * union, so their symmetric difference is at most
(|A| + |B|) / 7.

Sketches. Shingles are dealt into cells by hash and XORed, so one differing shingle changes at most
one cell: the number of differing cells, like the Hamming distance of a bit sketch, is a lower bound
of the symmetric difference. Sizes fall into bands of doubling width and a band has its own number of
cells; documents in the lower third of a band also take part in the band below. With at most D
differences one of the first D + 1 filled cells of two linked sets is equal (pigeonhole), so each
document offers these cells as join keys. The few documents with fewer filled cells offer all of
them and, among themselves, the first shingles in hash order that any linked pair must share.

Verification. Documents that share a key are compared with the smallest of them. Groups that are
still in several components then compare the closest pair of every two components, and what is left
after that pair by pair, inside blocks of bounded size. A pair first has to pass the bit sketches'
Hamming bound, then the exact comparison of both texts.
Copies (equal sets) are one node throughout and leave a map task once, so a group of copies is
never expanded. Nothing is dropped: every linked pair shares a key and is either compared or already
in one component.

Defined cases. Null, empty or blank text: no shingles, linked with nothing, a component of its own.
Equal texts: one component. Repeated doc_ids: each row is a document. Null doc_id: links like any
other, but a component without any doc_id has a null component_id; ``deduplicated`` goes by rows and
keeps a row of such a group too. Empty table: empty result. Other
columns: ignored by ``linked``, kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import (
    components, map_batches, mix, named_slices, rolling, row_key, signed, text_bytes, written,
)

SHINGLE = 5
PERCENT = 75
BLOCK = 512                 # members of a shared key that one task compares at a time
CELL, CONTENT, BIT = np.uint64(0x51ED270B7A14F3C5), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text (a binary column)."""
    for first, last, names, begins in named_slices(texts, fold_case=True):
        runs = rolling(names, size) if len(names) >= size else np.empty(0, np.uint64)
        for k in range(last - first):
            b, e = begins[k], begins[k + 1]
            if e - b >= size:
                found = np.sort(runs[b : e - size + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            else:
                yield rolling(names[b:e], size)


def _digest(found: np.ndarray, seed: int) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(found.tobytes(), seed)
    return value >> 64, value & 0xFFFFFFFFFFFFFFFF


def most_differences(size: int, other: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (size + other) * (100 - percent) // (100 + percent)


def band(size: int) -> int:
    return size.bit_length() - 1


def cells_in(level: int) -> int:
    return -(-9 * (1 << level) // 10) + 4


def bit_sketch(found: np.ndarray) -> bytes:
    """Parity bits, four to eight per shingle; folding halves the sketch of the next band onto this one."""
    bits = max(64, 8 << band(len(found)))
    at = (mix(found + BIT) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _first_cells(place: np.ndarray, content: np.ndarray, level: int, most: int) -> tuple[np.ndarray, bool]:
    """Keys of the first ``most + 1`` filled cells, and whether there are as many."""
    cells = cells_in(level)
    cell = (place * np.uint64(cells)) >> np.uint64(32)
    cell = cell.astype(np.uint16 if cells <= 65_536 else np.uint32)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    enough = len(starts) > most
    values = np.bitwise_xor.reduceat(content[order], starts)[: most + 1]
    return mix(values ^ mix(cell[starts[: most + 1]] + np.uint64((level + 1) << 40))), enough


def join_keys(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys that a set offers; two linked sets share at least one."""
    n = len(found)
    level = band(n)
    place, content = mix(found ^ CELL) >> np.uint64(32), mix(found + CONTENT)
    keys, enough = _first_cells(place, content, level, most_differences(n, n * 100 // percent, percent))
    parts, all_enough = [keys], enough
    below = (1 << level) - 1                   # the largest size in the band below
    if level and 100 * below >= percent * n:
        keys, enough = _first_cells(place, content, level - 1, most_differences(n, below, percent))
        parts.append(keys)
        all_enough &= enough
    if not all_enough:
        first = n - -(-percent * n // 100) + 1
        parts.append(mix(np.sort(mix(found + BIT))[:first] ^ CONTENT))
    return np.concatenate(parts)


def document_sets(docs: DataFrame, seed: int = 0, rows: bool = False) -> DataFrame:
    """doc_id, row, n_shingles, node and check (two halves of the set's digest), sketch.

    ``row`` is the row's key over all columns with ``rows``, else 0.
    """

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes, high, low, sketches = [], [], [], []
            for found in shingle_sets(batch.column(1)):
                a, b = _digest(found, seed) if len(found) else (0, 0)
                sizes.append(len(found))
                high.append(a)
                low.append(b)
                sketches.append(bit_sketch(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), signed(np.array(high, np.uint64)),
                 signed(np.array(low, np.uint64)), pa.array(sketches, pa.binary())],
                ["doc_id", "row", "n_shingles", "node", "check", "sketch"])

    row = row_key(docs) if rows else F.lit(0).cast("long")
    return map_batches(docs.select("doc_id", text_bytes(), row.alias("row")), step,
                       "doc_id long, row long, n_shingles long, node long, check long, sketch binary")


def offered_keys(docs: DataFrame, seed: int = 0, percent: int = PERCENT) -> DataFrame:
    """key, node: every distinct set once per map task."""

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in source:
            keys, nodes = [], []
            for found in shingle_sets(batch.column(0)):
                if not len(found):
                    continue
                node = _digest(found, seed)[0]
                if node in seen:
                    continue
                if len(seen) < 500_000:        # beyond that, copies are only sent more than once
                    seen.add(node)
                offered = join_keys(found, percent)
                keys.append(offered)
                nodes.append(np.full(len(offered), node, np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(keys)), signed(np.concatenate(nodes))], ["key", "node"])

    return map_batches(docs.select(text_bytes()), step, "key long, node long")


def _within_bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches allow."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"),
                                  F.col("sketch").alias(f"s_{x}"))

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            _, _, na, sa, nb, sb = (batch.column(k).to_pylist() for k in range(6))
            keep = [hamming(p, q) <= most_differences(m, n, percent) for m, p, n, q in zip(na, sa, nb, sb)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return map_batches(joined.select("a", "b", "n_a", "s_a", "n_b", "s_b"), step, "a long, b long")


def _verified(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, seed: int, percent: int, repeated_ids: bool,
) -> DataFrame:
    """The pairs that link, by their whole texts; each node's text is that of its first document."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(ids, "node").select("node", F.col("first_doc").alias("_first"))

    def own(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:   # a doc_id may come with several texts: only the node's own counts
            keep = [int(np.uint64(_digest(found, seed)[0]).astype(np.int64)) == node
                    for found, node in zip(shingle_sets(batch.column(1)), batch.column(0).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").alias("_id"), text_bytes().alias("text")).join(
        wanted, F.col("_id").eqNullSafe(F.col("_first"))).select("node", "text")
    if repeated_ids:
        texts = map_batches(texts, own, "node long, text binary").dropDuplicates(["node"])
    texts = written(texts, "candidates")

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in source:
            a = batch.column(0).to_pylist()
            new = [k for k, x in enumerate(a) if x != (a[k - 1] if k else last)]   # rows come sorted by a
            lefts = dict(zip(new, shingle_sets(batch.column(2).take(pa.array(new, pa.int64())))))
            keep = []
            for k, right in enumerate(shingle_sets(batch.column(3))):
                left = lefts.get(k, left)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            last = a[-1] if a else last
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    joined = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"))
    return map_batches(joined.select("a", "b", "ta", "tb"), step, "a long, b long")


def _packed(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for k, sketch in enumerate(sketches):
        row = np.frombuffer(sketch, np.uint64)
        while len(row) > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[k] = row
    return out


def _close(left: tuple, right: tuple, inside: bool, percent: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of two blocks (node, comp, n, sketches) the pairs in several components that sizes and sketches allow.

    With ``best``, the closest pair of every two components only.
    """
    (a, ca, na, sa), (b, cb, nb, sb) = left, right
    if sa.shape[1] != sb.shape[1]:
        wide, width = (sa, sb.shape[1]) if sa.shape[1] > sb.shape[1] else (sb, sa.shape[1])
        while wide.shape[1] > width:
            wide = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
        sa, sb = (wide, sb) if sa.shape[1] > width else (sa, wide)
    out_a, out_b, far = [], [], []
    for k in range(len(a)):
        m = slice(k + 1, None) if inside else slice(None)
        allowed = (na[k] + nb[m]) * (100 - percent) // (100 + percent)
        fine = (cb[m] != ca[k]) & (100 * np.minimum(na[k], nb[m]) >= percent * np.maximum(na[k], nb[m]))
        if fine.any():
            at = np.flatnonzero(fine)
            differ = np.bitwise_count(sb[m][at] ^ sa[k]).sum(1)
            near = differ <= allowed[at]
            hits = at[near]
            out_a.append(np.full(len(hits), k))
            out_b.append(hits + (k + 1 if inside else 0))
            far.append(differ[near] / (na[k] + nb[m][hits]))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(out_a), np.concatenate(out_b)
    if best and len(i):
        lo, hi = np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])
        order = np.lexsort((np.concatenate(far), hi, lo))
        first = np.append(True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]))
        i, j = i[order[first]], j[order[first]]
    return np.minimum(a[i], b[j]), np.maximum(a[i], b[j])


def block_pairs(dealt: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b) from rows sorted by (grp, lo, hi, block): one pass that holds two blocks at a time."""

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> pa.RecordBatch | None:
            blocks = {}
            for block, *rest in held:
                blocks.setdefault(block, []).append(rest)
            parts = []
            for rows in blocks.values():
                node, comp, n, sketch = zip(*rows)
                parts.append((np.array(node), np.array(comp), np.array(n), _packed(list(sketch))))
            if key[1] != key[2] and len(parts) < 2:
                return None
            a, b = _close(parts[0], parts[-1], key[1] == key[2], percent, best)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        for batch in source:
            for grp, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, lo, hi) != key:
                    if len(held) > 1 and (out := done()) is not None:
                        yield out
                    key, held = (grp, lo, hi), []
                held.append(tuple(row))
        if len(held) > 1 and (out := done()) is not None:
            yield out

    order = ["grp", "lo", "hi"]
    return map_batches(
        dealt.select(*order, "block", "node", "comp", "n", "sketch").repartition(*order).sortWithinPartitions(*order, "block"),
        step, "a long, b long", 4096)


def _torn_groups(members: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups in several components, dealt out so that one task holds two blocks of a group.

    The smallest member has met all others and stays out.
    """
    placed = members.where("head <> node").join(found.withColumnRenamed("id", "node"), "node", "left").select(
        "grp", "node", F.coalesce("component", "node").alias("comp"))
    torn = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")
                                     ).where("lo < hi").select("grp", "size")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    placed = placed.join(torn, "grp").join(nodes.select("node", "n", "sketch"), "node").select(
        "grp", "node", "comp", "n", "sketch", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    # A member meets every block of its group once.
    return written(placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp",
        "n", "sketch"), "torn")


def _groups(docs: DataFrame, percent: int, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """The document sets, and (node, first_doc, component): the component is named by its smallest node."""
    for seed in range(4):
        sets = written(document_sets(docs, seed, rows), "sets")
        nodes = written(sets.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
            (F.min("check") != F.max("check")).alias("clash")), "nodes")
        if nodes.where("clash").isEmpty():     # no two different sets share a 64-bit name
            break
    else:
        raise RuntimeError("set names clash")

    repeated_ids = not sets.groupBy("doc_id").count().where("count > 1").isEmpty()
    # Rows with one key meet once; of each key only its members and its smallest member go on.
    key = Window.partitionBy("key")
    shared = offered_keys(docs, seed, percent).select(
        "node", F.min("node").over(key).alias("head"), F.max("node").over(key).alias("tail"),
        F.sum(F.hash("node").cast("long")).over(key).alias("total")).where("head < tail")
    members = written(shared.select("head", "node", F.xxhash64("head", "tail", "total").alias("grp")).distinct(),
                      "members")

    stars = members.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(_within_bound(stars, nodes, percent), "stars")
    edges = written(_verified(stars, nodes, docs, seed, percent, repeated_ids), "edges")
    found = components(edges)

    # Groups that the stars left in several components: closest pairs first, then all of what is left.
    tested = stars
    for best in (True, False):
        dealt = _torn_groups(members, found, nodes)
        if dealt.isEmpty():
            break
        more = block_pairs(dealt, percent, best).distinct()
        more = written(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            edges = edges.union(written(_verified(more, nodes, docs, seed, percent, repeated_ids), "edges"))
            tested = tested.union(more)
            found = components(edges)

    return sets, nodes.select("node", "first_doc").join(found.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "first_doc", F.coalesce("component", "node").alias("component"))


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row."""
    sets, firsts = _groups(docs, percent)
    least = firsts.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    labels = firsts.join(least, "component").select("node", "component_id")
    return sets.join(labels, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, nulls last, then the smallest row key.

    Rows without words stay.
    """
    sets, firsts = _groups(docs, percent, rows=True)
    rows = written(sets.where("n_shingles > 0").select("doc_id", "row", "node").join(
        firsts.select("node", "component"), "node").select(
            "component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("name")), "named")
    first = rows.groupBy("component").agg(F.min("name").alias("first"))
    marked = written(rows.join(first, "component").groupBy("name").agg(
        F.count("*").alias("times"), F.min(F.col("name") == F.col("first")).alias("stays")).select(
            F.col("name.doc_id").alias("_id"), F.col("name.row").alias("_row"), "times", "stays"), "marked")
    named = docs.withColumn("_key", row_key(docs))
    same = named["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row"))
    kept = named.join(marked.where("not stays"), same, "left_anti")
    again = marked.where("stays and times > 1").select("_id", "_row")
    if again.isEmpty():
        return kept.drop("_key")
    same = kept["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row"))
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_key"])).drop("_key")
