"""Operators against brute force on small tables that hold the awkward cases; what SQL cannot express."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import DOCS, awkward, prose, rows

from orderloom.llm import (
    common, curriculum, lattice, licenses, packing, parity, private_data, recompress, resampling, spotsigs, toxicity,
)

BLANK = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(BLANK, text or "")


# ---- names, rolling hashes, components -------------------------------------------------------------------------

def test_names_follow_words_and_not_places():
    texts = ["a bb\tccc", "", "ccc  A", None, "  xé a", "a"]
    column = pa.array([(t or "").encode() for t in texts], pa.binary())
    for limit in (1, 7, 1 << 20):
        for fold in (False, True):
            seen = {}
            for first, last, names, begins in common.named_slices(column, fold, limit):
                for k in range(first, last):
                    own = words(texts[k])
                    assert begins[k - first + 1] - begins[k - first] == len(own)
                    for word, name in zip(own, names[begins[k - first] :].tolist()):
                        key = "".join(c.lower() if c.isascii() else c for c in word) if fold else word
                        assert seen.setdefault(key, name) == name
            assert len(set(seen.values())) == len(seen)


def test_names_do_not_collide():
    texts = sorted({f"{a}{b}" for a in range(300) for b in ("", "x", "xx", "y")} | {"a" * k for k in range(1, 3000, 7)})
    found = next(common.named_slices(pa.array([" ".join(texts).encode()], pa.binary())))[2]
    assert len(set(found.tolist())) == len(texts)


def test_rolling_depends_on_the_run_only():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    for size in (1, 2, 5, 7, 50):
        found = common.rolling(x, size)
        assert len(found) == len(x) - size + 1
        runs = {}
        for k, h in enumerate(found.tolist()):
            assert runs.setdefault(tuple(x[k : k + size]), h) == h
        assert len(set(runs.values())) == len(runs)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}


# ---- 8: parity join --------------------------------------------------------------------------------------------

def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(table):
    sets = [shingle_set(r[1]) for r in table]
    label = list(range(len(table)))
    changed = True
    while changed:
        changed = False
        for i in range(len(table)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for k, r in enumerate(table):
        if r[0] is not None:
            least[label[k]] = min(least.get(label[k], r[0]), r[0])
    return sorted((str(r[0]), len(sets[k]), str(least.get(label[k]) if sets[k] else r[0])) for k, r in enumerate(table))


def test_parity_join_on_awkward_rows(docs):
    found = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in parity.linked(docs).collect()]
    assert sorted(found) == brute_components(awkward())


def test_parity_join_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", 2)      # several blocks per group
    rng = random.Random(11)
    texts = []
    for size in (6, 7, 8, 9, 12, 15, 16, 20, 31, 33, 40, 64, 70, 130):
        base = prose(size, size).split()
        texts.append(" ".join(base))
        for edits in range(1, 6):
            w = list(base)
            for _ in range(edits):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [f"n{rng.random()}"], [w[k], "m"]])
            texts.append(" ".join(w))
    shared = prose(77, 60)
    texts += [prose(500 + k, 30) + " " + shared for k in range(12)]     # one passage, different documents
    table = rows(texts)
    found = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in parity.linked(spark.createDataFrame(table, DOCS)).collect()]
    assert sorted(found) == brute_components(table)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(17)
    for n in [1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 40, 63, 64, 65, 100, 128, 170, 300]:
        for _ in range(30):
            common_part = rng.integers(0, 2**63, n).astype(np.uint64)
            for extra in range(0, n // 3 + 1, max(1, n // 9)):
                drop = int(rng.integers(0, 1 + max(0, n // 8)))
                a = np.unique(common_part)
                b = np.unique(np.append(common_part[drop:], rng.integers(0, 2**63, extra).astype(np.uint64)))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                    assert len(np.intersect1d(parity.join_keys(a), parity.join_keys(b)))
                    differing = len(a) + len(b) - 2 * both
                    assert parity.hamming(parity.bit_sketch(a), parity.bit_sketch(b)) <= differing


def test_deduplicated_keeps_one_of_each_group_and_all_columns(docs, empty):
    kept = parity.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [10, 11, 12, 13, 16, 17, 19, 20, None]))
    assert parity.linked(empty).count() == 0 and parity.deduplicated(empty).count() == 0


def test_deduplicated_goes_by_rows_and_not_by_ids(spark):
    x, y, a, b, c = (prose(k, 80) for k in range(40, 45))
    table = rows([a, b, x, x + " tail", y, c, c, c + " end", c, "", ""], [7, 7, 3, 5, 5, None, None, None, 9, None, None])
    kept = parity.deduplicated(spark.createDataFrame(table, DOCS).repartition(3)).collect()
    found = sorted((str(r.doc_id), r.text) for r in kept)
    assert found == sorted([("7", a), ("7", b), ("3", x), ("5", y), ("9", c), ("None", ""), ("None", "")])
    kept = parity.deduplicated(spark.createDataFrame(rows([a, a, a + " tail", b], [None] * 4), DOCS)).collect()
    assert len(kept) == 2 and {r.text for r in kept} in ({a, b}, {a + " tail", b})


# ---- 9: recompression ------------------------------------------------------------------------------------------

def brute_repeats(table, window=50):
    first = {}
    for r in table:
        w = words(r[1])
        for k in range(len(w) - window + 1):
            if r[0] is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in table:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[k : k + window])] < r[0]:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def passages():
    shared = [prose(900 + k, n) for k, n in enumerate((50, 51, 49, 75, 140))]
    texts = [prose(k, 40) + " " + shared[k % 5] + "\n" + shared[(k * 3) % 5] + " " + prose(k + 50, 30) for k in range(25)]
    texts += ["again " * 120, "again " * 70 + prose(5, 20), ("a b " * 80).strip(), "b " + "a b " * 40, shared[4] + " " + shared[4]]
    return texts


@pytest.mark.parametrize("rounds", [0, 3, 7, 10])
def test_recompression_is_exact_for_any_number_of_rounds(spark, rounds):
    table = awkward() + rows(passages(), range(100, 100 + len(passages())))
    found = recompress.repeats(spark.createDataFrame(table, DOCS).repartition(4), rounds=rounds)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == brute_repeats(table)


def test_without_repeats_keeps_columns(spark, docs, empty):
    out = recompress.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["class"] for r in out.collect()} == {1}
    assert {r.doc_id: r.text for r in out.collect()}[19] == prose(3, 120)
    assert recompress.repeats(empty).count() == 0


# ---- 10: curriculum --------------------------------------------------------------------------------------------

def brute_targets(sizes, limit=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        weights = sum(weight[s] for s in sizes if s not in full)
        target = {s: limit * sizes[s] if s in full else left * weight[s] / weights for s in sizes}
        over = {s for s in sizes if target[s] > limit * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_and_words_taken(spark):
    rng = random.Random(23)
    table = rows([prose(k, rng.choice([0, 3, 20, 60, 200])) for k in range(300)], range(300),
                 [rng.choice(["b", "a", "é", "zz", "Z", None, "tiny"] if k % 40 else ["tiny"]) for k in range(300)])
    table = [r for r in table if r[3] != "tiny" or r[0] % 40 == 0]
    frame = spark.createDataFrame(table, DOCS)
    found = curriculum.op10(frame).collect()
    sizes = Counter()
    for r in table:
        sizes[r[3]] += len(words(r[1]))
    target, source = brute_targets(dict(sizes)), {r[0]: r[3] for r in table}
    assert len(found) == len(table)
    taken = Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.size == len(words(table[[x[0] for x in table].index(r.doc_id)][1])) and r.taken <= 3 * r.size
        assert len(r.positions) == (r.taken // r.size if r.size else 0) and all(0 <= p <= 1 for p in r.positions)
        taken[s] += r.taken
    for s in sizes:
        # A source of eight documents cannot come closer than its documents' sizes allow.
        assert abs(taken[s] - target[s]) <= (100 if s == "tiny" else 0.005 * sizes[s] + 3), s
    again = {r.doc_id: r.taken for r in curriculum.op10(frame.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_mixed_is_in_training_order(spark):
    table = rows([prose(k, 30) for k in range(120)], range(120), ["abc"[k % 3] for k in range(120)])
    frame = spark.createDataFrame(table, DOCS)
    out = curriculum.mixed(frame)
    assert out.columns == frame.columns
    position = {}
    for r in curriculum.schedule(frame).collect():
        position[r.doc_id] = sorted(r.positions)
    order = [position[r.doc_id].pop(0) for r in out.collect()]
    assert order == sorted(order) and not any(position.values())


@pytest.mark.parametrize("extra", [0, 7])
def test_equal_rows_meet_the_target_together(spark, extra):
    """60 equal rows of 10 words are 600; the target of 480 takes 48 of them, not all or none."""
    text = prose(5, 10)
    table = rows([text] * 60 + [prose(k, 10) for k in range(extra)] + [prose(99, 420)], [1] * 60 + list(range(100, 100 + extra)) + [999],
                 ["a"] * (60 + extra) + ["b"])
    frame = spark.createDataFrame(table, DOCS).repartition(5)
    plan = curriculum.schedule(frame, weights=(0.5, 0.5 * (540 - 10 * extra) / 480) if extra == 0 else (1.0, 1.0), max_epochs=1).collect()
    taken = {s: sum(r.size * r.copies for r in plan if (r.doc_id < 999) == (s == "a")) for s in "ab"}
    target = next(r.target for r in plan if r.doc_id == 1)
    assert abs(taken["a"] - target) <= 10
    assert all(len(r.positions) == r.copies for r in plan)
    mixed = Counter(r.doc_id for r in curriculum.mixed(frame, weights=(0.5, 0.5 * (540 - 10 * extra) / 480) if extra == 0 else (1.0, 1.0),
                                                       max_epochs=1).collect())
    assert mixed == Counter({k: v for k, v in Counter(
        {i: sum(r.copies for r in plan if r.doc_id == i) for i in {r.doc_id for r in plan}}).items() if v})


def test_schedule_inverts_its_integral(spark):
    t = np.linspace(0, 1, 21)
    for slope in (-0.9, -0.5, 0.0, 0.5, 0.9):
        u = (1 - slope) * t + slope * t * t
        frame = spark.createDataFrame([(float(x),) for x in u], "u double")
        from pyspark.sql import functions as F

        found = [r[0] for r in frame.select(curriculum.invert(F.col("u"), F.lit(slope))).collect()]
        assert np.allclose(found, t, atol=1e-9)


def test_curriculum_on_awkward_rows(docs, empty):
    out = curriculum.op10(docs).collect()
    assert len(out) == len(awkward())
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert curriculum.op10(empty).count() == 0 and curriculum.mixed(empty).count() == 0


# ---- 4: packing ------------------------------------------------------------------------------------------------

def check_packing(table, packed, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    expected = Counter()
    for r in table:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            expected[r[0], piece, start, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in packed) // capacity)


def test_packing_round_trip(docs, empty, spark):
    used, least = check_packing(awkward(), packing.packed_sequences(docs, packing.public_tokenizer()).collect(), 2048)
    assert used == least
    table = rows([prose(k, 5 + k * 7 % 300) + " it's 42 ... ÉCLAIR" for k in range(150)])
    frame = spark.createDataFrame(table, DOCS).repartition(4)
    used, least = check_packing(
        table, packing.packed_sequences(frame, packing.public_tokenizer(), 512, group_pieces=40).collect(), 512)
    assert used <= least + 2
    assert packing.packed_sequences(empty, packing.public_tokenizer()).count() == 0


def test_word_ids_equal_the_tokenizer():
    encoder = packing.WordIds(packing.public_tokenizer(), limit=20)
    for text in ("it's DON'T we'RE ''s 'S", "A B ª µ ß Å ÿ", "<|endoftext|> x", "İstanbul", "é", "1.2.3 $$$''' '", "",
                 "\x1c a\x85b", "½ ² 4³", "日本 語", prose(4, 400)):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes(), text


def test_local_search_empties_bins():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])          # 30 = 3 bins of 10
    start = [[0, 5], [1, 6], [2, 3], [4]]
    out = packing.local_search([list(b) for b in start], sizes, 10)
    assert len(out) == 3 and sorted(i for b in out for i in b) == list(range(7))
    assert all(sizes[b].sum() <= 10 for b in out)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2049, 3000)
    bins = packing.best_fit(sizes, 2048)
    better = packing.local_search(bins, sizes, 2048)
    assert sorted(i for b in better for i in b) == list(range(3000)) and all(sizes[b].sum() <= 2048 for b in better)
    assert len(better) <= len(bins)


def test_local_search_has_no_budget():
    rng = np.random.default_rng(5)
    sizes, capacity = rng.integers(500, 1001, 700), 2048
    out = packing.local_search(packing.best_fit(sizes, capacity), sizes, capacity)
    assert sorted(i for b in out for i in b) == list(range(700)) and len(out) > -(-sizes.sum() // capacity)
    size, fill = sizes.tolist(), [int(sizes[b].sum()) for b in out]
    assert max(fill) <= capacity

    def sums(members):
        one = {size[i] for i in members}
        return one, {size[x] + size[y] for k, x in enumerate(members) for y in members[k + 1 :]}

    every = [sums(b) for b in out]
    for a in range(len(out)):
        for b in range(len(out)):
            if a != b and fill[b] < capacity:
                least = max(0, fill[a] - fill[b])     # more than this has to go over to raise the sum of squares
                moves = [x - y for x in every[a][0] for y in {0} | every[b][0] | every[b][1]]
                moves += [x - y for x in every[a][1] for y in every[b][0]]
                assert not any(least < m <= capacity - fill[b] for m in moves), (a, b)


def test_local_search_looks_at_all_pairs_of_a_bin():
    sizes = np.array([*range(1, 36), 71, 562])        # only 34 and 35, the last of 595 pairs, help
    assert len(packing.local_search([list(range(35)), [35], [36]], sizes, 632)) == 2


# ---- 6: personal data ------------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m[0])
            if kind == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def test_base_spans_equal_plain_patterns():
    rng = random.Random(31)
    bits = ["a@b.c", "@", "x.y@", "a-b.example", "@b.c%x@d.e", "a@b.cd@e.fg", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4",
            "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "5" * 25, "+1 (499) 555-6503", "+1", "+123456789012345",
            "+12 ", "--", "  ", "é", "\n", ".", "1", "23", "é@b.c", "a@b..c", "+1+2 345 678 901"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice(["", "", " ", "-"]) for _ in range(rng.randrange(1, 9)))
        assert private_data.base_spans(text) == plain_spans(text), text


@pytest.fixture(scope="module")
def tagger():
    texts = [prose(k, 60) + " " + private_data._variants(np.random.default_rng(k))[0] + " " + prose(k + 99, 30) for k in range(80)]
    model = private_data.Tagger()
    losses = model.fit(*private_data.training_set(texts))
    assert np.mean(losses[-10:]) < 0.1 * losses[0]
    return model


def test_tagger_on_held_out_spans(tagger):
    rng = np.random.default_rng(99)
    hits, wrong, n = 0, 0, 200
    for k in range(n):
        span, kind = private_data._variants(rng)
        text = prose(1000 + k, 60) + " " + span + " " + prose(2000 + k, 60)
        start = text.index(span)
        found = private_data.with_added(private_data.base_spans(text), private_data.tagged_spans(tagger, [text])[0])
        hits += any(f[1] == kind and f[0] < start + len(span) and f[2] > start for f in found)
        clean = prose(1000 + k, 60) + " " + private_data._distractor(rng) + " " + prose(2000 + k, 60)
        wrong += bool(private_data.with_added([], private_data.tagged_spans(tagger, [clean])[0]))
    assert hits >= 0.85 * n and wrong <= 0.03 * n


def test_respelled_emails_without_digits_are_found(tagger):
    for k, span in enumerate(("jane.doe (at) mail [dot] org", "jane(at)mail.org", "ann_b [at] mail.example.com") * 3):
        text = prose(3000 + k, 60 + k) + " " + span + " " + prose(4000 + k, 60)
        start = text.index(span)
        assert (start, 0, start + len(span)) in private_data.tagged_spans(tagger, [text])[0]


def test_prices_are_no_respelled_emails():
    assert private_data.spelled_emails("price @ 3.50 each, 12 (at) 4.5, 7 @ 1.2-3") == []
    assert private_data.spelled_emails("jane @ mail.org") == [(0, 0, 15)]


def test_all_windows_that_can_hold_a_span_are_read_and_joined():
    class Fixed(private_data.Tagger):
        """Every run without blanks is a card."""

        def emissions(self, x):
            e = np.zeros((*x.shape, private_data.LABELS), np.float32)
            e[..., 0] = (x == 32) * 9.0
            e[..., 6] = (x != 32) * 9.0
            return e

    model = Fixed()
    for before in range(0, 200, 3):           # over all places of a seam, with blanks and long neighbours
        for span in ("4111111111111111", "4111-1111-1111-1111".ljust(150, "-") + "-"):
            text = " " * before + span + " " * 150
            assert private_data.tagged_spans(model, [text])[0] == [(before, 2, before + len(span))]
    e = np.random.default_rng(1).normal(0, 1, (5, 40, private_data.LABELS)).astype(np.float32)
    model.w["t"][:] = np.random.default_rng(2).normal(0, 1, model.w["t"].shape)
    alone = [model.paths([x[: 8 + 7 * k]])[0].tolist() for k, x in enumerate(e)]
    assert [p.tolist() for p in model.paths([x[: 8 + 7 * k] for k, x in enumerate(e)])] == alone


def test_gradients_of_the_tagger():
    model = private_data.Tagger(hidden=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 105, (7, 4)).astype(np.int16), rng.integers(0, private_data.LABELS, (7, 4)).astype(np.int8)
    _, grads = model._gradients(x, y)
    for name in ("o", "ob", "t", "hf", "hb", "xf", "xb"):
        flat, g = model.w[name].reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(g))[:3]:
            old, eps = flat[at], 1e-3
            flat[at] = old + eps
            up = model._gradients(x, y)[0]
            flat[at] = old - eps
            down = model._gradients(x, y)[0]
            flat[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 5e-3 * max(1, abs(g[at])), name


def test_spans_and_mask_on_awkward_rows(spark, tagger, empty):
    secret = "write to jo.e@mail.example.com or +1 (499) 555-6503 now"
    table = awkward() + rows([secret, "é" * 500 + " 10.0.0.1", "7" * 30_000, secret], [50, 51, 52, 50])
    frame = spark.createDataFrame(table, DOCS)
    for r, t in zip(private_data.spans(frame.coalesce(1), tagger).collect(), table):
        base = plain_spans(t[1] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        text = ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    out = private_data.masked(frame, tagger)
    assert out.columns == frame.columns
    masked = {r.doc_id: r for r in out.collect()}
    assert masked[50].text == "write to [EMAIL] or [PHONE] now" and masked[50].n_chars == len(masked[50].text)
    assert masked[11].text is None and masked[19].text == prose(3, 120)
    assert private_data.spans(empty).count() == 0


# ---- 7: toxicity -----------------------------------------------------------------------------------------------

def test_chain_on_held_out_documents(spark, empty, docs):
    rng = random.Random(41)
    texts, labels = [], []
    for k in range(400):
        w = prose(k, rng.randrange(40, 200)).split()
        toxic = k % 5 == 0
        for _ in range(max(2, len(w) // 40) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(toxicity.INSULTS + toxicity.CONTEMPT)
        texts.append(" ".join(w))
        labels.append((k, 1, int(toxic)))
    frame = spark.createDataFrame(rows(texts), DOCS)
    known = [x for x in labels if x[0] < 250] + [(None, 1, 1), (3, None, None)]
    chain = toxicity.train(frame, spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    assert chain.names == ["insult", "contempt", "toxic"] and len(chain.models[2].earlier) == 2
    found = {r.doc_id: r.rejected for r in toxicity.scores(frame, chain).collect()}
    held = [x for x in labels if x[0] >= 250]
    assert sum(found[i] == bool(t) for i, _, t in held) >= 0.97 * len(held)
    kept = toxicity.accepted(frame, chain)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r}
    assert toxicity.scores(docs, chain).count() == len(awkward()) and toxicity.scores(empty, chain).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity.scores(docs, toxicity.train(docs, nothing)).collect())


# ---- 3: lattice ------------------------------------------------------------------------------------------------

def test_nearest_e8_point():
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_e8(x)
    distance = ((x - p) ** 2).sum(1)
    around = ((x[:, None] - (p[:, None] + lattice.NEIGHBOURS[None])) ** 2).sum(2).min(1)
    assert (distance <= around + 1e-12).all() and (distance <= 1 + 1e-12).all()     # covering radius 1


def test_vectors_of_any_magnitude_link(spark):
    e = np.random.default_rng(3).normal(size=64)
    table = [(k, (e * f).tolist(), 1) for k, f in enumerate((1.0, 1e200, 1e-200, 3.0, 1e307 / np.abs(e).max()))]
    found = lattice.linked(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(k, 4, 0) for k in range(5)}


def test_lattice_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MEMBERS", 5)
    rng = np.random.default_rng(8)
    table = []
    for c in range(12):
        centre = rng.normal(size=64)
        for k in range(12):
            table.append((len(table), (centre + rng.normal(size=64) * rng.uniform(0, 0.42)).tolist(), c % 3))
    table += [(500, table[0][1], 0), (501, table[0][1], 0), (502, table[0][1], None), (503, None, 0), (504, [0.0] * 64, 0),
              (505, [float("nan")] + [1.0] * 63, 0), (506, [None] + [1.0] * 63, 0), (507, [1.0] * 8, 0), (None, table[0][1], 0)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in lattice.linked(frame, members=5).collect()}
    fine = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in table
            if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    true = {i: 0 for i, *_ in table}
    for a in range(len(fine)):
        for b in range(len(fine)):
            (i, x, l), (j, y, m) = fine[a], fine[b]
            if a != b and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                true[i] += 1
    total = sum(true.values())
    assert total > 500
    assert all(found[i].n_links <= n for i, n in true.items())
    assert sum(found[i].n_links for i in true) >= 0.98 * total
    assert found[500].component_id == 0 and not found[500].kept and found[503].component_id == 503 and found[503].kept
    assert lattice.linked(frame.limit(0)).count() == 0


# ---- 2: spot signatures ----------------------------------------------------------------------------------------

def brute_signatures(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    content = [(x, k == 0 or len(w[k - 1]) <= 3 or len(w[k - 1]) == 7) for k, x in enumerate(w) if len(x) > 3]
    chains = [" ".join([c[0] for c in content[k : k + 3]] + [""] * (k + 3 - len(content))) for k in range(len(content)) if content[k][1]]
    return {hashlib.md5(c.encode()).hexdigest()[:8] for c in chains}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 4])
def test_spot_signatures_of_awkward_rows(spark, docs, empty, parts):
    table = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    found = spotsigs.edited_likeness(docs, parts).collect()
    expected = []
    for k, r in enumerate(table):
        text, after = r[1] or "", table[(k + 1) % len(table)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, alt, nxt = map(brute_signatures, (text, edited, after))
        expected.append((str(r[0]), len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(own)),
                         "".join(sorted(alt)), round(jaccard(own, alt), 9), round(jaccard(own, nxt), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                   round(r.near_next, 9)) for r in found) == sorted(expected)
    assert spotsigs.edited_likeness(empty).count() == 0


def test_spot_signatures_take_whole_words(spark):
    frame = spark.createDataFrame([("x" * 1_000_001 + end,) for end in ("a", "b")], "text string")
    a, b = [r.s for r in spotsigs.with_signatures(frame, "text", "s").collect()]
    assert len(a) == len(b) == 1 and a != b


def test_near_pairs_equal_brute_force(spark):
    texts = []
    for k in range(20):
        w = prose(k, 60 + k * 5).split()
        texts += [" ".join(w), " ".join(w[:-6] + ["tail", "words", "differ"]), " ".join(w)]
    member, pairs = spotsigs.near_pairs(spark.createDataFrame(rows(texts), DOCS))
    node = {r.doc_id: r.node for r in member.collect()}
    sets = {node[k]: brute_signatures(t) for k, t in enumerate(texts) if brute_signatures(t)}
    true = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.75}
    assert true and {(r.a, r.b) for r in pairs.collect()} == true


# ---- 1: resampling ---------------------------------------------------------------------------------------------

def test_resampling_prefers_target_like_text(spark, empty, docs):
    table = rows([prose(k, 80) if k % 2 else " ".join(f"zz{j % 7} qq{k % 3}" for j in range(60)) for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(table, DOCS)
    found = resampling.resample(frame, labels, fraction=0.5).collect()
    assert len(found) == 200 and sum(r.kept for r in found) == 100
    assert sum(r.kept and r.doc_id % 2 == 1 for r in found) >= 98
    order = sorted(found, key=lambda r: -r.gumbel_key)
    assert [r.place for r in order] == list(range(1, 201)) and all(r.kept == (r.place <= 100) for r in found)
    assert {r.doc_id: r.gumbel_key for r in resampling.resample(frame.repartition(7), labels).collect()} == {
        r.doc_id: r.gumbel_key for r in found}
    assert resampling.resample(docs, labels).count() == len(awkward())
    assert resampling.resample(empty, labels).count() == 0


def test_log_ratio_counts_every_feature(spark):
    texts = ["a b a", None, "b\tc", ""]
    counts = resampling.bucket_counts(spark.createDataFrame(rows(texts), DOCS).select(common.text_bytes()))
    assert counts.sum() == 5 + 3        # words and pairs


# ---- 5: licences -----------------------------------------------------------------------------------------------

def test_license_scan(spark, docs, empty):
    from orderloom.llm.license_texts import BSD_HEAD, BSD_TAIL, MIT

    odd = "Copyright (c) 2020 A. Nother\n\n" + MIT.replace("sublicense", "sub-licence").upper().replace(",", " ,")
    table = rows([odd, "x\nReleased under the  MIT licence!\ny", MIT + "\nand more", BSD_HEAD + BSD_TAIL, None, "",
                  "(C) 1999 me\n" + MIT], range(7))
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(table, DOCS)).collect()}
    assert found[0][0] == "MIT" and found[3][0] == "BSD-2-Clause" and found[6][0] == "MIT"
    assert found[2][0] is None and found[4] == (None, "") and found[5] == (None, "")
    assert licenses.scan(docs).count() == len(awkward()) and licenses.scan(empty).count() == 0


def test_any_mapping_of_known_texts_is_scanned(spark):
    known = {"PD": "This work is dedicated to the public domain."}
    frame = spark.createDataFrame(rows(["This work is dedicated to the Public Domain", "a\nThis work is dedicated to the public domain.\nb", "x"]), DOCS)
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(frame, known).collect()}
    assert found == {0: ("PD", "PD"), 1: (None, "PD"), 2: (None, "")}


def test_licences_above_code_titles_headers_and_spdx_lines(spark):
    from orderloom.llm.license_texts import APACHE_HEADER, BSD_HEAD, BSD_TAIL, GNU_HEADER, MIT, UNLICENSE

    commented = "\n".join(f"# {line}".rstrip() for line in APACHE_HEADER.replace("http:", "https:").split("\n"))
    texts = {
        "title": ("The MIT License (MIT)\n\nCopyright (c) 2020 A. Nother\n\n" + MIT, "MIT (titled 3)", "MIT,MIT (titled 3)"),
        "code": (MIT + "\n\nint main() { return 0; }\n\nint more;", None, "MIT"),
        "header": ("#!/bin/sh\n#\n" + commented + "\n#\n\nexit 0", None, "header: Apache-2.0"),
        "gnu": ("/*\n *\n" + GNU_HEADER.format(name="Lesser General Public License", version="2.1") + "\n\n*/ x", None, "header: LGPL-2.1-or-later"),
        "spdx": ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", None, "spdx: GPL-2.0-or-later"),
        "unlicense": (UNLICENSE, "Unlicense", "Unlicense"),
        "gap": (BSD_HEAD + "\n\nsoftware and other words\n\n" + BSD_TAIL, None, ""),
        "order": ("\n\n".join(reversed(MIT.split("\n\n"))), None, ""),
        "twice": ("software licence licence", None, ""),
    }
    frame = spark.createDataFrame(rows([t for t, _, _ in texts.values()], range(len(texts))), DOCS)
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(frame).collect()}
    for k, (name, (_, license, notices)) in enumerate(texts.items()):
        assert found[k] == (license, notices), name
    # Two documents of one id do not make one run.
    halves = spark.createDataFrame(rows(MIT.split("\n\n")[:1] + ["\n\n".join(["x", *MIT.split("\n\n")[1:]])], [5, 5]), DOCS)
    assert {(r.license, r.notices) for r in licenses.scan(halves).collect()} == {(None, "")}


def test_neighbouring_spellings_are_all_replaced(spark):
    frame = spark.createDataFrame([("licence licence sub-licence sub licence",)], "text string")
    assert frame.select(licenses.canonical(F.col("text"))).first()[0] == "license license sublicense sublicense"


def test_repeated_doc_ids_do_not_multiply_the_toxic_sample(spark):
    table = rows([prose(k, 60) + (" scum" * 5 if k % 2 else "") for k in range(40)] * 3, list(range(40)) * 3)
    frame = spark.createDataFrame(table, DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    once = toxicity.train(spark.createDataFrame(table[:40], DOCS), labels)
    again = toxicity.train(frame, labels)
    assert [m.bias for m in once.models] == [m.bias for m in again.models]
