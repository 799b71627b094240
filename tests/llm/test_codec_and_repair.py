"""Codec, cross-tokenizer alignment and conversation repair against the libraries and plain searches."""

import bisect
import hashlib
import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, differences
from samples import DOCS, awkward, prose, rows

from orderloom.llm import checks, crosstoken, lexicon, packing, turnrepair

WORD_BPE = packing.public_tokenizer()
BYTE_BPE = packing.public_tokenizer("byte_bpe_50k.json")
PIECES = packing.public_tokenizer("piece_bpe_32k.model")
ODD = ["Héllo, WORLD's  Σίσυφος ΟΔΟΣ 123 <|endoftext|> x <|ENDOFTEXT|> ſ İ ẞ é <|startoftext|>", "<|endoftext|>", "<s></s> <unk> \x00",
       "日本語テスト🙂 👍🏽 a\x85b\xa0c", "ÿ ÿ's don't I'LL", "\x1c a\x1f b \x0b\x0c", "²½ª º", "a▁b", " " * 5000 + "x", "tail  ", "\n\n a\n b"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts(seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    codes = [*range(1, 0x3000), *range(0xE000, 0x11000), 32, 32, 39, 0x3A3]
    return ODD + ["".join(map(chr, rng.choices(codes, k=50))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward() + rows(odd_texts(), range(100, 100 + len(odd_texts()))), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# ---- op11 ------------------------------------------------------------------------------------------------------

def test_merging_equals_the_library(whole):
    merges = lexicon.Merges(WORD_BPE)
    splitter = lexicon.Splitter(WORD_BPE, merges.added)
    texts = odd_texts(2) + [r[1] or "" for r in awkward()]
    nothing = lexicon.Transducer(lexicon.compile_transducer([]))
    for text, data in zip(texts, lexicon.batch_ids(texts, merges, splitter, nothing)):
        assert np.frombuffer(data, "<i4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_many_words_merge_as_one_word_does(whole):
    merges, rng = lexicon.Merges(WORD_BPE), random.Random(6)
    words = ["".join(rng.choices("aeinorstthingly", k=rng.choice([1, 2, 4, 7, 8, 9, 15, 17, 33, 64, 65, 90]))) for _ in range(900)]
    words += ["a" * k for k in range(1, 100)] + ["abaab" * k for k in range(1, 20)]
    data = merges.packed([w.encode() for w in words] + [bytes(rng.choices(range(254), k=30)) for _ in range(50)] + [b"", b"<|endoftext|>\xff"])
    found = [np.frombuffer(d, "<i4").tolist() for d in data]
    assert found[: len(words)] == [whole.encode(w, add_special_tokens=False).ids for w in words]
    assert found[-2:] == [[], [merges.added["<|endoftext|>"]]]


@pytest.mark.parametrize("held", [2, 100_000])
def test_chunks_are_encoded_once(whole, monkeypatch, held):
    monkeypatch.setattr(lexicon, "HELD_CHUNKS", held)
    walked = []

    class Watched(lexicon.Transducer):
        def walk(self, words):
            walked.extend(words)
            return super().walk(words)

    merges = lexicon.Merges(WORD_BPE)
    splitter, nothing = lexicon.Splitter(WORD_BPE, merges.added), Watched(lexicon.compile_transducer([]))
    texts = [prose(seed, 200) for seed in range(4)] + odd_texts(5)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for again in (False, True):
        walked.clear()
        found = lexicon.batch_ids(texts, merges, splitter, nothing)
        assert [np.frombuffer(d, "<i4").tolist() for d in found] == want
        assert len(merges.known) <= held and len(merges.older) <= held
    assert held == 2 or all(len(w) > lexicon.LONGEST for w in walked)


def test_transducer_is_minimal_and_exact():
    rng = random.Random(4)
    stems, ends = [b"walk", b"talk", b"t", b"st", b"re"], [b"", b"s", b"ed", b"ing", b"ings"]
    words = sorted({a + b for a in stems for b in ends} | {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(300)})
    value = {w: tuple(rng.choices(range(9), k=rng.randint(0, 4))) if k % 3 else tuple(w) for k, w in enumerate(words)}
    machine = lexicon.Transducer(lexicon.compile_transducer([(w, value[w]) for w in words]))
    found, begins, ids = machine.walk([*words, b"zz", b"", b"walke", b"x" * 5000])
    assert found.tolist() == [True] * len(words) + [False] * 4
    assert all(tuple(ids[begins[k] : begins[k + 1]].tolist()) == value[w] for k, w in enumerate(words))
    # No two states have the same end and arcs, and suffixes are shared.
    rows_ = defaultdict(list)
    for key, to, out in zip(machine.keys.tolist(), machine.targets.tolist(), machine.outs.tolist()):
        rows_[key // 256].append((key % 256, to, out))
    states = [(end, tuple(rows_[s])) for s, end in enumerate(machine.final.tolist())]
    assert len(set(states)) == len(states) < 1 + sum(len(w) for w in words)
    regular = lexicon.compile_transducer([(a + b, (a[0], len(b))) for a in sorted(stems[:2]) for b in ends])
    assert regular[1] < 4 + 1 + 7 + 4


@pytest.mark.parametrize("held", [0, 3, 5000])
def test_codec_against_the_library(spark, docs, whole, held):
    found = lexicon.decoded(lexicon.encoded(docs, WORD_BPE, held), WORD_BPE).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for doc_id, text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        want.append((doc_id, ids, whole.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.ids, r.decoded)) for r in found)


def test_codec_digests_and_empty_table(docs, empty, whole):
    found = Counter(tuple(r) for r in lexicon.op11(docs, WORD_BPE).collect())
    want = Counter()
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))] += 1
    assert found == want
    assert lexicon.op11(empty, WORD_BPE).collect() == []


def test_frequent_words_count_every_text(spark):
    texts = ["b b a", "a, c", None, "B don't"]
    frame = spark.createDataFrame(rows(texts), DOCS).repartition(3)
    assert lexicon.frequent_words(frame, WORD_BPE, 3) == [b"b", b"a", b"'t"]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        lexicon.Merges(BYTE_BPE)


# ---- op12 ------------------------------------------------------------------------------------------------------

def plain_alignment(texts):
    """Groups and links of every text from token ends alone, with the libraries' own encoders."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECES)
    letters = lexicon.byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        first, second = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sides = []
        for ids, spelled in ((first, [bytes(letters[c] for c in a.id_to_token(i)) for i in first]),
                             (second, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                                       b.id_to_piece(i).replace("▁", " ").encode() for i in second])):
            ends = np.cumsum([len(s) for s in spelled]).tolist()
            sides.append((b"".join(spelled), list(zip(ids, ends))))
        if any(s[0] != (" " + text).encode() for s in sides):
            out.append(None)
            continue
        (_, own), (_, other) = sides
        shared = sorted({e for _, e in own} & {e for _, e in other})
        parts = [defaultdict(list), defaultdict(list)]
        for side, part in zip((own, other), parts):
            for i, e in side:
                part[shared[bisect.bisect_left(shared, e)]].append(i)
        groups = [",".join(map(str, parts[0][e])) + "|" + ",".join(map(str, parts[1][e])) for e in shared]
        links = [(parts[0][e][-1], parts[1][e][-1]) for e in shared]
        out.append((len(own), len(other), groups, links))
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 2}, {"block_links": 50}])
def test_alignment_against_token_ends(docs, blocks):
    source = docs.where("length(text) < 3000 OR text IS NULL").select("doc_id", "text").collect()
    plain = plain_alignment([r.text for r in source])
    counts = Counter(link for p in plain if p for link in p[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for r, p in zip(source, plain):
        if p is None:
            want[r.doc_id, 0, 0, 0, 0, 0, 0, "", ""] += 1
            continue
        groups = ";".join(p[2])
        want[r.doc_id, p[0], p[1], len(p[2]), len(p[3]), sum(counts[x] == best[x[1]] for x in p[3]), sum(counts[x] for x in p[3]),
             sha(groups), groups] += 1
    frame = docs.where("length(text) < 3000 OR text IS NULL")
    assert Counter(tuple(r) for r in crosstoken.aligned(frame, BYTE_BPE, PIECES, texts=True, **blocks).collect()) == want


def test_long_texts_align_whole_and_windows_are_remembered(docs, empty):
    aligner = crosstoken.Aligner(*crosstoken.sides(BYTE_BPE, PIECES), held=3)
    texts = [r.text for r in docs.collect() if r.text and len(r.text) > 3000]
    assert texts
    for text, plain in zip(texts, plain_alignment(texts)):
        groups, links = aligner.windows(*aligner.tokens(text))
        assert groups == ";".join(plain[2]) and [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()] == plain[3]
        assert len(aligner.known) <= 3
    assert crosstoken.aligned(empty, BYTE_BPE, PIECES).collect() == []


def test_windows_are_tokenised_once():
    given = []

    def counting(side):
        return crosstoken.Side(side.pieces, lambda text: given.append(text) or side.encode(text), side.lossless, side.anchored)

    texts = [prose(seed, 400) for seed in range(8)]
    aligner = crosstoken.Aligner(*map(counting, crosstoken.sides(BYTE_BPE, PIECES)))
    found = [(n_a, n_b, groups, [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()]) for n_a, n_b, groups, links in aligner.aligned(texts)]
    assert [(p[0], p[1], ";".join(p[2]), p[3]) for p in plain_alignment(texts)] == found
    assert sum(map(len, given)) < sum(map(len, texts))      # of both sides together
    given.clear()
    assert len(list(aligner.aligned(texts))) == len(texts) and given == []


@pytest.mark.parametrize("held", [1, 1000])
def test_windows_at_odd_blanks(held):
    """Blanks at which a text is not cut, or not parted from other texts' windows."""
    rng = random.Random(9)
    words = ["a", "thé", "日本", "'s", "12", "▁", "a▁b", "\n", "\t", "\x85", "\xa0", "\u3000", "\x1c", "", "é", "<s>", "<0x0A>", "\x00", "⁇"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "  ", "\n", " \n", "\n "]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    aligner = crosstoken.Aligner(*crosstoken.sides(BYTE_BPE, PIECES), held=held)
    for plain, found in zip(plain_alignment(texts), aligner.aligned(texts), strict=True):
        assert (plain is None) == (found is None)
        if plain is not None:
            assert (plain[0], plain[1], ";".join(plain[2])) == found[:3]
            assert plain[3] == [(x >> 32, x & 0xFFFFFFFF) for x in found[3].tolist()]


@pytest.mark.parametrize("free", [0, 1])
def test_tokenizers_without_anchors_get_whole_texts(free):
    """Equal results, and never two texts in one run, when either side's files promise no anchors."""
    given = []
    both = [crosstoken.Side(s.pieces, lambda text, s=s: given.append(text) or s.encode(text), s.lossless, k == free)
            for k, s in enumerate(crosstoken.sides(BYTE_BPE, PIECES))]
    texts = [prose(seed, 30) for seed in range(5)] + ["a b", "▁ x", None, "", "\n c"]
    for plain, found in zip(plain_alignment(texts), crosstoken.Aligner(*both).aligned(texts), strict=True):
        assert (plain is None) == (found is None)
        assert plain is None or (plain[0], plain[1], ";".join(plain[2])) == found[:3]
    assert set(given) == {t for t in texts if t} | {" " + t for t in texts if t}


def test_pair_counts_hold_all_documents(docs):
    frame = docs.where("length(text) < 3000")
    counts = Counter(link for p in plain_alignment([r.text for r in frame.collect()]) if p for link in p[3])
    found = crosstoken.pair_counts(crosstoken.alignments(frame, BYTE_BPE, PIECES, block_docs=3)).collect()
    assert {(r.a_id, r.b_id): r.n for r in found} == dict(counts)


# ---- op13 ------------------------------------------------------------------------------------------------------

def cheapest(turns):
    """Shortest path over (rows read, state of the role pattern), smallest audit first among equals."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(turns) and q in (0, 3):
            return cost, audit, sha("\n".join(out))
        named = [(s, n) for s, n in (("u", "user"), ("a", "assistant")) if (q, s) in moves]
        for s, n in named:
            heapq.heappush(heap, (cost + 5, audit + "I", i, moves[q, s], out + (n + ":",)))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                if (q, role[:1]) in moves:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, moves[q, role[:1]], out + (f"{role}:{text}",)))
                for s, n in named:
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, moves[q, s], out + (f"{n}:{text}",)))


def test_repair_is_cheapest():
    rng, automaton = random.Random(7), turnrepair.Automaton()
    for k in range(1500):
        roles = ["user", "assistant", "system", "user", "assistant", " ", "", "tool", "ua"]
        size = 600 if k % 300 == 0 else rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])
        turns = [(rng.choice(roles), str(j), rng.choice([0, 0, 0, 0, 1, 2, 3])) for j in range(size)]
        repair = turnrepair.Repair(automaton)
        for turn in turns:
            repair.row(*turn)
            assert len(repair.tops) <= 8
        assert repair.result() == cheapest(turns)
    assert len(automaton.stack) < 20      # stacks share what lies below them


def test_another_grammar():
    """The automaton is made from the rules: here no system turn and any number of answers."""
    automaton = turnrepair.Automaton((("chat", ()), ("chat", ("chat", "u", "answers")), ("answers", ("a",)), ("answers", ("answers", "a"))))
    repair = turnrepair.Repair(automaton)
    for turn in [("system", "x", 0), ("user", "q", 0), ("assistant", "r", 0), ("assistant", "s", 0)]:
        repair.row(*turn)
    assert repair.result() == (2, "DKKK", sha("user:q\nassistant:r\nassistant:s"))


def test_faults_and_awkward_conversations(spark, tmp_path):
    long = "word " * 20_000 + "end."
    data = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([
        ("system", "Be kind."), ("user", f"Why {c}?"), ("assistant", "So."), ("assistant", "So."), ("user", "cut of"), ("assistant", None)])]
    data += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (None, 5, None, "c."), (40, None, "user", ""), (40, None, None, None),
             (41, 3, "user", long), (41, 9, "assistant", " \t\n"), (42, -4, "user", "q?"), (42, 4, "assistant", "r!"), (43, 1, "user", "q?"),
             (43, 1, "user", "q?"), (43, 2, "", "x."), (44, 2**40, "system", "only."), (45, 7, "user", "é ü?"), (45, 8, "ass", "ok.")]
    frame = spark.createDataFrame([(*d, 1, "k") for d in data], "conv_id long, turn long, role string, text string, fault int, gone string")
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = turnrepair.op13(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert differences(found, con, checks.TURN_REPAIR) == []
    assert found.count() == len({d[0] for d in data})
    assert turnrepair.op13(frame.limit(0)).collect() == []


def test_dropped_conversation_keeps_its_row(spark):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turnrepair.op13(spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", sha(""))
