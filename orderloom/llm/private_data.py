"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds to them.

The patterns give the base spans. The tagger is trained in numpy from labelled spans: a bounded
sample of the documents with their base spans as labels, plus variants of those spans in looser
spellings. Texts are read in overlapping windows; a character's emissions are the average of its
windows, weighted by the distance to the window's edge, and one Viterbi pass decodes a whole stretch
of windows. A tagged span must hold a digit, ``@`` or the word ``at`` (as its kind needs), so
stretches reach at least a window's stride beyond each of these; a stretch whose labels reach its
edge grows until they do not. Text outside of stretches can hold no span that counts. E-mails with
``(at)`` or ``[at]`` for ``@``, or looser blanks and dots, are found by a pattern as well. The spans that touch no base span are
added.

Defined cases. Null or empty text: no spans. Null doc_id: kept. Repeated rows: each found alike.
No document with base spans: the tagger learns from generated spans alone. Empty table: empty
result. Other columns: ignored by ``spans``, kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HINT = re.compile(r"[0-9@]|\bat\b", re.I)     # every tagged span holds one (``_spans_of``)
SPELLED = re.compile(             # e-mails in looser spellings, without the part before the @
    r"(?:@|[ ]@[ ]|[ ]?[\[(][ ]?at[ ]?[\])][ ]?)[a-z0-9-]++"
    r"(?:(?:\.|[ ]\.[ ]|[ ]?[\[(][ ]?(?:dot|\.)[ ]?[\])][ ]?|[ ]dot[ ])[a-z0-9-]++)++", re.I)
LABEL = re.compile(r"[a-z0-9-]+$", re.I)
AT = re.compile(r"(?:@|\bat\b).+?\W", re.I)
AT_DOT = re.compile(r"\bat\b\W*\w[\w-]*\s*[\[({<]?\s*(?:\.|\bdot\b)\s*[\])}>]?\s*\w", re.I)

WINDOW, STRIDE = 96, 64
HIDDEN = 12
TRAIN_DOCS = 400             # bound of the labelled sample
TRAIN_CHARS = 20_000         # and of a text in it
SPARE = 10                   # times as many documents are looked through for it
TRAIN_STEPS = 220
CHARS = 129                  # ASCII, and one for the rest
LABELS = 1 + 2 * len(KINDS)  # outside, begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns: leftmost and non-overlapping per kind, then validated."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        head = text[last:at]
        run = len(head) - len(head.rstrip(LOCAL))
        end = at + 1
        if run and (m := DOMAIN.match(text, at)):
            found.append((at - run, 0, m.end()))
            end = m.end()
        last, at = end, text.find("@", end)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled_emails(text: str) -> list[tuple[int, int, int]]:
    """E-mails with ``@``, ``(at)`` or ``[at]`` and looser blanks and dots, as (start, kind, end)."""
    found, last = [], 0
    for m in SPELLED.finditer(text):
        head = text[last : m.start()]
        ending = LABEL.search(m[0])[0]           # a number such as 3.50 is no host
        if (run := len(head) - len(head.rstrip(LOCAL))) and not ending.replace("-", "").isdigit():
            found.append((m.start() - run, 0, m.end()))
        last = m.end()
    return found


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def codes(text: str) -> np.ndarray:
    """Character classes: lower-cased ASCII, everything else in one."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    return np.minimum(points, CHARS - 1).astype(np.int16)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Bidirectional LSTM over characters, linear emissions, CRF transitions; numpy only."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (CHARS, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, scale, (hidden, 4 * hidden)).astype(np.float32)
        self.w["o"] = rng.normal(0, scale, (2 * hidden, LABELS)).astype(np.float32)
        self.w["ob"] = np.zeros(LABELS, np.float32)
        self.w["t"] = np.zeros((LABELS, LABELS), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; x is (time, batch)."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, out, kept = h, np.empty((*x.shape, n), np.float32), []
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            g = self.w[f"x{d}"][x[t]] + h @ self.w[f"h{d}"]
            ifo = _sigmoid(g[:, : 3 * n])
            i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
            z = np.tanh(g[:, 3 * n :])
            before, c = c, f * c + i * z
            tc = np.tanh(c)
            if keep:
                kept.append((t, h, before, i, f, o, z, tc))
            h = o * tc
            out[t] = h
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, "f", False)
        b, _ = self._run(x, "b", False)
        return np.concatenate([f, b], 2) @ self.w["o"] + self.w["ob"]

    def paths(self, emissions: list[np.ndarray], size: int = 500_000) -> list[np.ndarray]:
        """Best label sequence of each (time, label) array; arrays of like length run together."""
        t = self.w["t"]
        order = sorted((k for k in range(len(emissions))), key=lambda k: -len(emissions[k]))
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(emissions)
        while order:
            most = len(emissions[order[0]])
            count = 1
            while count < len(order) and 2 * len(emissions[order[count]]) > most and (count + 1) * most <= size:
                count += 1
            part, order = order[:count], order[count:]
            lengths = np.array([len(emissions[k]) for k in part])
            e = np.zeros((most, count, LABELS), np.float32)
            for row, k in enumerate(part):
                e[: lengths[row], row] = emissions[k]
            score, back = e[0].copy(), np.empty((most, count, LABELS), np.int8)
            active = np.searchsorted(-lengths, -np.arange(most), side="left")    # rows longer than k
            for k in range(1, most):
                n = active[k]
                through = score[:n, :, None] + t
                back[k, :n] = through.argmax(1)
                score[:n] = through.max(1) + e[k, :n]
            best = np.empty((most, count), np.int8)
            last, rows = score.argmax(1), np.arange(count)
            best[lengths - 1, rows] = last
            for k in range(most - 1, 0, -1):
                n = active[k]
                best[k - 1, :n] = back[k, rows[:n], best[k, :n]]
            for row, k in enumerate(part):
                out[k] = best[: lengths[row], row]
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood and its gradients."""
        time, size = x.shape
        n, w = self.hidden, self.w
        f, kept_f = self._run(x, "f", True)
        b, kept_b = self._run(x, "b", True)
        hidden = np.concatenate([f, b], 2)
        e = hidden @ w["o"] + w["ob"]
        t = w["t"].astype(np.float64)
        alpha = np.empty((time, size, LABELS))
        beta = np.zeros((time, size, LABELS))
        alpha[0] = e[0]
        for k in range(1, time):
            s = alpha[k - 1][:, :, None] + t
            m = s.max(1)
            alpha[k] = e[k] + m + np.log(np.exp(s - m[:, None]).sum(1))
        for k in range(time - 2, -1, -1):
            s = t + (e[k + 1] + beta[k + 1])[:, None, :]
            m = s.max(2)
            beta[k] = m + np.log(np.exp(s - m[:, :, None]).sum(2))
        m = alpha[-1].max(1)
        total = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
        rows = np.arange(size)
        gold = sum(e[k][rows, y[k]] for k in range(time)) + sum(t[y[k - 1], y[k]] for k in range(1, time))
        loss = float((total - gold).mean())
        de = np.exp(alpha + beta - total[:, None])
        dt = np.zeros_like(t)
        for k in range(1, time):
            p = np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k])[:, None, :] - total[:, None, None])
            dt += p.sum(0)
            np.add.at(dt, (y[k - 1], y[k]), -1)
        for k in range(time):
            de[k][rows, y[k]] -= 1
        de = (de / size).astype(np.float32)
        grads = {"t": (dt / size).astype(np.float32), "ob": de.sum((0, 1)),
                 "o": np.tensordot(hidden, de, ((0, 1), (0, 1)))}
        dh = de @ w["o"].T
        for d, kept, part in (("f", kept_f, dh[:, :, :n]), ("b", kept_b, dh[:, :, n:])):
            gx, gh = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"])
            nh = np.zeros((size, n), np.float32)
            nc = np.zeros((size, n), np.float32)
            for step, h, before, i, fg, o, z, tc in reversed(kept):
                g = part[step] + nh
                c = g * o * (1 - tc * tc) + nc
                pre = np.concatenate([c * z * i * (1 - i), c * before * fg * (1 - fg), g * tc * o * (1 - o),
                                      c * i * (1 - z * z)], 1)
                np.add.at(gx, x[step], pre)
                gh += h.T @ pre
                nh, nc = pre @ w[f"h{d}"].T, c * fg
            grads[f"x{d}"], grads[f"h{d}"] = gx, gh
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = TRAIN_STEPS, size: int = 96, rate: float = 0.02,
            seed: int = 11) -> list[float]:
        """Adam on windows x and labels y (window, time); returns the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(size, len(x)))
            loss, grads = self._gradients(np.ascontiguousarray(x[at].T), np.ascontiguousarray(y[at].T))
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            shrink = min(1.0, 5.0 / (norm + 1e-9))
            pace = rate * (1 - 0.8 * step / steps)
            for k, g in grads.items():
                g = g * shrink
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - pace * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses


def _variants(rng: np.random.Generator) -> tuple[str, int]:
    """A made-up span in a strict or a looser spelling, and its kind."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    pick = lambda *xs: xs[rng.integers(0, len(xs))]
    kind = int(rng.integers(0, 4))
    if kind == 0:
        at, dot = pick("@", "@", " @ ", "(at)", " [at] ", " (at) "), pick(".", ".", " . ", "[.]", " [dot] ")
        user = word() + pick("", "." + word(), "." + digits(2), "_" + digits(2))
        return user + at + word() + pick("", digits(1)) + dot + pick("com", "org", "net", "example.com"), 0
    if kind == 1:
        dot = pick(".", ".", "[.]", " . ", "(.)")
        return dot.join(str(rng.integers(0, 256)) for _ in range(4)), 1
    if kind == 2:
        body = pick("4", "5", "37", "6011") + digits(15)
        body = body[: pick(15, 16, 16, 16)]
        for last in "0123456789":
            if luhn(body[:-1] + last):
                body = body[:-1] + last
        sep = pick("", "", " ", "-", ".", "  ")
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4)), 2
    a, b, c = digits(3), digits(3), digits(4)
    return pick(
        f"+1 ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}",
        f"+1.{a}.{b}.{c}", f"00{rng.integers(1, 99)} {a} {b} {c}"), 3


def _distractor(rng: np.random.Generator) -> str:
    """Digits and uses of ``at`` that are no personal data."""
    pick = lambda *xs: xs[rng.integers(0, len(xs))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexa = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, rng.integers(12, 41)))
    plain = digits(15)
    while luhn(plain):
        plain = digits(15)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    return pick(f"{word()} at {word()}. {word()}", digits(rng.integers(1, 13)), hexa, hexa, f'"{hexa}"', f"{digits(4)}-{digits(2)}-{digits(2)}", plain,
                f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
                f"version {digits(1)}.{digits(1)}", f"@{hexa[:4]}", f"${digits(3)},{digits(3)}", f"CC BY-NC {digits(1)}.0",
                f"https://a.example/{digits(5)}")


def training_set(texts: list[str], windows: int = 1500, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: base spans where they stand, variants and distractors put into clean stretches."""
    rng = np.random.default_rng(seed)
    fill = "the of and on is with for by it was to in a be that this are at from or "
    x = np.full((windows, WINDOW), 32, np.int16)
    y = np.zeros((windows, WINDOW), np.int8)
    marked = [(t, base_spans(t)) for t in texts]
    with_spans = [(t, s) for t, s in marked if s]
    carriers = [t for t, _ in marked if len(t) > 20] or [fill * 3]
    for k in range(windows):
        if with_spans and k % 3 == 0:
            text, found = with_spans[int(rng.integers(len(with_spans)))]
            start, _, end = found[int(rng.integers(len(found)))]
            low = max(0, min(start, end) - int(rng.integers(0, WINDOW - 20)))
            text = text[low : low + WINDOW]
            spans = [(s - low, kind, e - low) for s, kind, e in found if s - low < WINDOW and e > low]
        else:
            carrier = carriers[int(rng.integers(len(carriers)))]
            low = int(rng.integers(0, max(1, len(carrier) - WINDOW)))
            carrier = carrier[low : low + WINDOW]
            near = base_spans(carrier)
            if near:
                carrier = fill * 2
            cut = int(rng.integers(0, 50))
            head, tail = carrier[:cut], carrier[cut:]
            glue = "" if head.endswith((" ", "\n")) or not head else " "
            if k % 3 == 1:
                span, kind = _variants(rng)
                spans = [(len(head + glue), kind, len(head + glue + span))]
                text = head + glue + span + [" ", ", ", ". ", "###", "\n"][int(rng.integers(5))] + tail.lstrip()
            else:
                text, spans = head + glue + _distractor(rng) + " " + tail.lstrip(), []
            text = text[:WINDOW]
        c = codes(text)
        x[k, : len(c)] = c
        for s, kind, e in spans:
            s, e = max(s, 0), min(e, WINDOW)
            if s < e:
                y[k, s:e] = 2 + 2 * kind
                y[k, s] = 1 + 2 * kind
    return x, y


def train(docs: DataFrame, sample_docs: int = TRAIN_DOCS, steps: int = TRAIN_STEPS) -> Tagger:
    """A tagger from a bounded sample of the documents that hold a base span or a digit."""
    share = min(1.0, SPARE * sample_docs / max(docs.count(), 1))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 31))
    near = docs.where((place < int(share * (1 << 31))) & (F.char_length("text") <= TRAIN_CHARS)
                      & F.col("text").rlike("@|[0-9]{4}"))
    texts = [r.text for r in near.select("text", place.alias("place")).orderBy("place", "text").limit(sample_docs).collect()]
    tagger = Tagger()
    tagger.fit(*training_set(texts), steps=steps)
    return tagger


def _stretches(text: str) -> list[list]:
    """[first window, last window, no labels yet] of the windows at every hint and their neighbours."""
    places = np.fromiter((m.start() for m in HINT.finditer(text)), np.int64)
    if not len(places):
        return []
    at = np.unique(places // STRIDE)
    low, high = np.maximum(at - 2, 0), np.minimum(at + 1, (len(text) - 1) // STRIDE)
    cut = np.flatnonzero(low[1:] > high[:-1] + 1)
    return [[a, b, None] for a, b in zip(low[np.append(0, cut + 1)].tolist(), high[np.append(cut, len(at) - 1)].tolist())]


def _stretch_emissions(tagger: Tagger, stretches: list[tuple[np.ndarray, int, int]], chunk: int) -> list[np.ndarray]:
    """Emissions of every character of (codes, first window, last window), averaged over its windows."""
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    spans_ = [(a * STRIDE, min(len(c), b * STRIDE + WINDOW)) for c, a, b in stretches]
    total = [np.zeros((e - s, LABELS), np.float32) for s, e in spans_]
    weights = [np.zeros((e - s, 1), np.float32) for s, e in spans_]
    jobs = [(k, w * STRIDE) for k, (_, a, b) in enumerate(stretches) for w in range(a, b + 1)]
    for begin in range(0, len(jobs), chunk):
        part = jobs[begin : begin + chunk]
        x = np.full((len(part), WINDOW), 32, np.int16)
        for row, (k, start) in enumerate(part):
            piece = stretches[k][0][start : start + WINDOW]
            x[row, : len(piece)] = piece
        found = tagger.emissions(np.ascontiguousarray(x.T)) * weight[:, None]
        for row, (k, start) in enumerate(part):
            low = start - spans_[k][0]
            n = min(WINDOW, len(total[k]) - low)
            total[k][low : low + n] += found[:n, row]
            weights[k][low : low + n] += weight[:n]
    return [t / w for t, w in zip(total, weights)]


def _label(tagger: Tagger, texts: list[str], held: dict[int, list[list]], chunk: int) -> dict[int, np.ndarray]:
    """Labels of the texts whose stretches are ``held``, grown until no labelled run reaches an edge."""
    c = {k: codes(texts[k]) for k in held}
    while True:
        todo = [(k, s) for k, parts in held.items() for s in parts if s[2] is None]
        if not todo:
            break
        best = tagger.paths(_stretch_emissions(tagger, [(c[k], s[0], s[1]) for k, s in todo], chunk))
        for (k, s), found in zip(todo, best):
            s[2], grow, last = found, (s[1] - s[0]) // 2 + 1, (len(c[k]) - 1) // STRIDE
            if found[0] and s[0] > 0:
                s[0], s[2] = max(0, s[0] - grow), None
            if found[-1] and s[1] * STRIDE + WINDOW < len(c[k]):
                s[1], s[2] = min(last, s[1] + grow), None
        for k in {k for k, s in todo if s[2] is None}:
            joined: list[list] = []
            for s in held[k]:
                if joined and s[0] <= joined[-1][1] + 1:
                    joined[-1] = [min(joined[-1][0], s[0]), max(joined[-1][1], s[1]), None]
                else:
                    joined.append(s)
            held[k] = joined
    labels = {}
    for k, parts in held.items():
        labels[k] = np.zeros(len(c[k]), np.int8)
        for a, _, found in parts:
            labels[k][a * STRIDE : a * STRIDE + len(found)] = found
    return labels


def tagged_spans(
    tagger: Tagger, texts: list[str], chunk: int = 2048, chars: int = 500_000,
) -> list[list[tuple[int, int, int]]]:
    """Spans of whole texts; about ``chars`` characters are labelled at a time, which bounds the memory."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held, size = {}, 0
    for k, text in enumerate(texts):
        if parts := _stretches(text):
            held[k] = parts
            size += sum(b - a + 2 for a, b, _ in parts) * STRIDE
        if held and (size >= chars or k == len(texts) - 1):
            for done, labels in _label(tagger, texts, held, chunk).items():
                out[done] = with_added(spelled_emails(texts[done]), _spans_of(labels, texts[done]))
            held, size = {}, 0
    return out


def _spans_of(labels: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    kind = np.where(labels > 0, (labels - 1) // 2, -1)
    begin = (labels > 0) & (labels % 2 == 1)
    change = np.flatnonzero((kind[1:] != kind[:-1]) | begin[1:]) + 1
    edges = [0, *change.tolist(), len(labels)]
    found = []
    for s, e in zip(edges, edges[1:]):
        if kind[s] < 0:
            continue
        while s < e and text[s].isspace():
            s += 1
        while e > s and (text[e - 1].isspace() or text[e - 1] in ",;:#"):
            e -= 1
        part = text[s:e]
        digits = sum("0" <= c <= "9" for c in part)
        k = int(kind[min(s, len(kind) - 1)]) if s < e else -1
        # With the whole text, so that the word at is one there too.
        if (k == 0 and (AT if "@" in part or digits else AT_DOT).search(text, s, e)) or (
                k == 1 and 4 <= digits <= 12 and len(re.findall(r"[0-9]+", part)) == 4) or (
                k == 2 and 14 <= digits <= 19 and luhn("".join(re.findall(r"[0-9]", part)))) or (
                k == 3 and 10 <= digits <= 15 and not re.search(r"[a-z]", part)):
            found.append((s, k, e))
    return found


def with_added(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and the tagged ones that touch none of them."""
    return sorted(base + [m for m in more if all(m[2] <= s or m[0] >= e for s, _, e in base)])


def spans(docs: DataFrame, tagger: Tagger | None = None, rows: int = 1024) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all)."""
    tagger = tagger or train(docs)

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [shown(with_added(b, m)) for b, m in zip(base, tagged_spans(tagger, texts))]
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(4)]
            digest = [hashlib.sha256(shown(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(every, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), step,
                       "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
                       rows)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in sorted(found):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, tagger: Tagger | None = None, rows: int = 1024) -> DataFrame:
    """The rows with personal data in ``text`` replaced; ``n_chars`` follows where there is one."""
    tagger = tagger or train(docs)
    where = docs.columns.index("text")

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(where).to_pylist()
            whole = [t or "" for t in texts]
            out = [None if t is None else mask(t, with_added(base_spans(t), m))
                   for t, m in zip(texts, tagged_spans(tagger, whole))]
            columns = [pa.array(out, pa.string()) if k == where else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = map_batches(docs, step, docs.schema, rows)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
