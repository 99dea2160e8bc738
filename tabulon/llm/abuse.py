"""Abusive, hateful or sexually explicit passages: a factorization machine over hashed terms, learnt from labelled documents.

Reading. A text is cut at blanks; every distinct chunk is brought to its plain form once per worker: invisible characters
and dots between letters go, look-alike letters of other scripts and digits or signs for letters are turned back, drawn-out
letters are shortened, starred-out words are matched with known words. Letters spelt out with blanks are joined, words
broken at line ends too. Han and kana runs are read as pairs of characters. Sentences, brackets and long lines end a passage.

Scoring. A passage's features are its hashed words and word pairs that stand next to each other. The machine adds a weight
per feature and, for each two features, the product of their factors: what makes an insult of a word is the company it
keeps. A document's score is that of its worst passage, so length doesn't dilute it, and all passages of all texts are read.

Learning. Labels are of documents, and annotators err. A document labelled abusive is believed if its worst passage, by log odds
of features, is worse than that of nearly all clean documents if they had been labelled abusive. In rounds, documents that are
believed contribute their worst passage by the current scores, clean documents their worst and some random passages. So do some
documents without labels, nearly all of which are clean: without them, a machine learns the subjects of the few labelled ones.
At most MAX_LABELLED labelled documents are used and BACKGROUND others, chosen by hash. The cutoff is that of labelled documents
scored by machines that didn't learn from them.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.runtime import reliable_checkpoint

#: Labelled documents used for fitting at most, chosen by hash; their features pass through the driver.
MAX_LABELLED = 10_000
#: Documents drawn by hash, of which those without labels are background.
BACKGROUND = 8_000
BITS = 18
RANK = 8
#: Words per passage at most; longer ones are read as overlapping halves of this.
PASSAGE = 40
SEED = 11

# Letters that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = str.maketrans("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYX")
SIGNS = str.maketrans("0134578$@!|€", "oieastbsaile")
SIGNS_L = str.maketrans("0134578$@!|€", "oleastbsalle")

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_HAN = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]+")
_END = re.compile(r"[.!?;:)\]}。！？；：」』]+[\"'’”»]*$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?", re.U)
_DRAWN = re.compile(r"([^\W\d_])\1{2,}", re.U)
_DOTTED = re.compile(r"^[^\W\d_](?:[.\-_*·•][^\W\d_])+$", re.U)
_STARRED = re.compile(r"^[^\W\d_]?\*+[^\W\d_]?$|^[^\W\d_]+\*{1,}[^\W\d_]+$", re.U)
_SPELT = re.compile(r"(?<!\S)(?:[^\W\d_]['’]? ){2,}[^\W\d_](?=$|\s|[^\w\s])", re.U)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n\s*(?=[^\W\d_])", re.U)
_LINE = re.compile(r"\n(?=\s*(?:[#/>*\[(]|[A-ZÀ-ÞА-Я0-9]))")
_CUT = -1


def hash_word(word: str) -> int:
    """A 32-bit FNV hash, the same in every process."""
    h = 2166136261
    for b in word.encode("utf-8", "replace"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


@dataclass
class Reader:
    """Turns texts to lists of word hashes with _CUT between passages. words: counts of known words, for repairs."""

    words: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.seen: dict[str, tuple[int, ...]] = {}
        self.names: dict[int, str] | None = None
        self.shapes: dict[tuple, str] = {}
        for w, n in sorted(self.words.items(), key=lambda x: (x[1], x[0])):
            self.shapes[(w[0], len(w), w[-1])] = w
        total = sum(self.words.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in self.words.items()}
        self.worst = math.log(total) + 6
        self.longest = max(map(len, self.words), default=1)

    def plain(self, word: str) -> str:
        """The plain form of one word."""
        w = word.lower()
        if not w.isascii():
            w = unicodedata.normalize("NFKC", w)
            other = w.translate(LOOK_ALIKES)
            if other != w and (other.isascii() or any("a" <= ch <= "z" for ch in w)):
                w = other.lower()
        if w not in self.words:
            short = _DRAWN.sub(r"\1", w)
            if short != w:
                double = _DRAWN.sub(r"\1\1", w)
                w = double if double in self.words and short not in self.words else short
            if w not in self.words and not w.isalpha() and any(ch.isalpha() for ch in w):
                for signs in (SIGNS, SIGNS_L):
                    t = w.translate(signs)
                    if t in self.words:
                        return t
        return "<number>" if w.isdigit() or sum(ch.isdigit() for ch in w) > 1 else w

    def split_run(self, run: str) -> list[str]:
        """Known words that a run of letters without blanks is made of: the cheapest split by word frequency."""
        if run in self.words or not self.words:
            return [run]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            best.append(min((best[start][0] + self.cost.get(run[start:end], self.worst * (end - start)), start) for start in range(max(0, end - self.longest), end)))
        out, end = [], len(run)
        while end:
            start = best[end][1]
            out.append(run[start:end])
            end = start
        return out[::-1]

    def chunk(self, raw: str) -> tuple[int, ...]:
        """Word hashes of a chunk between blanks; _CUT where it starts or ends a passage."""
        c = _INVISIBLE.sub("", raw) if not raw.isascii() else raw
        out: list[str | int] = []
        if c[:1] in "([{":
            out.append(_CUT)
        end = bool(_END.search(c))
        core = c.strip("()[]{}\"'’“”„«»,;:.!?…#/<>「」『』。、！？")
        if _HAN.search(core):
            for part in re.split("([。！？；]+)", c):
                if part and part[0] in "。！？；":
                    out.append(_CUT)
                    continue
                for m in _HAN.finditer(part):
                    run = m[0]
                    out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
                out += [self.plain(w) for w in _WORD.findall(_HAN.sub(" ", part))]
        elif core:
            if _DOTTED.match(core):
                out.append(self.plain(re.sub(r"[.\-_*·•]", "", core)))
            elif "*" in core and _STARRED.match(core):
                key = (core[0].lower(), len(core), core[-1].lower())
                out += ["<starred>", self.shapes.get(key, f"{key[0]}{key[1]}{key[2]}")]
            elif core.isalpha() and core.isascii():
                out.append(self.plain(core))
            else:
                t = self.plain(core)
                if t in self.words:
                    out.append(t)
                else:
                    for w in _WORD.findall(core.lower()) if core.isascii() and not re.search("[$@!|]", core) else _WORD.findall(t):
                        out.append(self.plain(w))
        if end:
            out.append(_CUT)
        if self.names is not None:
            self.names.update((hash_word(w), w) for w in out if w != _CUT)
        return tuple(_CUT if w == _CUT else hash_word(w) for w in out)

    def read(self, text: str) -> list[int]:
        """Word hashes of a whole text, passages separated by _CUT."""
        if "-\n" in text or "‐" in text or "­" in text:
            text = _BROKEN.sub("", text)
        if "\n" in text:
            text = _LINE.sub(" ⏎ ", text)
        if _SPELT.search(text):
            text = _SPELT.sub(lambda m: " ".join(self.split_run(m[0].replace(" ", "").lower())) + " ", text)
        seen, out = self.seen, []
        for raw in text.split():
            ids = seen.get(raw)
            if ids is None:
                if len(seen) > 250_000:
                    seen.clear()
                ids = seen[raw] = (_CUT,) if raw == "⏎" else self.chunk(raw)
            out += ids
        return out


def passages(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices and the passage each belongs to, from word hashes with _CUT between passages.

    Passages of more than PASSAGE words are read in windows of PASSAGE words that overlap by half.
    """
    cut = ids == _CUT
    seg = np.cumsum(cut)
    words, seg = ids[~cut].astype(np.uint64), seg[~cut]
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.r_[True, seg[1:] != seg[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(seg)), 0))
    place = np.arange(len(seg)) - start
    half = PASSAGE // 2
    step = place // half
    # window j of a passage holds steps j and j + 1; a word is thus in windows step and step - 1
    length = np.diff(np.r_[np.flatnonzero(first), len(seg)])
    last = np.repeat(np.maximum((length - 1) // half - 1, 0), length)
    base = seg.astype(np.int64) << 20
    one = base + np.minimum(step, last)
    before = np.flatnonzero((step >= 1) & (step - 1 <= last) & (np.minimum(step, last) != step - 1))
    pair = np.flatnonzero(~first)
    bigram = (words[pair - 1] * np.uint64(0x9E3779B1) + words[pair] * np.uint64(0x85EBCA77) + np.uint64(1)) >> np.uint64(7)
    mask = np.uint64((1 << BITS) - 1)
    uni = ((words ^ (words >> np.uint64(15))) & mask).astype(np.int64)
    bi = (bigram & mask).astype(np.int64)
    in_before = np.zeros(len(words), bool)
    in_before[before] = True
    pb = pair[in_before[pair] & in_before[pair - 1]]
    at = np.searchsorted(pair, pb)
    f = np.concatenate([uni, uni[before], bi, bi[at]])
    p = np.concatenate([one, base[before] + step[before] - 1, one[pair], base[pb] + step[pb] - 1])
    order = np.argsort(p, kind="stable")
    return f[order], p[order]


@dataclass
class Machine:
    """Weights of the factorization machine: bias, one weight and RANK factors per feature."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, f: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of passages; starts: where each passage's features begin in f."""
        out = np.empty(len(starts))
        for at in range(0, len(starts), 20_000):  # in blocks, which bounds the memory
            own = starts[at : at + 20_000]
            part = f[own[0] : starts[at + 20_000] if at + 20_000 < len(starts) else len(f)]
            e = self.v[part]
            s = np.add.reduceat(e, own - own[0], axis=0)
            q = np.add.reduceat((e * e).sum(axis=1), own - own[0])
            out[at : at + 20_000] = self.bias + np.add.reduceat(self.w[part], own - own[0]) + 0.5 * ((s * s).sum(axis=1) - q)
        return out


#: The machine of no labels.
NOTHING = Machine(-5.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32))


def fit(examples: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.05, l2: float = 1e-4, seed: int = SEED, start: Machine | None = None) -> Machine:
    """Logistic loss by AdaGrad over the features that occur; examples are arrays of feature indices."""
    rng = np.random.default_rng(seed)
    used, flat = np.unique(np.concatenate(examples), return_inverse=True)
    sizes = np.array([len(e) for e in examples])
    ends = np.cumsum(sizes)
    m = start
    w = (m.w[used] if m else np.zeros(len(used))).astype(np.float64)
    v = (m.v[used] if m else rng.normal(0, 0.02, (len(used), RANK))).astype(np.float64)
    bias = m.bias if m else float(np.log((weight * y).sum() / max((weight * (1 - y)).sum(), 1e-9)))
    gw, gv, gb = np.full(len(used), 1e-2), np.full((len(used), RANK), 1e-2), 1e-2
    # batches keep their examples, so that their features are sorted once; the order of batches changes
    order, batches = rng.permutation(len(examples)), []
    for at in range(0, len(order), 256):
        batch = order[at : at + 256]
        i = flat[np.concatenate([np.arange(ends[b] - sizes[b], ends[b]) for b in batch])]
        by = np.argsort(i, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(i[by]) > 0])
        batches.append((batch, i, np.r_[0, np.cumsum(sizes[batch])[:-1]], by, first, i[by][first]))
    for _ in range(epochs):
        for at in rng.permutation(len(batches)):
            batch, i, starts, by, first, u = batches[at]
            k = np.repeat(np.arange(len(batch)), sizes[batch])
            e = v[i]
            s = np.add.reduceat(e, starts, axis=0)
            z = bias + np.add.reduceat(w[i], starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((e * e).sum(axis=1), starts))
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch])
            sw = np.add.reduceat((g[k] + l2 * w[i])[by], first)
            sv = np.add.reduceat((g[k, None] * (s[k] - e) + l2 * e)[by], first, axis=0)
            gw[u] += sw * sw
            gv[u] += sv * sv
            w[u] -= rate * sw / np.sqrt(gw[u])
            v[u] -= 0.4 * rate * sv / np.sqrt(gv[u])
            sb = g.sum()
            gb += sb * sb
            bias -= rate * sb / math.sqrt(gb)
    wide_w, wide_v = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32)
    wide_w[used], wide_v[used] = w, v
    return Machine(float(bias), wide_w, wide_v)


def words_of(text: str) -> set[str]:
    """Words of plain letters; drawn-out ones never become known words, however often they occur."""
    return {w for w in _WORD.findall(text.lower()) if w.isalpha() and not _HAN.search(w) and not _DRAWN.search(w)}


def vocabulary(texts: Iterable[str], least: int = 3) -> dict[str, int]:
    """Words of plain letters in at least so many texts, with their counts."""
    seen: Counter = Counter()
    for t in texts:
        seen.update(words_of(t))
    return {w: n for w, n in seen.items() if n >= least}


def document_features(reader: Reader, text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features as int32, and where its passages start among them."""
    f, p = passages(np.array(reader.read(text), np.int64))
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, np.int64)
    return f.astype(np.int32), starts.astype(np.int32)


@dataclass
class Corpus:
    """Documents as passages: features, where passages start, and each passage's document. y: mean labels, nan of documents without."""

    f: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    y: np.ndarray

    @classmethod
    def joined(cls, parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Corpus:
        at = np.cumsum([0] + [len(f) for f, _ in parts])
        f = np.concatenate([p[0] for p in parts])
        starts = np.concatenate([s.astype(np.int64) + a for (_, s), a in zip(parts, at)])
        return cls(f, starts, np.repeat(np.arange(len(parts), dtype=np.int32), [len(s) for _, s in parts]), y)

    @classmethod
    def of(cls, reader: Reader, texts: list[str], y: np.ndarray) -> Corpus:
        return cls.joined([document_features(reader, t) for t in texts], y)

    def passage(self, i: int) -> np.ndarray:
        return self.f[self.starts[i] : self.starts[i + 1] if i + 1 < len(self.starts) else len(self.f)]


def first_scores(c: Corpus) -> np.ndarray:
    """Scores of passages by the log odds of features, shrunk to 0, counted in documents: those of the first round.

    Every document is counted as if it were labelled abusive. A document that is so by mistake thus scores as clean ones do.
    """
    pos, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    first = np.searchsorted(c.docs, np.arange(len(c.y)), "left")
    last = np.searchsorted(c.docs, np.arange(len(c.y)), "right")
    ends = np.r_[c.starts, len(c.f)]
    filled = np.flatnonzero(first < last)
    for d in filled:
        f = np.unique(c.f[ends[first[d]] : ends[last[d]]])
        every[f] += 1
        if c.y[d] > 0:
            pos[f] += c.y[d]
    prior = np.nanmean(c.y)

    def odds(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        return np.clip(np.log((pos + 4 * prior) / (np.maximum(neg, 0) + 4 * (1 - prior))) - math.log(prior / (1 - prior)), 0, 4).astype(np.float32)

    own, other = odds(pos, every - pos), odds(pos + 1, every - pos - 1)
    out = np.empty(len(c.starts), np.float32)
    for d in filled:
        at = ends[first[d] : last[d]]
        out[first[d] : last[d]] = np.add.reduceat((own if c.y[d] > 0.5 else other)[c.f[at[0] : ends[last[d]]]], at - at[0])
    return out / np.sqrt(np.diff(ends) + 4)


def best_passages(c: Corpus, s: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The k passages with the highest scores of each document."""
    order = np.lexsort((-s, c.docs))
    first = np.r_[True, c.docs[order][1:] != c.docs[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    out: dict[int, list[int]] = defaultdict(list)
    for i in order[rank < k]:
        out[c.docs[i]].append(i)
    return {d: np.array(v) for d, v in out.items()}


def believed(c: Corpus, s: np.ndarray) -> tuple[np.ndarray, float]:
    """Documents labelled abusive whose worst passage by first_scores() is worse than that of 95 % of the clean ones, and the score of these."""
    top = highest(c, s)
    clean = top[c.y < 0.5]
    bar = float(np.quantile(clean, 0.95)) if len(clean) else 0.0
    return (c.y > 0.5) & (top > bar), bar


def learn(c: Corpus, rounds: int = 2, seed: int = SEED) -> Machine:
    """Multiple-instance learning: see the module's text."""
    rng = np.random.default_rng(seed)
    if not (c.y > 0.5).any() or not (c.y < 0.5).any():
        return NOTHING
    s = first_scores(c)
    bad, bar = believed(c, s)
    clean, unknown = c.y < 0.5, np.isnan(c.y)
    # beyond 98 % of the clean documents, of which some percent quote abusive words; such passages of others are no background
    doubtful = s > np.quantile(highest(c, s)[clean], 0.98)
    machine = NOTHING
    for turn in range(rounds):
        weights: dict[tuple[float, bytes], float] = defaultdict(float)  # of equal passages together
        best = best_passages(c, s, 3)
        for d, v in best.items():
            if bad[d]:
                weights[1.0, c.passage(v[0]).tobytes()] += 1.0
            elif clean[d]:
                for i in v:
                    if turn == 0 or s[i] <= 3.0:  # an annotator who missed it would teach the opposite
                        weights[0.0, c.passage(i).tobytes()] += 1.0
            elif unknown[d] and turn and s[v[0]] <= bar and not doubtful[v[0]]:  # what may be abusive isn't background
                weights[0.0, c.passage(v[0]).tobytes()] += 1.0
        for i in rng.choice(len(c.starts), min(len(c.starts), 3 * len(best)), replace=False):
            if clean[c.docs[i]] or (unknown[c.docs[i]] and s[i] <= bar and not doubtful[i]):
                weights[0.0, c.passage(i).tobytes()] += 0.5
        y = np.array([k[0] for k in weights])
        if not y.any():
            return NOTHING
        last = turn == rounds - 1
        machine = fit([np.frombuffer(k[1], c.f.dtype) for k in weights], y, np.array(list(weights.values())), epochs=12 if last else 8, seed=seed + turn)
        if not last:
            s, bar = machine.scores(c.f, c.starts), -1.0
    return machine


def highest(c: Corpus, s: np.ndarray) -> np.ndarray:
    """The highest score of each document's passages; -30 of one without passages."""
    top = np.full(len(c.y), -30.0)
    np.maximum.at(top, c.docs, s)
    return top


def worst_scores(c: Corpus, machine: Machine) -> np.ndarray:
    """The score of each document's worst passage; -30 of one without passages."""
    return highest(c, machine.scores(c.f, c.starts) if len(c.starts) else np.empty(0))


def cutoff(y: np.ndarray, top: np.ndarray, rate: float | None = None) -> float:
    """The score that parts documents, scored by machines that didn't learn from them, with the highest F1.

    rate: the share of all documents that score above 1. Where labelled documents do so more often, as they were picked, clean ones
    count for more of them, so that F1 is that of all documents.
    """
    known, best, weight = y != 0.5, (-1.0, 0.0, 0.0), 1.0
    seen = (top > 1).mean() if len(top) else 0.0
    if rate is not None and 0 < rate < 1 and 0 < seen < 1:
        weight = seen / (1 - seen) * (1 - rate) / rate
    bad = y[known] > 0.5
    for t in np.arange(-4.0, 2.01, 0.25):
        hit = top[known] > t
        f1 = 2 * (hit & bad).sum() / max(1.0, (hit & bad).sum() + weight * (hit & ~bad).sum() + bad.sum())
        best = max(best, (f1, -abs(t), t), key=lambda x: x[:2])
    return float(best[2])


def labelled(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text and mean label y of at most `most` labelled documents, and of those without labels, with y null, among BACKGROUND
    documents, all chosen by hash."""
    y = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.avg(label).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    drawn = documents.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(BACKGROUND).distinct()
    without = drawn.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("double").alias("y"))
    # the labels are the small side, bounded by `most` and BACKGROUND
    return documents.where("text is not null and trim(text) != ''").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y.unionByName(without)), "doc_id")


@dataclass
class Trained:
    """What train() learns: reader and machine; y and held_out: mean labels of the labelled documents, and their scores by a machine of the
    other half of them."""

    reader: Reader
    machine: Machine
    y: np.ndarray
    held_out: np.ndarray

    def cutoff(self, scores: DataFrame) -> float:
        """The cutoff for these scores (column score) of all documents."""
        if not (self.y > 0.5).any():
            return 0.0
        return cutoff(self.y, self.held_out, scores.agg(F.avg((F.col("score") > 1).cast("double"))).first()[0])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> Trained:
    """Fit on the labelled documents, beside some without labels. Without any label, nothing is ever flagged.

    Words are counted, texts read and machines learnt on the executors: one task learns from all documents of labelled(), two
    from a half of them each, by hash, and score the labelled ones of the other half, from which cutoffs follow. The driver gets the known
    words, one machine and a number per labelled document.
    """
    sample = reliable_checkpoint(labelled(documents, labels, label, most))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(w for b in batches for t in b.column("text").to_pylist() for w in words_of(t))
        yield pa.RecordBatch.from_pydict({"w": list(seen), "n": list(seen.values())}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    known = sample.where("y is not null").select("text").mapInArrow(words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where("n >= 3")
    reader = Reader({r.w: r.n for r in known.orderBy("w").collect()})
    vocabulary_ = dict(reader.words)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary_)
        for b in batches:
            parts = [document_features(reader, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("half"), b.column("y"), pa.array([f.tobytes() for f, _ in parts], pa.binary()), pa.array([s.tobytes() for _, s in parts], pa.binary())], names=["half", "y", "f", "s"])

    def learnt(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["half", "f", "y"], kind="stable")
        corpus = lambda part: Corpus.joined([(np.frombuffer(f, np.int32), np.frombuffer(s, np.int32)) for f, s in zip(part.f, part.s)], part.y.to_numpy())
        own, other = (pdf, pdf.iloc[:0]) if key[0] == 2 else (pdf[pdf.half == key[0]], pdf[(pdf.half != key[0]) & pdf.y.notna()])
        m = learn(corpus(own)) if len(own) else NOTHING
        top = worst_scores(corpus(other), m) if len(other) else np.empty(0)
        whole = key[0] == 2
        return pd.DataFrame({"turn": [np.int32(key[0])], "bias": [m.bias], "w": [m.w.tobytes() if whole else b""], "v": [m.v.tobytes() if whole else b""], "y": [other.y.to_numpy().tobytes()], "top": [top.tobytes()]})

    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int").alias("half")
    rows = sample.select(half, "y", "text").mapInArrow(features, "half int, y double, f binary, s binary")
    turns = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("turn")).groupBy("turn").applyInPandas(learnt, "turn int, bias double, w binary, v binary, y binary, top binary")
    got = sorted(turns.collect(), key=lambda r: r.turn)
    if not got:
        return Trained(reader, NOTHING, np.empty(0), np.empty(0))
    y, top = (np.concatenate([np.frombuffer(r[c]) for r in got]) for c in ("y", "top"))
    machine = Machine(got[-1].bias, np.frombuffer(got[-1].w, np.float32), np.frombuffer(got[-1].v, np.float32).reshape(-1, RANK))
    return Trained(reader, machine, y, top)


def score(documents: DataFrame, reader: Reader, machine: Machine, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` (default: all but the text), score and passages read; null and blank texts have score null, 0 passages."""
    keep = keep if keep is not None else [c for c in documents.columns if c not in (text, "score", "passages")]
    # bounded: 2 ** BITS features, and the words of at most MAX_LABELLED documents
    sent = documents.sparkSession.sparkContext.broadcast((reader.words, machine.bias, machine.w, machine.v))
    token = f"{machine.bias!r} {float(machine.w.sum())!r} {float(machine.v.sum())!r} {len(reader.words)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker keeps one reader, with the chunks it has seen, for its later tasks
        kept = sys.__dict__.setdefault("_tabulon_readers", {})
        if token not in kept:
            words, bias, w, v = sent.value
            kept.clear()
            kept[token] = (Reader(words), Machine(bias, w, v))
        reader, machine = kept[token]
        for b in batches:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                ids: list[int] = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    ids += reader.read(t) if t else ()
                    ids.append(-2)
                a = np.array(ids, np.int64)
                doc_end = a == -2
                a[doc_end] = _CUT
                f, p = passages(a)
                best = np.full(part.num_rows, np.nan)
                many = np.zeros(part.num_rows, np.int64)
                if len(f):
                    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                    s = machine.scores(f, starts)
                    # cuts before a passage tell its document
                    cuts = np.cumsum(a == _CUT)
                    ends = cuts[doc_end]
                    doc = np.searchsorted(ends, p[starts] >> 20, "right")
                    best[:] = -np.inf
                    np.maximum.at(best, doc, s)
                    best[np.isinf(best)] = np.nan
                    many = np.bincount(doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(best, pa.float64(), mask=np.isnan(best)), pa.array(many, pa.int64())], names=[*keep, "score", "passages"])

    kinds = dict(documents.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double", "passages bigint"])
    return documents.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
