"""Toxicity by a subsequence string-kernel support vector machine over Nystrom landmarks.

The instances are the spans of a text's sentences: one to three neighbouring words. The kernel of two spans counts the
three-character subsequences that they share, each with a weight that decays with its gaps (at most five characters from first
to last), normalised and sharpened by an exponential; what parts the words of a span is passed over, and so are signs inside a
word, so that an insult that is cut, gapped or has characters put in still resembles itself, and a phrase is one instance.
A document counts by its most toxic spans. Landmarks are spans of the labelled documents' sentences, and the machine is trained
on such spans, of the toxic documents those that the round before found worst.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import returning
from parcelflow.llm.words import mix, powers

#: Gap decay, sharpness, landmarks, characters of a window of a long word and of a span of words, least kernel to a landmark that
#: counts, of a word and of several.
DECAY, SHARP, LANDMARKS, WINDOW, SPAN, NEAR, NEAR_SPAN = 0.7, 2.5, 96, 20, 16, 0.5, 0.85
#: Words of a span at most.
WORDS = 3
#: The documented bound of the training sample: documents of each label.
SAMPLE = 1000
CUT = 0.3
#: Scores of spans that a worker keeps.
CACHE = 200_000
#: (first, middle) places before the last character, for spans of 3, 4 and 5 characters.
SHAPES = ((2, 1), (3, 2), (3, 1), (4, 3), (4, 2), (4, 1))
#: Code of a white-space character and of one that is passed over; letters have 1 to 62.
SPACE, PASSED = 0, 63

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """A small code for each code point of the basic plane: a-z have their own, other letters share 36."""
    if not _classes:
        out = np.full(1 << 16, PASSED, np.uint8)
        for c in range(1 << 16):
            x = chr(c)
            if x.isspace():
                out[c] = SPACE
            elif x.isalpha():
                out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 36
        _classes.append(out)
    return _classes[0]


#: Letters written in another style, which count as the plain ones.
STYLED = re.compile("[\uff21-\uff5a\U0001d400-\U0001d7ff]")


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(code points and codes of all letters, begin and end of each word among them, the word's text and sentence).

    Letters are lower-cased, signs left out; white space parts words, and one after a point, question or exclamation mark
    parts sentences. Four and more letters of one text that stand apart are one word.
    """
    plain = [(unicodedata.normalize("NFKC", t) if not t.isascii() and STYLED.search(t) else t).replace("\n", " ") for t in texts]
    points = np.frombuffer("\n".join(["", *plain, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
    code = classes()[np.minimum(points, 0xFFFF)]
    code[points > 0xFFFF] = PASSED
    own = np.cumsum(points == 10) - 1
    closing = (points == 46) | (points == 33) | (points == 63)
    sentence = np.cumsum(np.concatenate(([False], closing[:-1])) & (code == SPACE))
    keep = code != PASSED
    points, code, own, sentence = points[keep], code[keep], own[keep], sentence[keep]

    letter = code != SPACE
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(~letter[1:] & letter[:-1]) + 1
    at = np.concatenate(([0], np.cumsum(letter)))
    begin, end, own, sentence = at[starts], at[ends], own[starts], sentence[starts]
    single = ends - starts == 1
    joint = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (own[1:] == own[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], joint.astype(np.int8), [0]))))
    drop = [np.arange(i, j) for i, j in zip(edge[0::2], edge[1::2], strict=True) if j - i >= 3]
    if drop:
        gone = np.concatenate(drop)  # each is taken into the word after it
        begin, end, own, sentence = np.delete(begin, gone + 1), np.delete(end, gone), np.delete(own, gone + 1), np.delete(sentence, gone + 1)
    return points[letter], code[letter], begin, end, own, sentence


def spans_of(begin: np.ndarray, end: np.ndarray, own: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last word) of each span: every word, and the runs of up to WORDS words of one sentence with SPAN letters at most."""
    first = [np.arange(len(begin))]
    last = [first[0]]
    for n in range(1, WORDS):
        i = np.arange(max(0, len(begin) - n))
        good = i[(own[i] == own[i + n]) & (sentence[i] == sentence[i + n]) & (end[i + n] - begin[i] <= SPAN)]
        first.append(good)
        last.append(good + n)
    return np.concatenate(first), np.concatenate(last)


def string_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code of three characters, weight) of each subsequence of each word, equal ones added up, by word and code."""
    points = np.frombuffer("\x00".join(["", *words, "", "", ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 0) - 1
    at, codes, weights = [], [], []
    for far, mid in SHAPES:
        first, middle, last = points[:-far], points[far - mid : -mid], points[far:]
        good = np.flatnonzero((owner[:-far] == owner[far:]) & (first > 0))
        at.append(owner[:-far][good])
        codes.append((first[good] << np.uint64(42)) | (middle[good] << np.uint64(21)) | last[good])
        weights.append(np.full(len(good), DECAY ** (far + 1), np.float32))
    at, codes, weights = np.concatenate(at), np.concatenate(codes), np.concatenate(weights)
    order = np.lexsort((codes, at))
    at, codes, weights = at[order], codes[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (codes[1:] != codes[:-1])))) if len(at) else np.zeros(0, int)
    return at[new], codes[new], np.add.reduceat(weights, new) if len(new) else weights


def least_norm(n: np.ndarray) -> np.ndarray:
    """A lower bound of the norm of a word of n characters, with its two marks."""
    n = np.minimum(n, WINDOW) + 2
    return np.sqrt(np.maximum(n - 2, 1) * DECAY**6 + 2 * np.maximum(n - 3, 0) * DECAY**8 + 3 * np.maximum(n - 4, 0) * DECAY**10)


def marked(word: str) -> list[str]:
    w = f"^{word}$"
    return [w] if len(word) <= WINDOW else [w[i : i + WINDOW + 2] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]


class Landmarks:
    """Words with which others are compared, and a table that bounds a word's kernel with them from above."""

    def __init__(self, words: list[str], bounding: int):
        self.words = words
        at, codes, weights = string_features(words)
        self.norms = np.sqrt(np.bincount(at, weights.astype(float) ** 2, len(words)))
        self.codes, row = np.unique(codes, return_inverse=True)
        self.values = np.zeros((len(self.codes) + 1, len(words)), np.float32)
        self.values[row, at] = weights / np.maximum(self.norms[at], 1e-9)
        most = self.values[:-1, :bounding].max(axis=1, initial=0)
        parts = [((self.codes >> np.uint64(s)) & np.uint64((1 << 21) - 1)).astype(np.int64) for s in (42, 21, 0)]
        small = [np.where((p == 94) | (p == 36), SPACE, classes()[np.minimum(p, 0xFFFF)]).astype(np.int64) for p in parts]
        self.table = np.zeros(1 << 18, np.float32)
        np.maximum.at(self.table, (small[0] << 12) | (small[1] << 6) | small[2], most)

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for begin in range(0, len(words), 1024):
            part = words[begin : begin + 1024]
            at, codes, weights = string_features(part)
            norm = np.sqrt(np.bincount(at, weights.astype(float) ** 2, len(part)))
            row = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[row] == codes)
            if len(hit):
                own = at[hit]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                out[begin + own[first]] = np.add.reduceat(self.values[row[hit]] * weights[hit, None], first, axis=0) / np.maximum(norm[own[first]], 1e-9)[:, None].astype(np.float32)
        return np.exp(np.float32(2 * SHARP) * (np.minimum(out, 1) - 1))

    def near(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Spans whose kernel with a bounding landmark may be NEAR or more, the text of each, and each text's number of words."""
        points, code, begin, end, own, sentence = words_of(texts)
        total = np.bincount(own, minlength=len(texts))[: len(texts)]
        if not len(begin):
            return [], np.zeros(0, int), total
        c = code.astype(np.int32)
        first, last = spans_of(begin, end, own, sentence)
        a, b = begin[first], end[last]
        bound = np.zeros(len(a), np.float32)
        for far in sorted({f for f, _ in SHAPES}):
            # subsequences inside a span, by sums up to their last letters
            got = np.zeros(len(c), np.float64)
            for mid in (m for f, m in SHAPES if f == far):
                got[far:] += self.table[(c[:-far] << 12) | (c[far - mid : -mid] << 6) | c[far:]] * DECAY ** (far + 1)
            upto = np.concatenate(([0.0], np.cumsum(got)))
            bound += upto[b] - upto[np.minimum(a + far, b)]
        for far, mid in SHAPES:
            # and those with the mark before the span, or the one after it
            at = np.flatnonzero(a - 1 + far <= b)
            p = a[at] - 1 + far
            tail = np.where(p == b[at], SPACE, c[np.minimum(p, len(c) - 1)])
            bound[at] += self.table[(c[p - mid] << 6) | tail] * np.float32(DECAY ** (far + 1))
            at = np.flatnonzero(b - far >= a)
            bound[at] += self.table[(c[b[at] - far] << 12) | (c[b[at] - mid] << 6)] * np.float32(DECAY ** (far + 1))
        close = np.flatnonzero(bound >= np.where(first == last, np.float32(NEAR), np.float32(NEAR_SPAN)) * least_norm(b - a))
        return [points[a[i] : b[i]].tobytes().decode("utf-32-le") for i in close], own[first[close]], total


class Model:
    """Landmarks, weights of the sharpened kernel with them (the Nystrom map is folded in), and a logistic curve on top."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.landmarks, self.weights, self.bias, self.curve, self.cache = landmarks, weights, bias, curve, {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def words(self, found: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(found) if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(dict.fromkeys(found))
        if new:
            parts = [marked(w) for w in new]
            score = self.landmarks.kernel([p for ps in parts for p in ps]) @ self.weights + self.bias
            best = np.maximum.reduceat(score, np.cumsum([0, *(len(p) for p in parts[:-1])]))
            self.cache.update(zip(new, best.tolist(), strict=True))
        return np.array([self.cache[w] for w in found])

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: its worst word's score, how far all its words go over 0, and the logarithm of its number of words."""
        found, own, total = self.landmarks.near(texts)
        out = np.zeros((len(texts), 3))
        out[:, 0] = self.bias
        out[:, 2] = np.log1p(total)
        if found:
            s = self.words(found)
            np.maximum.at(out[:, 0], own, s)
            np.add.at(out[:, 1], own, np.maximum(s, 0))
        out[:, 0] = np.clip(out[:, 0], -3, 3)
        out[:, 1] = np.log1p(out[:, 1])
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.features(texts) @ self.curve[:3] + self.curve[3])))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and a constant by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T * (weight * p * (1 - p)) @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """A linear support vector machine (squared hinge) by Newton steps on its support vectors; the last entry is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    reg = np.ones(len(w))
    reg[-1] = 1e-6
    for _ in range(25):
        on = y * (x @ w) < 1
        own, c = x[on], cost * weight[on] / weight.sum()
        w = np.linalg.solve(np.diag(reg / len(w)) + (own.T * c.astype(x.dtype)) @ own, own.T @ (c * y[on]))
    return w


def bend(word: str, rng: np.random.Generator) -> str:
    """word with a character put in or doubled, as training rows for bent insults."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + (word[at - 1] if rng.random() < 0.5 and at > 1 else "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]) + word[at:]


def batches_of(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about most characters, for work whose room grows with the characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of a batch's rows with their texts, few enough to work on at once."""
    for first in range(0, batch.num_rows, 256):
        rows = batch.slice(first, 256)
        every = [t or "" for t in rows.column(column).to_pylist()]
        for begin, end in batches_of(every):
            yield rows.slice(begin, end - begin), every[begin:end]


def span_hashes(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the letters from a to b."""
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def repeated_spans(texts: list[str]) -> np.ndarray:
    """Hashes of the spans that two or more of the texts have, in order; no span's text is kept."""
    found = []
    for x, y in batches_of(texts):
        points, _, begin, end, own, sentence = words_of(texts[x:y])
        first, last = spans_of(begin, end, own, sentence)
        h = span_hashes(points, begin[first], end[last])
        order = np.lexsort((h, own[first]))
        h, own = h[order], own[first][order]
        found.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))[: len(h)]])
    values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    return values[n >= 2]


def span_texts(texts: list[str], often: np.ndarray) -> Iterator[dict[str, tuple[str, ...]]]:
    """Of each text its spans whose hashes are among often, each with the words that it is made of where these are several;
    long ones are cut into windows."""
    for x, y in batches_of(texts):
        points, _, begin, end, own, sentence = words_of(texts[x:y])
        first, last = spans_of(begin, end, own, sentence)
        h = span_hashes(points, begin[first], end[last])
        at = np.flatnonzero(often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h) if len(often) else np.zeros(0, int)
        first, last = first[at], last[at]
        raw = points.tobytes()
        found: dict[int, dict[str, tuple[str, ...]]] = {}
        for i, j, d in zip(first.tolist(), last.tolist(), own[first].tolist()):
            parts = [raw[4 * begin[k] : 4 * end[k]].decode("utf-32-le") for k in range(i, j + 1)]
            for w in marked("".join(parts)):
                found.setdefault(d, {})[w] = tuple(f"^{p}$" for p in parts) if j > i else ()
        yield from found.values()


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3) -> Model | None:
    """A model from labelled documents; None if one of the labels is missing.

    Landmarks: the spans of sentences most tied to toxic documents, and the spans near them that clean documents have. The
    positive instances of a toxic document are the spans that the machine of the round before scores highest, with bent
    copies; those of the clean ones are all their spans near a landmark, and one far from all.
    """
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    pos, neg, made = Counter(), Counter(), {}
    bad = [t for t, lab in zip(texts, y, strict=True) if lab]
    often = repeated_spans(bad)
    for bag in span_texts(bad, often):
        pos.update(bag.keys())
        made.update(bag)
    pos = Counter({w: c for w, c in pos.items() if c >= 2})
    for bag in span_texts([t for t, lab in zip(texts, y, strict=True) if not lab], often):
        neg.update(bag.keys() & pos.keys())
    n1, n0 = y.sum(), len(y) - y.sum()
    tied = {w: (c / n1 - neg[w] / n0) / np.sqrt((c + neg[w] + 2) / (n1 + n0) * (1 / n1 + 1 / n0)) for w, c in pos.items()}
    # several words are a landmark if they say more than each of them
    own_tie = {w: t for w, t in tied.items() if all(t > tied.get(x, 0.0) for x in made[w])}
    best = sorted(own_tie, key=lambda w: (-own_tie[w], w))[: landmarks * 2 // 3]
    if not best:
        return None
    marks = Landmarks(best, len(best))
    parts = [(a, *marks.near(texts[a:b])[:2]) for a, b in batches_of(texts)]
    found, own = [w for _, f, _ in parts for w in f], np.concatenate([a + o for a, _, o in parts])
    del made, tied, neg, pos, often, parts
    close = Counter(p for w, d in zip(found, own, strict=True) if not y[d] for p in marked(w))
    for w in best:
        close.pop(w, None)
    marks = Landmarks(best + [w for w, _ in sorted(close.items(), key=lambda x: (-x[1], x[0]))[: landmarks - len(best)]], len(best))
    vocabulary = list(dict.fromkeys(p for w in found for p in marked(w)))
    k = {w: i for i, w in enumerate(vocabulary)}
    kernel = np.vstack([marks.kernel(vocabulary), np.zeros((1, len(marks.words)), np.float32)])
    values, vectors = np.linalg.eigh(marks.kernel(marks.words).astype(float) + 1e-4 * np.eye(len(marks.words)))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-4))).astype(np.float32)
    mapped = kernel @ whiten
    sets: list[list[int]] = [[len(vocabulary)] for _ in texts]
    for w, d in zip(found, own, strict=True):
        sets[d] += [k[p] for p in marked(w)]
    strength = np.array([max(0.0, own_tie[w]) if i < 30 else 0.0 for i, w in enumerate(best)] + [0.0] * (len(marks.words) - len(best)))
    score = kernel @ strength
    clean = Counter(j for s, lab in zip(sets, y, strict=True) if not lab for j in set(s))
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(rounds):
        worst = [score[s].max() for s in sets]
        witness = [j for s, lab, top in zip(sets, y, worst, strict=True) if lab for j in set(s) if score[j] >= max(0.5 * top, 0)]
        hard = [s[int(np.argmax(score[s]))] for s, lab in zip(sets, y, strict=True) if not lab]
        # a toxic document without any word near a landmark says nothing of words
        witness = [j for j in witness if j < len(vocabulary)] or witness
        bent = marks.kernel([bend(vocabulary[j], rng) for j in rng.choice(witness, min(len(witness), 2000)) if j < len(vocabulary)]) @ whiten
        x = np.vstack([mapped[np.concatenate([witness, hard, list(clean)])], bent])
        lab = np.concatenate([np.ones(len(witness)), -np.ones(len(hard) + len(clean)), np.ones(len(bent))])
        rest = np.array(list(clean.values()), float)
        weight = np.concatenate([np.full(len(witness), 1 / len(witness)), np.full(len(hard), 0.6 / len(hard)), 0.4 * rest / rest.sum(), np.full(len(bent), 0.5 / max(1, len(bent)))])
        w = hinge(x, lab, weight)
        model = Model(marks, (whiten @ w[:-1]).astype(np.float32), float(w[-1]), np.zeros(4))
        score = kernel @ model.weights + model.bias
    model.curve = logistic(np.vstack([model.features(texts[a:b]) for a, b in batches_of(texts)]), y, np.ones(len(y)))
    return model


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = SAMPLE) -> DataFrame:
    """(id_col, toxic, text) of at most `most` labelled documents of each label, chosen by a hash of the id among those that may be learnt from.

    An id with several labels is toxic if one of them says so; of several texts the least counts.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col(id_col))
    picked = usable.where(F.col("toxic") == 1).orderBy(order, id_col).limit(most).unionByName(usable.where(F.col("toxic") == 0).orderBy(order, id_col).limit(most))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(picked), id_col)  # at most 2 * most rows
    return rows.groupBy(id_col, "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> tuple[Model | None, float]:
    """The model, and the share of toxic labels among all usable rows (the prior that scores are calibrated to).

    One task trains on the sample, whose rows are bounded; the driver gets the model alone.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(id_col))
    n, bad = usable.agg(F.count(F.lit(1)), F.sum("toxic")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, texts = [], []
        for batch in batches:
            toxic += batch.column(0).to_pylist()
            texts += [t or "" for t in batch.column(1).to_pylist()]
        if texts:
            model = pickle.dumps(train(texts, np.array(toxic)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary()), pa.array([float(np.mean(toxic))])], names=["model", "share"])

    sample = training_rows(docs, labels, id_col, text_col, most).repartition(1).sortWithinPartitions(id_col)  # at most 2 * most rows
    found = sample.select("toxic", "text").mapInArrow(returning(run), "model binary, share double").first()
    model, share = (pickle.loads(found["model"]), found["share"]) if found else (None, 0.0)
    prior = (bad or 0) / n if n else 0.0
    if model is not None:
        model.curve[3] += np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0.0
    return model, prior


def score_toxicity(docs: DataFrame, model: Model | None, prior: float = 0.0, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of each whole text.

    Null and empty texts are scored like texts without words; without a model (no labelled rows of both kinds) every score
    is the prior. One row per row, repeated rows and null ids (held_out null) included; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks and weights: LANDMARKS words, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, texts in parts_of(batch, 2):
                score = own.score(texts) if own is not None else np.full(len(texts), prior)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(returning(run), f"{id_col} {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model | None, prior: float = 0.0, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs, all columns as they are, without the rows that score_toxicity() would predict as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as in score_toxicity()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, texts in parts_of(batch, at):
                score = own.score(texts) if own is not None else np.full(len(texts), prior)
                yield part.filter(pa.array(score < cut))

    return docs.mapInArrow(returning(run), docs.schema)
