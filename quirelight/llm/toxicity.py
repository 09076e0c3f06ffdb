"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Words are compared by their subsequences of LETTERS letters that span at most SPAN letters, the beginning of a word counting as one; every letter left
out costs a factor DECAY. The normalised kernel of two words, to the power POWER, is near 1 for an insult and its variants with letters put in, doubled or left
out, and near 0 for most others; a sentence's kernel is the sum over its different words. Words are folded first: case, accents, signs and
digits go, so "i.d.i.o.t" is "idiot", and single letters in a row ("i d i o t") are one word. A longer word than LONGEST is
as like a landmark as its likest stretch.

Labelled documents are cut into sentences, equal ones are one, and a sentence that a clean document has is clean. The landmarks are words of those sentences:
words that are significantly more frequent in toxic ones, kept apart by a pivoted Cholesky factor of their kernel matrix W, and frequent words of
clean ones. A sentence has the features W^(-1/2) k(landmarks, sentence), on which a linear support vector machine (squared hinge, Newton's method in the
primal) is trained. A toxic document says that some of its sentences are toxic, not which: after each round those that the machine finds clean are
dropped (multiple-instance training). A document's score is its most toxic sentence's through a logistic function of the training documents.
As the machine is linear in the kernel, a word's part in a sentence is one number, worked out once for each distinct word.

Training takes at most SAMPLE documents of each label, in the order of a hash of doc_id, and of those longer than SAMPLE_CHARS the beginning
(documented bounds; shorter ones go first). Scoring reads every word of every text.

Defined results: a text that is null, empty or without letters has the score of a sentence of no words. Without training documents of both
labels every score is 0. Rows that repeat a doc_id are scored each for itself; in training a doc_id counts once, with its first text by a hash, as toxic
if any of its labels says so. Labels other than 0 and 1, and rows without a doc_id, are not learned from. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stage

LETTERS, SPAN, DECAY, POWER = 3, 5, 0.8, 3
PATTERNS = [(0, *p) for p in combinations(range(1, SPAN), LETTERS - 1)]
#: Letters of a word that are compared at once; single letters in a row that make a word; words of a sentence.
LONGEST, ROW, SENTENCE = 32, 3, 32
#: Documents of each label, and code points of each, that are learned from at most.
SAMPLE, SAMPLE_CHARS = 1500, 8192
#: Words that may be landmarks, landmarks kept of them, clean landmarks; what a word's G statistic must reach, and words kept whatever theirs.
WORDS, LANDMARKS, CLEAN, SIGNIFICANT, LEAST = 1000, 128, 32, 20.0, 16
ROUNDS, COST = 4, 1.0
#: Code points scored at once, words compared at once and words that a Python worker remembers.
PIECE, CHUNK, REMEMBER = 1 << 20, 8192, 400_000
#: Symbol of the beginning of a word.
BEGIN = 31


def _alphabet() -> np.ndarray:
    """Code point to symbol: 1 to 26 are letters without case and accent, 27 to 30 other letters; 0 is left out, 255 ends a word of a list."""
    out = np.zeros(0x3000, np.uint8)
    for cp in range(len(out)):
        base = unicodedata.normalize("NFKD", chr(cp).lower())[:1]
        out[cp] = ord(base) - 96 if "a" <= base <= "z" else 27 + cp % 4 if chr(cp).isalpha() else 0
    out[10] = 255
    return out


ALPHABET = _alphabet()


def folded(tokens: list[str]) -> list[bytes]:
    """The symbols of each token's letters; tokens hold no line feed."""
    if not tokens:
        return []
    cp = np.frombuffer(("\n".join(tokens)).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(cp < len(ALPHABET), ALPHABET[np.minimum(cp, len(ALPHABET) - 1)], (27 + cp % 4).astype(np.uint8))
    return s[s > 0].tobytes().split(b"\xff")


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, key and share of each subsequence of LETTERS letters: sorted by word and key, shares of a word have norm 1."""
    lens = np.array([len(w) for w in words], np.int64)
    room = lens + 1 + SPAN
    at = np.cumsum(room) - room
    s = np.zeros(room.sum() + SPAN, np.int32)
    s[at] = BEGIN
    s[np.arange(lens.sum()) + np.repeat(at + 1 - (np.cumsum(lens) - lens), lens)] = np.frombuffer(b"".join(words), np.uint8)
    n = len(s) - SPAN
    owner = np.repeat(np.arange(len(words)), room)
    codes, weights = [], []
    for p in PATTERNS:
        key, fine = s[:n], s[:n] > 0
        for k in p[1:]:
            key, fine = (key << 5) | s[k : k + n], fine & (s[k : k + n] > 0)
        where = np.flatnonzero(fine)
        codes.append(owner[where] << 5 * LETTERS | key[where])
        weights.append(np.full(len(where), DECAY ** (p[-1] - LETTERS + 1)))
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    weight = np.bincount(place, np.concatenate(weights), len(code))
    word, key = code >> 5 * LETTERS, code & (1 << 5 * LETTERS) - 1
    norm = np.sqrt(np.bincount(word, weight * weight, len(words)))
    return word, key, weight / norm[word]


class Kernel:
    """The kernel of any word with each landmark."""

    def __init__(self, landmarks: list[bytes]):
        self.n = len(landmarks)
        word, key, share = subsequences(landmarks)
        known = np.unique(key)
        self.row = np.full(1 << 5 * LETTERS, -1, np.int32)
        self.row[known] = np.arange(len(known))
        self.shares = np.zeros((len(known), self.n), np.float32)
        self.shares[self.row[key], word] = share

    def _short(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.n), np.float32)
        word, key, share = subsequences(words)
        row = self.row[key]
        hit = row >= 0
        word, row, share = word[hit], row[hit], share[hit].astype(np.float32)
        if len(word):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[word[first]] = np.add.reduceat(self.shares[row] * share[:, None], first, axis=0)
        return out**POWER

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Words by landmarks."""
        out = np.zeros((len(words), self.n), np.float32)
        some = [k for k, w in enumerate(words) if LETTERS <= len(w) + 1 <= LONGEST + 1]
        for k in range(0, len(some), CHUNK):
            out[some[k : k + CHUNK]] = self._short([words[i] for i in some[k : k + CHUNK]])
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                step = LONGEST // 2 * CHUNK
                for k in range(0, len(w), step):
                    part = w[k : k + step + LONGEST // 2]
                    out[i] = np.maximum(out[i], self._short([part[j : j + LONGEST] for j in range(0, max(1, len(part) - LONGEST // 2), LONGEST // 2)]).max(axis=0))
        return out


class Words:
    """Distinct folded words by number, of all tokens seen so far."""

    def __init__(self) -> None:
        self.tokens: dict[str, int] = {}
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.of = np.zeros(0, np.int32)
        self.stop = np.zeros(0, bool)

    def number(self, words: list[bytes]) -> list[int]:
        out = []
        for w in words:
            k = self.numbers.setdefault(w, len(self.words))
            if k == len(self.words):
                self.words.append(w)
            out.append(k)
        return out

    def learn(self, tokens: list[str]) -> None:
        new = list(set(tokens).difference(self.tokens))
        if new:
            self.tokens.update(zip(new, range(len(self.of), len(self.of) + len(new))))
            self.of = np.concatenate([self.of, np.array(self.number(folded(new)), np.int32)])
            self.stop = np.concatenate([self.stop, np.array([t.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", "…") for t in new])])


def pieces(text: str) -> Iterator[str]:
    """A text cut at white space into pieces of PIECE code points, about."""
    at = 0
    while len(text) - at > PIECE:
        gap = re.compile(r"\s").search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def sentences(texts: list[str], seen: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different word of each sentence (sentence and number of the word, in order), and the text of each sentence; a text has one at least."""
    tokens: list[str] = []
    lens, whose = [], []
    for k, text in enumerate(texts):
        for line in text.splitlines() or [""]:
            own = line.split()
            tokens += own
            lens.append(len(own))
            whose.append(k)
    seen.learn(tokens)
    token = np.fromiter(map(seen.tokens.__getitem__, tokens), np.int64, len(tokens))
    word = seen.of[token]
    length = np.array(lens)
    line = np.repeat(np.arange(len(lens)), length)
    opens = np.append(True, (line[1:] != line[:-1]) | seen.stop[token][:-1])[: len(line)]
    # single letters in a row are words too, where the first of them stands
    single = np.fromiter((len(w) == 1 for w in seen.words), bool, len(seen.words))[word]
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])) != 0).reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] >= ROW]
        for a, b in edge.tolist():
            cut = [a, *(np.flatnonzero(line[a + 1 : b] != line[a : b - 1]) + a + 1).tolist(), b]
            for i, j in zip(cut, cut[1:]):
                if j - i >= ROW:
                    word[i] = seen.number([b"".join(seen.words[w] for w in word[i:j].tolist())])[0]
                    opens[i + 1 : j] = False
    place = np.arange(len(word))
    part = place - np.maximum.accumulate(np.where(opens, place, 0))
    opens |= part % SENTENCE == 0
    # a line without words is a sentence of none
    number = np.cumsum(opens) - 1
    text = np.concatenate([np.array(whose, np.int64)[line[opens]], np.flatnonzero(np.bincount(np.array(whose, np.int64), length, len(texts)) == 0)]).astype(np.int64)
    code = np.unique(number.astype(np.int64) << 32 | word)
    return code >> 32, (code & 0xFFFFFFFF), text


class Machine:
    """A trained machine: landmarks, their weights, the bias, and the logistic function of a document's best sentence."""

    def __init__(self, landmarks: list[bytes], beta: np.ndarray, bias: float, slope: float, offset: float):
        self.key = uuid.uuid4().hex
        self.landmarks, self.beta, self.bias, self.slope, self.offset = landmarks, beta, bias, slope, offset

    def _worker(self) -> tuple[Kernel, dict]:
        return stage.sole((Machine, self.key), lambda: (Kernel(self.landmarks), {"seen": Words(), "weight": np.zeros(0)}))

    def best(self, texts: list[str]) -> np.ndarray:
        """The value of each text's most toxic sentence."""
        kernel, held = self._worker()
        if len(held["seen"].tokens) > REMEMBER:
            held |= {"seen": Words(), "weight": np.zeros(0)}
        number, word, text = sentences(texts, held["seen"])
        new = held["seen"].words[len(held["weight"]) :]
        if new:
            held["weight"] = np.concatenate([held["weight"], *(kernel(new[k : k + CHUNK]) @ self.beta for k in range(0, len(new), CHUNK))])
        value = np.bincount(number, held["weight"][word], len(text)) + self.bias
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, text, value)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.best(texts) + self.offset, -700, 700)))


def trained_svm(x: np.ndarray, sign: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + COST / 2 sum max(0, 1 - sign f)^2, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-6)
    loss = lambda w: (ridge * w * w).sum() + COST * (np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    w, now = start, loss(start)
    for _ in range(30):
        near = sign * (x @ w) < 1
        move = np.linalg.solve(np.diag(ridge) + COST * (x[near].T @ x[near]).astype(float), COST * (x[near].T @ sign[near])) - w
        step = 1.0
        while (then := loss(w + step * move)) > now and step > 1e-3:
            step /= 2
        if step <= 1e-3 or now - then < 1e-6 * now:
            break
        w, now = w + step * move, then
    return w


def logistic(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic function, with a weak prior on the slope."""
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6]), x.T @ (toxic - p) - [0.1 * w[0], 0])
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def g_statistic(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """2 log likelihood ratio of a of na against b of nb; 0 where a is not the more frequent."""
    total = (a + b) / (na + nb)
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0)
    g = 2 * (part(a, na * total) + part(b, nb * total) + part(na - a, na * (1 - total)) + part(nb - b, nb * (1 - total)))
    return np.where(a > na * total, g, 0)


def train(texts: list[str], toxic: np.ndarray) -> Machine:
    """A machine from texts and their labels (0 or 1)."""
    none = Machine([], np.zeros(0), 0.0, 0.0, 0.0)
    if not len(texts) or toxic.min() == toxic.max():
        return none
    seen = Words()
    number, word, text = sentences(texts, seen)
    # equal sentences are one; clean if any is
    cut = np.searchsorted(number, np.arange(len(text) + 1))
    named: dict[bytes, int] = {}
    same = np.array([named.setdefault(word[a:b].tobytes(), len(named)) for a, b in zip(cut, cut[1:])])
    clean = np.ones(len(named), bool)
    clean[:] = np.bincount(same, toxic[text] == 0, len(named)) > 0
    _, first = np.unique(same, return_index=True)
    keep = np.zeros(len(text), bool)
    keep[first] = True
    mine = keep[number]
    s, w = same[number[mine]], word[mine]
    counts = np.array([np.bincount(w[clean[s] == k], minlength=len(seen.words)) for k in (False, True)], float)
    fair = np.array([4 <= len(x) <= LONGEST for x in seen.words])
    g = np.where(fair, g_statistic(counts[0], counts[1], max(1, int((~clean).sum())), max(1, int(clean.sum()))), 0)
    order = np.lexsort((np.array(seen.words, object), -g))[:WORDS]
    telling = [k for i, k in enumerate(order.tolist()) if g[k] > 0 and (g[k] >= SIGNIFICANT or i < LEAST)]
    if not telling:
        return none
    some = [seen.words[k] for k in telling]
    matrix, weight = Kernel(some)(some).astype(float), g[telling]
    rest, factor, chosen = matrix.diagonal().copy(), np.zeros((len(some), 0)), []
    while len(chosen) < min(LANDMARKS, len(some)) and (k := int(np.argmax(rest * weight))) >= 0 and rest[k] > 0.05:
        column = (matrix[:, k] - factor @ factor[k]) / np.sqrt(rest[k])
        factor, rest = np.concatenate([factor, column[:, None]], axis=1), np.maximum(0, rest - column**2)
        rest[k] = 0
        chosen.append(k)
    usual = [k for k in np.lexsort((np.array(seen.words, object), -counts[1]))[: 20 * CLEAN].tolist() if fair[k] and g[k] < SIGNIFICANT][:CLEAN]
    landmarks = [some[k] for k in chosen] + [seen.words[k] for k in usual]
    kernel = Kernel(landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    # the features of each sentence, from those of its words
    each = np.concatenate([kernel(seen.words[k : k + CHUNK]) @ root.astype(np.float32) for k in range(0, len(seen.words), CHUNK)])
    x = np.zeros((len(named), len(landmarks)), np.float32)
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))[: len(s)]
    for k in range(0, len(begin), CHUNK):
        a, b = begin[k], begin[k + CHUNK] if k + CHUNK < len(begin) else len(s)
        x[s[begin[k : k + CHUNK]]] = np.add.reduceat(each[w[a:b]], begin[k : k + CHUNK] - a, axis=0)
    sign, used, beta = np.where(clean, -1.0, 1.0), np.ones(len(named), bool), np.zeros(len(landmarks) + 1)
    for _ in range(ROUNDS):
        beta = trained_svm(x[used], sign[used], beta)
        value = x @ beta[:-1] + beta[-1]
        now = clean | (value > 0)
        if (now == used).all() or now.all() == clean.all():
            break
        used = now
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, value[same])
    return Machine(landmarks, root @ beta[:-1], float(beta[-1]), *logistic(best, toxic))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Machine:
    """A machine from docs (doc_id, text) and labels (doc_id, toxic), on at most `sample` documents of each label."""
    spark = docs.sparkSession
    stage.ship(spark)
    wanted = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # one text of a doc_id, cut before it travels
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.length("text") > chars).alias("long"), F.substring("text", 1, chars).alias("text"))
    rows = texts.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.struct("long", "text"), F.struct("long", F.xxhash64("text"), "text")).alias("t"))
    rows = stage.written(spark, rows.select("doc_id", "toxic", "t.long", "t.text"), "labelled")
    # ids first, in executors: a limit that is collected at once would bring each task's own first rows to the driver
    first = [rows.where(F.col("toxic") == k).select("doc_id", "long").orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id") for k in (0, 1)]
    chosen = stage.written(spark, first[0].unionByName(first[1]), "sample")
    taken = rows.join(F.broadcast(chosen), "doc_id").select("toxic", "text").collect()  # at most sample a label
    taken.sort(key=lambda r: (r["toxic"], r["text"]))
    return train([r["text"] for r in taken], np.array([r["toxic"] for r in taken], int))


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns keep of docs, which are not text, with score."""
    spark = docs.sparkSession
    stage.ship(spark)
    shared = spark.sparkContext.broadcast(machine)  # landmarks and their weights: bounded by parameters
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = np.full(b.num_rows, -np.inf)
            held: list[str] = []
            whose: list[int] = []
            size = 0

            def flush() -> None:
                nonlocal held, whose, size
                if held:
                    np.maximum.at(found, whose, m.scores(held))
                held, whose, size = [], [], 0

            texts = b.column(b.num_columns - 1)
            for k in range(b.num_rows):
                for piece in pieces(texts[k].as_py()):
                    held.append(piece)
                    whose.append(k)
                    size += len(piece)
                    if size > PIECE:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(found, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, f"{schema}, score double")
