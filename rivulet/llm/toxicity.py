"""Toxicity by a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

Documents are bags of words (multiple instances): a document is as toxic as its worst word, and a
label says only that some word of it is bad. The kernel of two words counts the three-character
subsequences that they share, each weighted by 0.5 per skipped character, so an insult with letters
put in or left out stays near. Landmarks span the space in which the machine is trained; as the kernel
has finitely many features, the trained machine folds into one weight per subsequence.

Insults whose words are all harmless are learnt from the toxic documents that no word gives away: windows of two to
five words are further instances of the same kernel, with a machine of their own. A text's windows are scored from running
sums over its characters, so a window costs a few additions whatever its length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import with_columns_by
from rivulet.plans.fixpoint import cut

#: Kernel: longest reach of a subsequence, weight of a skipped character, characters of one instance.
REACH, DECAY, WIDTH = 6, 0.5, 24
#: Bounds of the fit: labelled documents of each class, words of each class, landmarks.
SAMPLE, WORDS, LANDMARKS, SEED = 3_000, 4_000, 384, 8
#: Words that a worker remembers; then it starts anew.
REMEMBER = 100_000
#: Windows of words: fewest and most words, characters of the longest (with two marks between words), words handled at once.
SPAN, PHRASE_WIDTH, STRETCH = (2, 5), 64, 4_096
#: Families of toxic documents that a phrase must explain, and their least share; its share may be so many times that of clean ones.
FAMILIES, OFTEN, RATIO = 8, 0.01, 10.0

_CLASSES = 64
_SKIPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, REACH) for b in range(1, REACH - a)]
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\w\s+){2,}\w(?!\S)")
#: Digits and signs read as letters. Fixed values.
_LOOKS = str.maketrans("013457", "oieast")


def _code_table() -> np.ndarray:
    """Class of each code point below 0x10000: 0 padding, 1 start, 2 end, letters, a digit, and residues for the rest."""
    table = (30 + np.arange(0x10000) % 34).astype(np.int32)
    table[[0, 2, 3]] = 0, 1, 2
    table[ord("a") : ord("z") + 1] = 3 + np.arange(26)
    table[ord("0") : ord("9") + 1] = 29
    return table


_TABLE = _code_table()


def instances(text: str) -> set[str]:
    """The words that are scored: lower case, without marks around or inside; single letters in a row also count joined.

    Every character of a word lies in an instance: a word longer than WIDTH gives overlapping pieces.
    """
    low = text.lower()
    words = set(low.split())
    if any(len(w) == 1 for w in words):
        words |= {"".join(m[0].split()) for m in _SPACED.finditer(low)}
    return words


def pieces(word: str) -> list[str]:
    """A raw word as instances for the kernel."""
    if not word.isalpha():
        word = _INNER.sub("", word.translate(_LOOKS) if not word.isdigit() else "0")
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def encode(words: Sequence[str]) -> np.ndarray:
    """Classes of the characters of each word or phrase, between a start and an end mark, padded with 0."""
    width = max(WIDTH, max(map(len, words), default=0)) + 2
    marked = np.array([f"\x02{w}\x03" for w in words], dtype=f"<U{width}")
    points = marked.view("<u4").reshape(len(words), width) if len(words) else np.zeros((0, width), "<u4")
    return _TABLE[np.minimum(points, 0xFFFF)]


def _length_norms() -> np.ndarray:
    """Size of a word's feature vector by its length, repeats aside: makes words of all lengths comparable."""
    return np.sqrt([max(1e-9, sum(w * w * max(0, n - a - b) for a, b, w in _SKIPS)) for n in range(PHRASE_WIDTH + 3)])


_NORMS = _length_norms()


def _subsequences(codes: np.ndarray):
    """Per skip pattern: its weight and the feature numbers of all words; features that end in padding are multiples of 64."""
    for a, b, weight in _SKIPS:
        n = codes.shape[1] - a - b
        yield weight, (codes[:, :n] * _CLASSES + codes[:, a : a + n]) * _CLASSES + codes[:, a + b :]


def _norm_of(codes: np.ndarray) -> np.ndarray:
    return _NORMS[np.count_nonzero(codes, axis=1)]


def kernel(words: Sequence[str], landmarks: Sequence[str]) -> np.ndarray:
    """Kernel matrix of words and landmarks."""
    marks, out = encode(landmarks), np.zeros((len(words), len(landmarks)))
    used = np.unique(np.concatenate([i.ravel() for _, i in _subsequences(marks)]))
    used = used[used % _CLASSES != 0]
    column = np.full(_CLASSES**3, len(used), dtype=np.int64)
    column[used] = np.arange(len(used))
    phi = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
    for weight, idx in _subsequences(marks):
        np.add.at(phi, (column[idx], np.arange(len(landmarks))[:, None]), weight)
    phi[-1] = 0
    phi /= _norm_of(marks)
    for at in range(0, len(words), 512):
        codes = encode(words[at : at + 512])
        for weight, idx in _subsequences(codes):
            idx = column[idx]
            for k in np.flatnonzero((idx != len(used)).any(axis=0)):
                out[at : at + 512] += weight * phi[idx[:, k]]
        out[at : at + 512] /= _norm_of(codes)[:, None]
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(x), dtype=bool)
    for _ in range(rounds):
        xa = x[active]
        w = np.linalg.solve(ridge + xa.T @ (xa * cost[active, None]), xa.T @ (cost[active] * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Machine:
    """Weight per subsequence, bias, and the line from margins to log odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    phrases: Machine | None = None

    def margins(self, words: Sequence[str]) -> np.ndarray:
        codes = encode(words)
        total = np.zeros(len(words))
        for weight, idx in _subsequences(codes):
            total += weight * self.weights[idx].sum(axis=1)
        return total / _norm_of(codes) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.shift, -500, 500)))


def train(bad: Sequence[str], good: Sequence[str], landmarks: int = LANDMARKS, c: float = 10.0, seed: int = SEED) -> Machine:
    """Fit on words of either class: whiten the kernel on the landmarks, fit the machine there, fold it back."""
    if not len(bad) or not len(good):
        return Machine(np.zeros(_CLASSES**3, dtype=np.float32), -1.0)
    rng = np.random.default_rng(seed)
    half = landmarks // 2
    marks = sorted(set(rng.permutation(bad)[:half].tolist()) | set(rng.permutation(good)[: landmarks - half].tolist()))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    strong = values > 1e-6 * values.max()
    white = vectors[:, strong] / np.sqrt(values[strong])
    words = [*bad, *good]
    x = np.hstack([kernel(words, marks) @ white, np.ones((len(words), 1))])
    y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
    w = squared_hinge(x, y, np.where(y > 0, c * max(1.0, len(good) / len(bad)), c))
    beta = white @ w[:-1]
    weights = np.zeros(_CLASSES**3)
    codes = encode(marks)
    share = beta / _norm_of(codes)
    for weight, idx in _subsequences(codes):
        np.add.at(weights, idx.ravel(), np.repeat(weight * share, idx.shape[1]))
    weights[::_CLASSES] = 0
    return Machine(weights.astype(np.float32), float(w[-1]))


def witnesses(bags: Sequence[Sequence[str]], clean: Counter[str], n_clean: int, often: float = 0.01, least: int = 8, ratio: float = 10.0) -> tuple[list[str], set[str]]:
    """Words that explain the toxic bags, and the words of clean bags that may be bad; `clean` counts the clean bags of each word.

    Near copies count once: bags that agree in two minimum hashes of their words are one family. A
    word of no clean bag may explain; one of some clean bags may if it is in `least` families and its share of families is at
    least `ratio` times its share of clean bags, smoothed by half a bag. Every word of no clean bag in at least `often` of the families
    (and in `least`) is taken; then, again and again, the word in most families that explains two not yet explained.
    """
    keys = [tuple(min(zlib.crc32(w.encode(), salt) for w in bag) for salt in (1, 2)) for bag in bags if bag]
    n_families = len(set(keys))

    def telling(w: str, n: int) -> bool:
        return not clean[w] or (n >= least and n / n_families >= ratio * (clean[w] + 0.5) / (n_clean + 1))

    maybe = {w for w, n in Counter(w for bag in bags for w in set(bag)).items() if telling(w, n)}  # no word is in more families than bags
    families: dict[tuple[int, int], set[str]] = {}
    for key, bag in zip(keys, (b for b in bags if b)):
        families.setdefault(key, set()).update(w for w in bag if w in maybe)
    where: dict[str, set[int]] = {}
    for i, words in enumerate(families.values()):
        for w in words:
            where.setdefault(w, set()).add(i)
    where = {w: found for w, found in where.items() if telling(w, len(found))}
    order = sorted(where, key=lambda w: (-len(where[w]), w))
    out = [w for w in order if not clean[w] and len(where[w]) >= max(least, often * n_families)]
    left = set(range(n_families)).difference(*[where[w] for w in out])
    taken = set(out)
    for w in order:
        gain = where[w] & left
        if w not in taken and len(gain) >= 2:
            out.append(w)
            left -= gain
    return out, {w for w in order if clean[w]}


def _bag(text: str | None) -> set[str]:
    return {p for w in instances(text or "") for p in pieces(w)} - {""}


class Scorer:
    """Margins of whole texts; remembers a bounded number of words."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def margins(self, texts: Sequence[str | None]) -> list[float]:
        bags = [instances(t or "") for t in texts]
        new = [w for w in set().union(*bags) if w not in self.known] if bags else []
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, list(set().union(*bags))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            split = [pieces(w) for w in part]
            scores = self.machine.margins([p for ps in split for p in ps])
            first = np.cumsum([0] + [len(ps) for ps in split])[:-1]
            self.known.update(zip(part, np.maximum.reduceat(scores, first).tolist()))
        return [max(map(self.known.__getitem__, bag), default=self.machine.bias) for bag in bags]


def spoken(text: str | None, known: dict[str, str]) -> list[str]:
    """The words of a text in order, as the kernel sees them; `known` remembers a bounded number of words."""
    out = []
    for w in (text or "").lower().split():
        if not w.isalpha():
            plain = known.get(w)
            if plain is None:
                if len(known) > REMEMBER:
                    known.clear()
                plain = known[w] = _INNER.sub("", w.translate(_LOOKS) if not w.isdigit() else "0")
            w = plain
        if w:
            out.append(w)
    return out


def stretches(words: list[str]) -> Iterator[list[str]]:
    """Parts of bounded size that together hold every window of words."""
    step = STRETCH - SPAN[1] + 1
    for at in range(0, len(words) - SPAN[0] + 1, step):
        yield words[at : at + STRETCH]


def phrases_in(words: list[str]) -> Iterator[str]:
    """All windows of words as instances of the kernel: words lie between their marks."""
    for k in range(SPAN[0], SPAN[1] + 1):
        for at in range(len(words) - k + 1):
            p = "\x03\x02".join(words[at : at + k])
            if len(p) <= PHRASE_WIDTH:
                yield p


def window_margins(machine: Machine, words: list[str], part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margin, first word and number of words of every window that `phrases_in` gives, in its order; of windows inside one part where parts are numbered."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(size)
    starts = ends - size
    codes = _TABLE[np.minimum(np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), "<u4"), 0xFFFF)].astype(np.intp)
    sums: dict[int, np.ndarray] = {}
    for a in range(1, REACH - 1):
        pair = (codes[:-a] * _CLASSES + codes[a:]) * _CLASSES
        for b in range(1, REACH - a):
            got = machine.weights.take(pair[: max(0, len(codes) - a - b)] + codes[a + b :])
            got *= np.float32(DECAY ** (a + b - 2))
            sums[a + b] = sums[a + b] + got if a + b in sums else got
    sums = {reach: np.concatenate([[0.0], np.cumsum(got, dtype=np.float64)]) for reach, got in sums.items()}
    found = []
    for k in range(SPAN[0], SPAN[1] + 1):
        first = np.arange(max(0, len(words) - k + 1))
        last = first + k - 1
        fits = ends[last] - starts[first] <= PHRASE_WIDTH + 2
        first = first[fits if part is None else fits & (part[first] == part[last])]
        p, q = starts[first], ends[first + k - 1]
        total = sum((run[q - reach] - run[p] for reach, run in sums.items()), np.zeros(len(first)))
        found.append((total / _NORMS[q - p] + machine.bias, first, np.full(len(first), k)))
    return tuple(np.concatenate(each) for each in zip(*found))


def phrase_margins(machine: Machine, texts: Sequence[str | None], known: dict[str, str]) -> np.ndarray:
    """The highest margin of the windows of each text; texts without a window have the bias. Short texts are scored together."""
    out = np.full(len(texts), -np.inf)
    words: list[str] = []
    text_of_part: list[int] = []
    sizes: list[int] = []

    def flush():
        part = np.repeat(np.arange(len(sizes)), sizes)
        margin, first, _ = window_margins(machine, words, part)
        np.maximum.at(out, np.array(text_of_part)[part[first]], margin)
        words.clear(), text_of_part.clear(), sizes.clear()

    for i, t in enumerate(texts):
        for stretch in stretches(spoken(t, known)):
            words.extend(stretch)
            text_of_part.append(i)
            sizes.append(len(stretch))
            if len(words) >= STRETCH:
                flush()
    if words:
        flush()
    return np.where(np.isinf(out), machine.bias, out)


def _phrase_rows(docs: DataFrame, make: Callable[[], Callable[[str | None, int], tuple[Sequence, Sequence]]], value: str) -> DataFrame:
    """Rows (phrase, value) that `make` finds in each text; `family` tells near copies apart from other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, schema = make(), pa.schema([("phrase", pa.string()), ("value", pa.float64() if value == "double" else pa.int64())])
        for batch in batches:
            for text, family in zip(batch.column("text").to_pylist(), batch.column("family").to_pylist()):
                for phrases, values in fn(text, family):
                    yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(values, schema.field(1).type)], schema=schema)

    return docs.select("text", "family").mapInArrow(run, f"phrase string, value {value}")


def _families(texts: Sequence[str | None]) -> list[int]:
    """A number that near copies share: two minimum hashes of the words."""
    out = []
    for t in texts:
        bag = [w.encode() for w in instances(t or "")] or [b""]
        out.append(min(zlib.crc32(w, 1) for w in bag) << 31 ^ min(zlib.crc32(w, 2) for w in bag))
    return out


def fit_phrases(chosen: DataFrame, machine: Machine, odds: float, words: int = WORDS) -> Machine | None:
    """A machine on windows of words, from the toxic documents (key, toxic, text) that the words' machine misses; None where no phrase tells.

    A phrase tells if it is in FAMILIES of the missed families and in OFTEN of them, and if its share of them is RATIO times its share of clean documents.
    All windows of all chosen documents count. At most `words` telling phrases and as many others, and half as many again that come nearest, train the machine; only these
    reach the driver. A quarter of the documents gives the line from margins to log odds.
    """
    family = T.StructField("family", T.LongType())
    rows = cut(with_columns_by(score(chosen, machine), ["text"], lambda: lambda texts: [_families(texts)], [family]).where("toxic = 0 or predicted = 0"))
    on_line = F.crc32(F.col("key").cast("string").cast("binary")) % 4 == 1
    missed, clean = rows.where((F.col("toxic") == 1) & ~on_line), rows.where((F.col("toxic") == 0) & ~on_line)
    n_missed, n_clean = missed.agg(F.count_distinct("family")).first()[0], clean.count()
    if n_missed < FAMILIES or not n_clean:
        return None

    def windows(wanted: set[str] | None = None, smallest: int | None = None):
        def make():
            known: dict[str, str] = {}

            def one(text, family):
                for part in stretches(spoken(text, known)):
                    found = set(phrases_in(part))
                    found = found if wanted is None else found & wanted
                    if smallest is not None and len(found) > smallest:
                        found = heapq.nsmallest(smallest, found, key=lambda p: zlib.crc32(p.encode()))
                    yield list(found), [family] * len(found)

            return one

        return make

    counted = _phrase_rows(missed, windows(), "long").groupBy("phrase").agg(F.count_distinct("value").alias("n"))
    counted = counted.where(F.col("n") >= max(FAMILIES, OFTEN * n_missed)).orderBy(F.desc("n"), "phrase").limit(10 * words)
    seen = {r["phrase"]: r["n"] for r in counted.collect()}
    if not seen:
        return None
    at = clean.withColumn("family", F.monotonically_increasing_id())  # clean documents count one by one
    quoted = {r["phrase"]: r["n"] for r in _phrase_rows(at, windows(set(seen)), "long").groupBy("phrase").agg(F.count_distinct("value").alias("n")).collect()}
    bad = [p for p, n in seen.items() if not quoted.get(p) or n / n_missed >= RATIO * (quoted[p] + 0.5) / (n_clean + 1)][:words]
    if not bad:
        return None
    own = set(bad)
    by_hash = [F.crc32(F.col("phrase").cast("binary")), "phrase"]
    others = _phrase_rows(clean, windows(smallest=words), "long").select("phrase").distinct().orderBy(*by_hash).limit(words)
    good = {r["phrase"] for r in others.collect()} - own
    if not good:
        return None
    first = train(bad, sorted(good))

    def highest():
        known: dict[str, str] = {}

        def one(text, family):
            for part in stretches(spoken(text, known)):
                margin, start, size = window_margins(first, part)
                for i in np.argsort(-margin, kind="stable")[:8]:
                    yield ["\x03\x02".join(part[start[i] : start[i] + size[i]])], [margin[i]]

        return one

    nearest = _phrase_rows(clean, highest, "double").groupBy("phrase").agg(F.max("value").alias("margin")).orderBy(F.desc("margin"), "phrase").limit(words // 2)
    out = train(bad, sorted(good | ({r["phrase"] for r in nearest.collect()} - own)))
    margin = T.StructField("margin", T.DoubleType())

    def all_margins():
        known: dict[str, str] = {}
        return lambda texts: [phrase_margins(out, texts, known).tolist()]

    line = with_columns_by(rows.where(on_line).select("toxic", "text"), ["text"], all_margins, [margin]).select("toxic", "margin").collect()
    got = {kind: np.array([r["margin"] for r in line if r["toxic"] == kind]) for kind in (0, 1)}
    if not len(got[0]) or not len(got[1]):
        return None
    out.slope, out.shift = sigmoid_line(got[1], got[0], odds * rows.where("toxic = 1").count() / max(1, chosen.where("toxic = 1").count()))
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, holdout: int = 5) -> Machine:
    """Fit on labelled documents whose CRC-32 of the key is not divisible by `holdout`.

    At most `sample` documents of each class, picked by a hash of the key, come to the driver as sets of
    words. Three quarters of them give words, the others the line from margins to probabilities, in which classes
    weigh as in all labelled rows. The good words nearest to the bad ones are added in a second round of training. Toxic documents
    that the words miss then teach phrases (`fit_phrases`).
    Without labelled documents of both kinds, and so with an empty table on either side, nothing is toxic. Labels of null keys count as those of an empty key;
    where labels repeat a key the higher one counts. Of documents that repeat a key the one with the smallest text is taken; rows that repeat as a
    whole make no difference.
    """
    name = F.coalesce(labels[key].cast("string"), F.lit(""))
    known = labels.where(F.col("toxic").isNotNull() & (F.crc32(name.cast("binary")) % holdout != 0)).groupBy(F.col(key).alias("key")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Machine(np.zeros(_CLASSES**3, dtype=np.float32), -1.0, 1.0, -5.0)
    by_hash = [F.xxhash64(F.col("key").cast("string")), "key"]
    picked = known.where("toxic = 1").orderBy(*by_hash).limit(sample).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(sample))
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    chosen = cut(source.join(F.broadcast(picked), "key").groupBy("key", "toxic").agg(F.min("text").alias("text")))  # at most twice `sample` keys
    rows = with_columns_by(chosen, ["text"], lambda: lambda texts: [[sorted(_bag(t)) for t in texts]], [T.StructField("words", T.ArrayType(T.StringType()))])
    table = rows.select("key", "toxic", "words").orderBy(*by_hash).select("toxic", "words").toArrow()
    pool: dict[str, str] = {}  # one string object per word, not per document
    bags: dict[int, list[list[str]]] = {0: [], 1: []}
    for batch in table.to_batches(max_chunksize=64):
        for kind, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bags[kind].append([pool.setdefault(w, w) for w in words])
    del table, pool
    fits = {kind: [b for i, b in enumerate(own) if i % 4] for kind, own in bags.items()}
    lines = {kind: own[::4] for kind, own in bags.items()}
    clean = Counter(w for b in fits[0] for w in b)
    bad, quoted = witnesses(fits[1], clean, len(fits[0]))
    bad = bad[:WORDS]
    rng = np.random.default_rng(SEED)
    every = [w for w in rng.permutation(sorted(clean)).tolist() if w not in quoted] if clean else []  # quoted words are no examples of good ones
    good = set(every[:WORDS])
    every.sort()
    machine = train(bad, sorted(good))
    if every and bad:
        known_bad = set(bad)
        for bag in fits[1]:  # a bag without a known bad word adds its worst word, if the machine is sure of it
            if known_bad.isdisjoint(bag) and (rest := [w for w in bag if w not in clean]):
                margin = machine.margins(rest)
                if margin.max() > 0.5:
                    bad.append(rest[int(margin.argmax())])
        bad = list(dict.fromkeys(bad))
        near = np.argsort(-np.concatenate([machine.margins(every[at : at + 20_000]) for at in range(0, len(every), 20_000)]))[: WORDS // 2]
        machine = train(bad, sorted(good | {every[i] for i in near}))
    margin = {kind: np.array([machine.margins(b).max() if b else machine.bias for b in own]) for kind, own in lines.items()}
    if len(margin[0]) and len(margin[1]):
        machine.slope, machine.shift = sigmoid_line(margin[1], margin[0], counts[1] / counts[0])
        machine.phrases = fit_phrases(chosen, machine, counts[1] / counts[0])
    return machine


def sigmoid_line(bad: np.ndarray, good: np.ndarray, odds: float) -> tuple[float, float]:
    """Logistic line from margins to log odds; the classes weigh as in all labelled rows. A little ridge keeps it finite."""
    x = np.c_[np.r_[bad, good], np.ones(len(bad) + len(good))]
    y = np.r_[np.full(len(bad), (len(bad) + 1) / (len(bad) + 2)), np.full(len(good), 1 / (len(good) + 2))]
    weight = np.r_[np.full(len(bad), odds / len(bad)), np.full(len(good), 1 / len(good))] * len(x) / (1 + odds)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * line
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        line = line - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (float(line[0]), float(line[1])) if line[0] > 0 else (1.0, -5.0)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from 0.5 on) to every row.

    Whole texts count, by their worst word or, if phrases were learnt, their worst window of words; a null or empty text has the score of a word without features. Columns named like
    the new ones are replaced, others pass unchanged. Repeated rows have equal scores, an empty table gives no rows, and a text of
    any length is scored whole. Nothing is shuffled.
    """

    def make():
        scorer, plain = Scorer(machine), {}

        def run(texts: list[str | None]) -> list[list]:
            p = machine.probability(np.array(scorer.margins(texts)))
            if machine.phrases is not None:
                p = np.maximum(p, machine.phrases.probability(phrase_margins(machine.phrases, texts, plain)))
            return [p.tolist(), (p >= 0.5).astype(int).tolist()]

        return run

    return with_columns_by(docs, [text], make, (T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())))


def toxicity_table(docs: DataFrame, labels: DataFrame, holdout: int = 5) -> DataFrame:
    """Score of every document, and whether its label was held out."""
    machine = fit(docs, labels, holdout=holdout)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % holdout == 0
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text")), machine).select("doc_id", held.alias("held_out"), "score", "predicted")
