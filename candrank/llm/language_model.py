"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(class | history) * P(bucket | class, history) * P(word | bucket). The first two are
softmaxes over hashed n-gram and skip features. The class factor starts from a model on the classes of the three
tokens before, trained by full-batch steps on the corpus's context counts. Features of the words themselves
follow (the word before and, skipping it, the one before that), for the class and for the bucket in it: frequent words of
a class have buckets of their own, the others share some. They are trained in steps over all training
tokens, each a Spark job over a written table of word numbers. Inside a bucket a word has its add-one share.

Frequent words are broadcast (at most HEAD words of HEAD_BYTES bytes, and a bounded number of longer ones); all others, most of the vocabulary,
are joined. Every training token counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

HELD_OUT, FOLDS = 2, 7
HEAD = 1 << 17
HEAD_BYTES = 32
FLUSH = 300_000  # distinct words that a task holds before it sends them on
SINGLES, GROUPS, TAILS = 11, 12, 8  # classes: the end, frequent words alone, groups of frequent words, groups of the others
CLASSES = 1 + SINGLES + GROUPS + TAILS
GROUP_WORDS = 8192  # frequent words on which the groups are fitted
ROWS = 1 << 13  # of the hashed weights
SLICES = 32  # the context counts are kept in so many rows, by the class of the token before
FEW = 4  # tasks that sum the gradients of the context counts: the driver gets a model's size from each
STEPS, STEP, MOMENTUM, RIDGE = 14, 0.3, 0.6, 1.0
BUCKETS = 16  # of each class
OWN = 12  # frequent words of a class that have a bucket each
WORDS = 1 << 16  # frequent words that are features themselves; the others stand for their classes
WORD_ROWS = 1 << 16  # of the hashed weights of words, each with a column for each class or bucket
WORD_FEATURES = 3  # of a token: the word before, the one before that, both
LOTS, PASSES, WORD_STEP, WORD_RIDGE = 4, 1, 0.8, 4.0  # the training documents are dealt to so many lots; each pass takes a step on every lot
PIECE_TOKENS = 1 << 14  # of a row of the table of word numbers
AT_ONCE = 1 << 18  # tokens that are trained on at once: each time costs as much as there are weight rows, too
LOT = 1 << 12  # tokens of which all outputs are held at once; more do not fit the processor's cache
NEVER = -1e9  # logarithm of a bucket without words


@dataclass
class Lexicon:
    """What tasks need to know of the frequent words."""

    index: dict[bytes, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # class and bucket: class * BUCKETS + bucket
    suffix: dict[bytes, int] = field(default_factory=dict)

    def tail_leaves(self, words: list[bytes]) -> np.ndarray:
        """Class by the last two bytes, bucket by the first."""
        group = np.fromiter(map(self.suffix.get, [w[-2:] for w in words], repeat(0)), np.int64, len(words))
        first = np.fromiter((w[0] for w in words), np.int64, len(words))
        return (1 + SINGLES + GROUPS + group * TAILS // GROUPS) * BUCKETS + first % BUCKETS


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(words_of(text))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    yield out()


def lexicon(words: list[tuple[bytes, int]]) -> Lexicon:
    """words: frequent ones with counts, most frequent first. The groups are k-means clusters of hashed character trigrams."""
    lex = Lexicon({w: i for i, (w, _) in enumerate(words)}, np.array([n for _, n in words], np.int64))
    fit = words[:GROUP_WORDS]
    if not fit:
        return lex
    x = np.zeros((len(fit), 128), np.float32)
    for i, (w, _) in enumerate(fit):
        padded = b"^" + w + b"$"
        for j in range(len(padded) - 2):
            x[i, xxhash.xxh32_intdigest(padded[j : j + 3]) % 128] += 1
    x /= np.maximum(1e-6, np.sqrt((x**2).sum(1, keepdims=True)))
    weight = np.sqrt([n for _, n in fit])[:, None]
    centre = x[np.linspace(0, len(x) - 1, GROUPS).astype(int)]
    for _ in range(12):
        own = (x @ centre.T).argmax(1)
        centre = np.stack([(x * weight)[own == g].sum(0) if (own == g).any() else centre[g] for g in range(GROUPS)])
        centre /= np.maximum(1e-6, np.sqrt((centre**2).sum(1, keepdims=True)))
    votes: dict[bytes, Counter] = {}
    for (w, n), g in zip(fit, own.tolist()):
        votes.setdefault(w[-2:], Counter())[g] += n
    lex.suffix = {s: max(c, key=lambda g: (c[g], -g)) for s, c in votes.items()}
    group = own.tolist() + [lex.suffix.get(w[-2:], 0) for w, _ in words[len(fit) :]]
    lex.leaves = np.array([1 + i if i < SINGLES else 1 + SINGLES + g for i, g in enumerate(group)], np.int64) * BUCKETS
    for g in range(1 + SINGLES, 1 + SINGLES + GROUPS):  # words come by frequency
        own = np.flatnonzero(lex.leaves == g * BUCKETS)
        place = np.arange(len(own))
        lex.leaves[own] += np.where(place < OWN, place, OWN + place % (BUCKETS - OWN))
    return lex


def leaves_of(lex: Lexicon, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]], list[int]]:
    """For all texts in a row: each token's leaf (three ends first, one last), its index (-1: not frequent, -2: end, -3: before the text), each text's other words, token counts."""
    get, index, tails, sizes = lex.index.get, [], [], []
    for text in texts:
        words = words_of(text)
        at = np.empty(len(words) + 4, np.int32)
        at[:3], at[-1] = -3, -2
        at[3:-1] = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        tails.append([words[i] for i in np.flatnonzero(at[3:-1] == -1).tolist()])
        index.append(at)
        sizes.append(len(words) + 1)
    at = np.concatenate(index) if index else np.zeros(0, np.int32)
    leaves = np.zeros(len(at), np.int64)
    frequent = at >= 0
    leaves[frequent] = lex.leaves[at[frequent]]
    leaves[at == -1] = lex.tail_leaves([w for tail in tails for w in tail])
    return leaves, at, tails, sizes


def contexts_of(classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens, and the number of the context of each: classes of the three tokens before, the nearest first."""
    where = np.flatnonzero(at != -3)
    return where, (classes[where - 1] * CLASSES + classes[where - 2]) * CLASSES + classes[where - 3]


def feature_rows(contexts: np.ndarray) -> np.ndarray:
    """The hashed weight rows of each context: bias, three classes alone (two of them skips), pairs with and without a gap."""
    c1, c2, c3 = contexts // CLASSES**2, contexts // CLASSES % CLASSES, contexts % CLASSES
    parts = [np.zeros_like(c1), c1, c2, c3, c1 * CLASSES + c2, c2 * CLASSES + c3, c1 * CLASSES + c3]
    keys = np.stack([p + (t << 20) for t, p in enumerate(parts)], 1).astype(np.uint64)
    return ((keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % ROWS


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _numbered(lex):
    """Rows of whole texts of a lot as word numbers and leaves, PIECE_TOKENS tokens or a little more each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, dealt = [], np.array(batch.column("lot").to_pylist(), np.int64)
            for lot in np.unique(dealt).tolist():
                leaves, at, _, sizes = leaves_of(lex.value, batch.column("text").filter(pa.array(dealt == lot)).to_pylist())
                ends = np.cumsum(np.array(sizes, np.int64) + 3)
                cuts = [0, *(int(ends[i]) for i in np.flatnonzero(np.diff(ends // PIECE_TOKENS, append=-1)))]
                parts += [(at[a:b].tobytes(), leaves[a:b].astype("<u2").tobytes(), lot) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["at", "leaves", "lot"])

    return run


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and leaves of each row."""
    for at, leaves in zip(batch.column("at").to_pylist(), batch.column("leaves").to_pylist()):
        yield np.frombuffer(at, np.int32), np.frombuffer(leaves, "<u2").astype(np.int64)


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the contexts with the class that follows, in SLICES parts, and as a last part those of the leaves."""
    n, cells = np.zeros(CLASSES**4, np.int64), np.zeros(CLASSES * BUCKETS, np.int64)
    for batch in batches:
        for at, leaves in _read(batch):
            classes = leaves // BUCKETS
            where, contexts = contexts_of(classes, at)
            n += np.bincount(contexts * CLASSES + classes[where], minlength=CLASSES**4)
            cells += np.bincount(leaves[where], minlength=len(cells))
    for i, part in enumerate([*n.reshape(SLICES, -1), cells]):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the same part, one after the other, as sums."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(counts, np.int64)
            total[part] = total[part] + x if part in total else x
    for part, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "counts"])


def _gradients(weights):
    """Gradient and diagonal curvature of the log likelihood over the partition's contexts, and the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        g, h, like, any_ = np.zeros_like(w), np.zeros_like(w), 0.0, False
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(counts, np.int64).reshape(-1, CLASSES)
                seen = np.flatnonzero(x.sum(1))
                rows, x, any_ = feature_rows(seen + part * len(x)), x[seen].astype(np.float64), True
                logp = log_softmax(w, rows)
                p, n = np.exp(logp), x.sum(1, keepdims=True)
                like += float((x * logp).sum())
                for f in range(rows.shape[1]):
                    order = np.argsort(rows[:, f], kind="stable")
                    keys, first = np.unique(rows[order, f], return_index=True)
                    g[keys] += np.add.reduceat((x - n * p)[order], first)
                    h[keys] += np.add.reduceat((n * p * (1 - p))[order], first)
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([like]), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (g, h))], ["like", "g", "h"])

    return run


def train(spark: SparkSession, counted: DataFrame, priors: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """Weights (ROWS x CLASSES), and the penalised log likelihood at each accepted step. counted has at most SLICES rows.

    A step that lowers the objective is taken back and the step size halved.
    """
    few = counted.coalesce(FEW)
    w = np.zeros((ROWS, CLASSES))
    w[feature_rows(np.zeros(1, np.int64))[0, 0]] += np.log(priors)
    best, move, step, kept = w, np.zeros_like(w), STEP, []
    for _ in range(steps):
        held = spark.sparkContext.broadcast(w)
        parts = few.mapInArrow(_gradients(held), "like double, g binary, h binary").collect()  # a model's size for each of FEW partitions
        held.destroy()
        if not parts:
            break
        reached = sum(p.like for p in parts) - RIDGE / 2 * float((w**2).sum())
        if kept and reached < kept[-1]:
            step, move = step / 2, np.zeros_like(w)
        else:
            kept.append(reached)
            best = w
            g = sum(np.frombuffer(p.g, "<f4").reshape(w.shape) for p in parts) - RIDGE * w
            h = sum(np.frombuffer(p.h, "<f4").reshape(w.shape) for p in parts) + RIDGE
        move = MOMENTUM * move + step * g / h
        w = best + np.clip(move, -2, 2)
    return best, kept


@dataclass
class WordModel:
    """What the factors with features of words need: weights of the classes' contexts, of words for classes and for buckets, and the leaves' shares."""

    contexts: np.ndarray  # ROWS x CLASSES
    classes: np.ndarray  # WORD_ROWS x CLASSES
    buckets: np.ndarray  # WORD_ROWS x BUCKETS
    shares: np.ndarray  # CLASSES x BUCKETS, logarithms

    def table(self) -> np.ndarray:
        """To be filled with the contexts that occur."""
        return np.full((CLASSES**3, CLASSES), np.nan, np.float32)

    def fill(self, table: np.ndarray, contexts: np.ndarray) -> None:
        new = np.zeros(len(table), bool)
        new[contexts] = True
        new = np.flatnonzero(new & np.isnan(table[:, 0]))
        for i in range(0, len(new), 4096):
            table[new[i : i + 4096]] = log_softmax(self.contexts, feature_rows(new[i : i + 4096]))


def word_rows(at: np.ndarray, leaves: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed weight rows of each token's history for its class, and for the bucket in its class: the word before, the one before that, and both."""
    classes = leaves // BUCKETS
    symbols = np.where((at >= 0) & (at < WORDS), at, WORDS + classes).astype(np.uint64)
    one, two = symbols[where - 1], symbols[where - 2]
    own = classes[where].astype(np.uint64) + np.uint64(1)
    none = np.uint64((1 << 20) - 1)
    parts = np.stack([one << np.uint64(20) | none, none << np.uint64(20) | two, one << np.uint64(20) | two], 1)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % WORD_ROWS
    return mix(parts + np.uint64(1)), mix(parts + (own << np.uint64(44))[:, None] + np.uint64(1))


def outputs_of(weights: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row for each output and a column for each token: start and the weights of the token's features. rows has a row for each feature."""
    z = start + weights.take(rows[0], 0, mode="clip")
    for r in rows[1:]:
        z += weights.take(r, 0, mode="clip")
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    return z


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= np.log(np.exp(z).sum(0))
    return z.T


def class_logs(model: WordModel, table: np.ndarray, contexts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return _log_softmax(outputs_of(model.classes, rows.T, table.take(contexts, 0)))


def bucket_logs(model: WordModel, classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return _log_softmax(outputs_of(model.buckets, rows.T, model.shares.take(classes, 0)))


def _chosen(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of each token's target alone; z is spent."""
    own = z[target, np.arange(len(target))]
    np.exp(z, out=z)
    return own - np.log(z.sum(0))


def _add(sums: np.ndarray, rows: np.ndarray, outputs, target: np.ndarray) -> float:
    """Adds to sums, for each weight row, how often each output followed and, in the second half, how often the model expects it; the log likelihood.

    sums has a row for each output, rows one for each feature; outputs gives those of a slice of the tokens.
    """
    n, like = len(sums) // 2, 0.0
    p = np.empty((n, len(target)))
    for i in range(0, len(target), LOT):
        z, t = outputs(slice(i, i + LOT)), target[i : i + LOT]
        own = z[t, np.arange(len(t))]
        np.exp(z, out=z)
        total = z.sum(0)
        like += float((own - np.log(total)).sum())
        np.divide(z, total, out=p[:, i : i + LOT])
    seen = sums[:n].reshape(-1)
    for r in rows:
        np.add.at(seen, target * sums.shape[1] + r, 1.0)
        for j in range(n):
            sums[n + j] += np.bincount(r, p[j], sums.shape[1])
    return like


def _in_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and leaves of several rows, AT_ONCE tokens or a little more."""
    held, n = [], 0
    for batch in batches:
        for row in _read(batch):
            held.append(row)
            n += len(row[0])
            if n >= AT_ONCE:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held, n = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _word_gradients(model):
    """What followed and what was expected, for the words' weights over the partition's tokens, in SLICES parts, and the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        table, like, tokens = own.table(), 0.0, 0
        sums, inside = np.zeros((2 * CLASSES, WORD_ROWS)), np.zeros((2 * BUCKETS, WORD_ROWS))
        for at, leaves in _in_lots(batches):
            where, contexts = contexts_of(leaves // BUCKETS, at)
            own.fill(table, contexts)
            rows, inner = (np.ascontiguousarray(x.T) for x in word_rows(at, leaves, where))
            tokens += len(where)
            c, b = leaves[where] // BUCKETS, leaves[where] % BUCKETS
            like += _add(sums, rows, lambda x: outputs_of(own.classes, rows[:, x], table.take(contexts[x], 0)), c)  # noqa: B023
            split = np.flatnonzero(c > SINGLES)
            c, b, inner = c[split], b[split], inner.take(split, 1)
            like += _add(inside, inner, lambda x: outputs_of(own.buckets, inner[:, x], own.shares.take(c[x], 0)), b)  # noqa: B023
        for i in range(SLICES):
            at = slice(i * WORD_ROWS // SLICES, (i + 1) * WORD_ROWS // SLICES)
            x = np.concatenate([sums[:, at], inside[:, at]]).T
            if tokens and (x.any() or i == 0):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([tokens if i == 0 else 0]), pa.array([like if i == 0 else 0.0]), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["part", "n", "like", "sums"])

    return run


def _summed_gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for part, n, like, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "like", "sums"))):
            x = np.frombuffer(sums, "<f4").astype(np.float64)
            if part in total:
                total[part][0] += n
                total[part][1] += like
                total[part][2] += x
            else:
                total[part] = [n, like, x]
    for part, (n, like, x) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([like]), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["part", "n", "like", "sums"])


def train_words(spark: SparkSession, ids: DataFrame, model: WordModel, lots: int = LOTS, passes: int = PASSES) -> tuple[WordModel, list[float]]:
    """The model with trained weights of words, and each step's log likelihood of a token of its lot before the step.

    The lots take turns. A step is one job over a lot's tokens and goes along its gradient, over a bound of the
    diagonal curvature of all steps so far: weights that many steps have fitted move less, as in an average,
    and a feature that a lot has first moves in full. What comes to the driver is the model's size.
    """
    likes: list[float] = []
    rows, ends = WORD_ROWS // SLICES, np.cumsum([0, CLASSES, CLASSES, BUCKETS, BUCKETS])
    curvature = {"classes": np.zeros((WORD_ROWS, CLASSES), np.float32), "buckets": np.zeros((WORD_ROWS, BUCKETS), np.float32)}
    for turn in range(lots * passes):
        held = spark.sparkContext.broadcast(model)
        out = "part int, n long, like double, sums binary"
        own = ids.where(F.col("lot") == turn % lots).select("at", "leaves")
        parts = own.mapInArrow(_word_gradients(held), out).repartition(8, "part").mapInArrow(_summed_gradients, out)
        new, like, n = {"classes": model.classes.copy(), "buckets": model.buckets.copy()}, 0.0, 0
        for p in parts.toLocalIterator():  # SLICES rows of the model, a partition at a time
            like, n = like + p.like, n + p.n
            at = slice(p.part * rows, (p.part + 1) * rows)
            seen_expected = np.split(np.frombuffer(p.sums, "<f4").reshape(rows, -1), ends[1:-1], axis=1)
            for name, seen, expected in (("classes", *seen_expected[:2]), ("buckets", *seen_expected[2:])):
                curvature[name][at] += expected * (1 - expected / np.maximum(seen.sum(1, keepdims=True), 1))  # no less than the sum of p (1 - p)
                now = new[name][at]
                new[name][at] = now + np.clip(WORD_STEP * (seen - expected - WORD_RIDGE / lots * now) / (curvature[name][at] + WORD_RIDGE), -2, 2)
        held.destroy()
        if n:
            likes.append(like / n)
            model = replace(model, **new)
    return model, likes


def _score(lex, model, word_base, word_own, tail_own, base_unit: float):
    """For each text a first row with what its frequent tokens sum to, then a row for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = lex.value, model.value
        table = m.table()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            leaves, at, tails, sizes = leaves_of(own, texts)
            where, contexts = contexts_of(leaves // BUCKETS, at)
            m.fill(table, contexts)
            target, index = leaves[where], at[where]
            rows, inner = (np.ascontiguousarray(x.T) for x in word_rows(at, leaves, where))
            score = np.zeros(len(where))
            for i in range(0, len(where), LOT):
                part = slice(i, i + LOT)
                c, b = target[part] // BUCKETS, target[part] % BUCKETS
                score[part] = _chosen(outputs_of(m.classes, rows[:, part], table.take(contexts[part], 0)), c)
                split = np.flatnonzero(c > SINGLES)
                if len(split):
                    score[i + split] += _chosen(outputs_of(m.buckets, inner.take(i + split, 1), m.shares.take(c[split], 0)), b[split])
            score /= np.log(10)
            frequent, tail = index >= 0, index == -1
            score[frequent] += word_own.value[index[frequent]]
            score[tail] += tail_own[target[tail]]
            base = np.zeros(len(where))
            base[frequent] = word_base.value[index[frequent]]
            base[index == -2] = word_base.value[-1]
            base[tail] = -base_unit
            known = frequent | (index == -2) & (word_base.value[-2] > 0)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, score)]
            row = batch.column("row").to_pylist()
            counts = [Counter(words) for words in tails]
            rest = np.repeat(np.array(row, np.int64), [len(c) for c in counts])
            words, times = [x for c in counts for x in c], [n for c in counts for n in c.values()]
            padded = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(len(rest), t)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(row, rest)), pa.array([b"\0%d" % r for r in row] + words, pa.binary()), pa.array([0] * len(row) + times, pa.int64()),
                    padded(batch.column("doc_id").to_pylist(), pa.int64()), padded(batch.column("held_out").to_pylist(), pa.bool_()), padded(sizes, pa.int64()),
                    *(padded(s, t) for s, t in zip(sums, (pa.int64(), pa.float64(), pa.float64()))),
                ],
                ["row", "word", "tf", "doc_id", "held_out", "n_tokens", "known", "base", "own"],
            )

    return run


def _tail_sizes(lex):
    """Distinct words that are not frequent, by leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = lex.value, np.zeros(CLASSES * BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(own.tail_leaves([w for w in batch.column("word").to_pylist() if w not in own.index]), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], ["c", "n"])

    return run


def leaf_shares(by_leaf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Logarithm of each bucket's share in its class; a bucket without words has none, a class without words has even ones."""
    n = np.where(sizes > 0, by_leaf + 1, 0).reshape(CLASSES, BUCKETS)
    n[n.sum(1) == 0] = 1
    return np.where(n > 0, np.log(np.maximum(n, 1) / n.sum(1, keepdims=True)), NEVER).astype(np.float32)


def score_documents(docs: DataFrame, head: int = HEAD, steps: int = STEPS, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text, ...).

    Documents whose crc32(doc_id as text) mod 7 is not 2 train the model; those with a null id train it too.
    Null text is empty: the end token alone. Words that no training document has count as one unseen word in
    the base score and as one of each bucket of infrequent words in the model's, so that both are proper
    distributions. Repeated rows keep a row each; further columns are left out; an empty table gives no rows;
    without training documents every class is as likely.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "language-model")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    read = common.numbered(docs).withColumn("held_out", held)
    training = read.where(~F.col("held_out")).select("text", F.pmod(F.xxhash64("doc_id"), LOTS).cast("int").alias("lot"))
    vocabulary = scratch.keep(training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    top = [(bytes(r.word), r.n) for r in common.frequent(vocabulary, "word", head, HEAD_BYTES).toLocalIterator()]
    lex = lexicon(sorted(top, key=lambda x: (-x[1], x[0])))
    del top
    shared = spark.sparkContext.broadcast(lex)
    ids = scratch.keep(training.mapInArrow(_numbered(shared), "at binary, leaves binary, lot int"), "ids", by="lot")
    counted = ids.select("at", "leaves").mapInArrow(_context_counts, "part int, counts binary")
    counted = scratch.keep(counted.repartition(8, "part").mapInArrow(_summed, "part int, counts binary"), "contexts")

    by_leaf = np.zeros(CLASSES * BUCKETS)
    for r in counted.where(F.col("part") == SLICES).collect():  # one row
        by_leaf += np.frombuffer(r.counts, np.int64)
    by_class = by_leaf.reshape(CLASSES, BUCKETS).sum(1)
    n_docs, n_train = int(by_class[0]), int(by_class.sum())
    distinct = vocabulary.count() + (n_docs > 0)
    sizes = np.zeros(CLASSES * BUCKETS)
    for r in vocabulary.select("word").mapInArrow(_tail_sizes(shared), "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # one row for each leaf
        sizes[r.c] = r.n
    sizes[(1 + SINGLES + GROUPS) * BUCKETS :] += 1  # the unseen word
    sizes += np.bincount(lex.leaves, minlength=len(sizes))
    weights, _ = train(spark, counted.where(F.col("part") < SLICES), (by_class + 1) / (n_train + CLASSES), steps)
    model = WordModel(weights.astype(np.float32), np.zeros((WORD_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, BUCKETS), np.float32), leaf_shares(by_leaf, sizes))
    model, _ = train_words(spark, ids, model, passes=passes)

    unit = float(np.log10(n_train + distinct + 1))
    total = np.log10(np.maximum(1, by_leaf + sizes))
    word_base = np.append(np.log10(lex.counts + 1) - unit, [float(n_docs), np.log10(n_docs + 1) - unit])
    word_own = np.log10(lex.counts + 1) - total[lex.leaves] if len(lex.counts) else np.zeros(0)
    word_own[: min(SINGLES, len(word_own))] = 0  # alone in their classes
    put = spark.sparkContext.broadcast
    parts = read.mapInArrow(_score(shared, put(model), put(word_base), put(word_own), -total, unit), "row long, word binary, tf long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double")
    joined = parts.join(vocabulary, "word", "left")
    found = F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0))
    gain = F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), (F.max("known") + found).alias("n_known"), (F.max("base") + gain).alias("base_score"), (F.max("own") + gain).alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir))
