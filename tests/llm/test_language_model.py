import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from candrank.llm import language_model as lm
from tests.llm.conftest import DOCS, rows

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute(table):
    c = Counter()
    for d, t, *_ in table:
        if not held(d):
            c.update(tokens(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    return {(d, t): (held(d), len(tokens(t)) + 1, sum(x in c for x in [*tokens(t), None]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*tokens(t), None])) for d, t, *_ in table}


@pytest.mark.parametrize("head", [1 << 17, 6])
def test_base_and_counts(small, head):
    want = sorted((d, *v) for (d, t), v in brute(rows()).items() if d is not None and d != 3)
    got = sorted(tuple(r)[:6] for r in lm.score_documents(small, head=head, steps=2).collect() if r.doc_id is not None and r.doc_id != 3)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_edges(none, clashing):
    assert lm.score_documents(none).count() == 0
    assert lm.score_documents(clashing, steps=1).count() == len(rows())


def test_only_held_out(spark):
    docs = spark.createDataFrame([(d, "a b c", "en", "s", 0) for d in range(60) if held(d)], DOCS)
    got = lm.score_documents(docs).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and np.isfinite(r.score) for r in got)


def test_training_helps_held_out_texts(spark):
    """Two languages that never mix: the classes of the words before tell which one it is."""
    r = np.random.default_rng(4)
    table = []
    for d in range(400):
        letters = "abcdef" if d % 2 else "uvwxyz"
        p = 1 / np.arange(1, 41)
        vocab = ["".join(letters[(i * 7 + j * i) % 6] for j in range(2 + i % 4)) + letters[i % 6] for i in range(40)]
        table.append((d, " ".join(r.choice(vocab, 80, p=p / p.sum())), "en", "s", 0))
    docs = spark.createDataFrame(table, DOCS)
    out = [x for x in lm.score_documents(docs).collect() if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 0.1 * sum(x.n_tokens for x in out)


def test_model_is_a_distribution():
    lex = lm.lexicon([(b"w%d" % i, 100 - i) for i in range(50)])
    w = np.random.default_rng(1).standard_normal((lm.ROWS, lm.CLASSES))
    assert np.allclose(np.exp(lm.log_softmax(w, lm.feature_rows(np.arange(500)))).sum(1), 1)
    classes = lex.leaves // lm.BUCKETS
    assert classes.min() >= 1 and classes.max() < 1 + lm.SINGLES + lm.GROUPS
    r = np.random.default_rng(2)
    sizes = np.bincount(lex.leaves, minlength=lm.CLASSES * lm.BUCKETS)
    sizes[(1 + lm.SINGLES + lm.GROUPS) * lm.BUCKETS :] += 1
    model = lm.WordModel(w, r.standard_normal((lm.WORD_ROWS, lm.CLASSES)), r.standard_normal((lm.WORD_ROWS, lm.BUCKETS)), lm.leaf_shares(np.zeros(len(sizes)), sizes))
    leaves, at, _, n = lm.leaves_of(lex, ["w1 w2 w3 strange w40 w1", "", "W2 é w5"])
    where, contexts = lm.contexts_of(leaves // lm.BUCKETS, at)
    assert len(where) == sum(n) == 12
    table = model.table()
    model.fill(table, contexts)
    rows, inner = lm.word_rows(at, leaves, where)
    assert np.allclose(np.exp(lm.class_logs(model, table, contexts, rows)).sum(1), 1, atol=1e-5)
    for c in range(1 + lm.SINGLES, lm.CLASSES):
        p = np.exp(lm.bucket_logs(model, np.full(12, c), inner))
        assert np.allclose(p.sum(1), 1, atol=1e-5)
        used = sizes.reshape(-1, lm.BUCKETS)[c] > 0
        assert not used.any() or p[:, ~used].max(initial=0) < 1e-9


def test_likelihood_grows(spark):
    r = np.random.default_rng(2)
    n = np.zeros((lm.SLICES, lm.CLASSES**4 // lm.SLICES), np.int64)
    n[:4, :640] = r.poisson(2, (4, 640)) * (r.random((4, 640)) < 0.2)
    table = spark.createDataFrame([(i, n[i].tobytes()) for i in range(lm.SLICES) if n[i].any()], "part int, counts binary")
    _, likes = lm.train(spark, table, np.full(lm.CLASSES, 1 / lm.CLASSES))
    assert len(likes) > 5 and all(b >= a for a, b in zip(likes, likes[1:])) and likes[-1] > 0.8 * likes[0]


def test_words_before_tell_the_word(spark):
    """Each word follows from the word before it, inside one class: only features of words can know."""
    r = np.random.default_rng(7)
    vocab = ["x%02dy" % i for i in range(60)]
    texts = []
    for d in range(300):
        at, words = int(r.integers(60)), []
        for _ in range(60):
            words.append(vocab[at])
            at = (at * 7 + 3) % 60 if r.random() < 0.9 else int(r.integers(60))
        texts.append((d, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame(texts, DOCS)
    gains = {}
    for passes in (0, 1):
        out = [x for x in lm.score_documents(docs, passes=passes).collect() if x.held_out]
        gains[passes] = sum(x.score for x in out) / sum(x.n_tokens for x in out)
    assert gains[1] > gains[0] + 0.15, gains


def test_likelihood_of_words_grows(spark):
    lex = lm.lexicon([(b"w%d" % i, 100 - i) for i in range(50)])
    r = np.random.default_rng(1)
    texts = spark.createDataFrame([(" ".join(f"w{(j * 3 + i) % 50}" for j in range(40)) + f" t{r.integers(9)}", i % 2) for i in range(50)], "text string, lot int")
    ids = texts.mapInArrow(lm._numbered(spark.sparkContext.broadcast(lex)), "at binary, leaves binary, lot int").cache()
    assert ids.select("lot").distinct().count() == 2
    sizes = np.bincount(lex.leaves, minlength=lm.CLASSES * lm.BUCKETS)
    sizes[(1 + lm.SINGLES + lm.GROUPS) * lm.BUCKETS :] += 1
    model = lm.WordModel(np.zeros((lm.ROWS, lm.CLASSES), np.float32), np.zeros((lm.WORD_ROWS, lm.CLASSES), np.float32), np.zeros((lm.WORD_ROWS, lm.BUCKETS), np.float32), lm.leaf_shares(np.zeros(len(sizes)), sizes))
    _, likes = lm.train_words(spark, ids, model, 2, 3)
    assert len(likes) == 6 and min(likes[1:]) > 0.2 * likes[0]  # the penalty of weights keeps the later steps a little below the second
    assert len(lm.train_words(spark, ids, model, 4, 1)[1]) == 2  # lots without documents take no step


def test_driver_gets_few_gradients(spark, monkeypatch):
    """However many partitions hold the context counts, a step brings at most four models' sizes to the driver."""
    sent, plain = spark.sparkContext.accumulator(0), lm._gradients

    def counting(weights):
        run = plain(weights)

        def counted(batches):
            for b in run(batches):
                sent.add(b.num_rows)
                yield b

        return counted

    monkeypatch.setattr(lm, "_gradients", counting)
    part = np.zeros(lm.CLASSES**4 // lm.SLICES, np.int64)
    part[:64] = 3
    table = spark.createDataFrame([(i, part.tobytes()) for i in range(lm.SLICES)], "part int, counts binary").repartition(32)
    lm.train(spark, table, np.full(lm.CLASSES, 1 / lm.CLASSES), steps=3)
    assert 0 < sent.value <= 3 * 4


def test_sums_of_outputs():
    """What followed and what is expected of a few tokens, each token alone."""
    r = np.random.default_rng(5)
    n, tokens, many = 4, 300, 50
    w, rows, target = r.standard_normal((many, n)), r.integers(0, many, (3, tokens)), r.integers(0, n, tokens)
    sums = np.zeros((2 * n, many))
    like = lm._add(sums, rows, lambda x: lm.outputs_of(w, rows[:, x], np.zeros((len(target[x]), n))), target)
    want, total = np.zeros((2 * n, many)), 0.0
    for i in range(tokens):
        p = np.exp(w[rows[:, i]].sum(0))
        p /= p.sum()
        total += math.log(p[target[i]])
        for f in range(3):
            want[target[i], rows[f, i]] += 1
            want[n:, rows[f, i]] += p
    assert np.allclose(sums, want) and math.isclose(like, total)
