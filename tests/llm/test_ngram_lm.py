"""The language model against Kneser-Ney written out with dictionaries, in one shard and in many."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import ngram_lm as lm

DOCS = "doc_id long, text string, held_out string, n_tokens string, row long, label long"
START, END = "<s>", "</s>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOCS)


def tokens(text):
    return [w.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (text or "").encode().split()] + [END]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter(t for text in texts for t in tokens(text))
        self.count = {order: Counter()}
        for text in texts:
            w = [START] * (order - 1) + tokens(text)
            self.count[order].update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter()
            for gram, c in self.count[n + 1].items():
                self.count[n][gram[1:]] += c if gram[1:][0] == START else 1
        self.discount, self.stats = {}, {}
        for n, counts in self.count.items():
            k = Counter(counts.values())
            d = lm.PLAIN_DISCOUNTS
            if all(k[j] for j in (1, 2, 3, 4)):
                y = k[1] / (k[1] + 2 * k[2])
                mine = tuple(j - (j + 1) * y * k[j + 1] / k[j] for j in (1, 2, 3))
                d = mine if all(0 < x < j for j, x in enumerate(mine, 1)) else d
            self.discount[n] = d
            stats = defaultdict(lambda: [0, 0.0])
            for gram, c in counts.items():
                stats[gram[:-1]][0] += c
                stats[gram[:-1]][1] += d[min(c, 3) - 1]
            self.stats[n] = stats

    def p(self, context, word):
        p = 1 / (len(self.raw) + 1)
        for n in range(1, self.order + 1):
            h = tuple(context[len(context) - n + 1 :])
            if h in self.stats[n]:
                total, left = self.stats[n][h]
                c = self.count[n].get((*h, word), 0)
                p = ((c - self.discount[n][min(c, 3) - 1] if c else 0) + left * p) / total
        return p

    def score(self, text):
        w = [START] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(w[i - self.order + 1 : i], w[i])) for i in range(self.order - 1, len(w)))


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"W{k}" if k % 7 else f"é{k}" for k in range(60)]
    draw = lambda: words[min(int(r.expovariate(0.12)), 59)]
    rows = [(i, " ".join(draw() for _ in range(r.randint(0, 40)))) for i in range(n)]
    passage = " ".join(draw() for _ in range(30))
    return [*rows, *((1000 + k, passage) for k in range(5)), (2000, None), (2001, ""), (2002, " \n"), (2003, "unseen W1 w1\tunseen"), (5, rows[5][1]), (None, "W1 w2"), (2004, "W1 W2 " * 20_000)]


@pytest.mark.parametrize(("order", "shard"), [(3, 1 << 21), (3, 500), (2, 200), (1, 300), (4, 3000)])
def test_scores_equal_plain_kneser_ney(spark, monkeypatch, order, shard):
    monkeypatch.setattr(lm, "BUFFER", 300)  # many partial counts
    monkeypatch.setattr(lm, "CHUNK", 2000)
    rows = corpus(order)
    held = lambda i: i is not None and i % 5 == 3 and i != 2004
    learned = [t for i, t in rows if not held(i)]
    plain = Plain(learned, order)
    total = sum(plain.raw.values())
    got = lm.score_documents(frame(spark, rows).repartition(3), F.col("doc_id") % 5 == 3, lm.Params(order, shard)).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for x in got:
        t = tokens(by_id[x.doc_id])
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(x.doc_id), len(t), sum(w in plain.raw for w in t), total)
        assert x.base_score == pytest.approx(sum(math.log10((plain.raw[w] + 1) / (total + len(plain.raw) + 1)) for w in t), rel=1e-9)
        assert x.score == pytest.approx(plain.score(by_id[x.doc_id]), rel=1e-9), x.doc_id
    new = [x for x in got if x.held_out and x.n_tokens > 5]
    assert order == 1 or sum(x.score for x in new) > sum(x.base_score for x in new) * 1.2


def test_probabilities_sum_to_one(spark):
    rows = [r for r in corpus(9) if r[0] != 2004]
    model = lm.train(frame(spark, rows), lm.Params(3, 800))
    words = sorted({t for _, text in rows for t in tokens(text)} - {END})
    assert model.bits > 2 and model.words == len(words) + 1
    import pyarrow as pa

    for context in ("", "w1", "w1 w2", "unseen w3", "w3 unseen"):
        n = len(context.split())
        texts = [f"{context} {w}" for w in [*words, "neverseen"]] + [context]
        hashes, starts = lm.tokens_of(pa.array(texts))
        p = lm.probabilities(model, lm.padded(model, hashes, starts))
        assert p[starts[:-1] + n].sum() == pytest.approx(1)
    files = os.listdir(model.folder)
    assert sum(f.startswith("grams3") for f in files) > 4 and any(f.startswith("hot2") for f in files) and all("." not in f for f in files)
    model.drop()
    assert not os.path.exists(model.folder)


def test_hash_tables_find_what_they_hold():
    r = np.random.default_rng(0)
    for n in (1, 15, 16, 17, 1000, 40_000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        index = lm.hash_index(keys)
        assert (lm.find(index, keys) == np.arange(len(keys))).all()
        assert (lm.find(index, keys + np.uint64(1 << 33)) == -1).mean() > 0.999
    rows = r.integers(0, 3, (500, 4))
    table, at = lm.coded(rows)
    assert (table[at] == rows).all() and at.dtype == np.uint8
    columns = [np.sort(r.integers(0, 70_000, 300)), r.integers(0, 1 << 31, 300)]
    for kind in (np.uint32, np.uint64):
        assert all((a == b).all() for a, b in zip(lm.unpacked(lm.packed(columns, kind), 2, kind), columns, strict=True))


def test_empty_tables_and_folders(spark):
    assert lm.score_documents(frame(spark, []), F.col("doc_id") % 7 == 2).count() == 0
    one = lm.score_documents(frame(spark, [(2, "a b")]), F.lit(True)).collect()  # nothing to learn from
    assert (one[0].train_tokens, one[0].n_known, one[0].score, one[0].base_score) == (0, 0, 0.0, 0.0)
    assert lm.shared_path("file:/a%20b/c") == "/a b/c" and lm.shared_path("/x") == "/x"
    with pytest.raises(ValueError):
        lm.shared_path("hdfs://host/x")
