"""Toxicity by weak supervision.

Voters are lexicon terms (a fixed list, and words and word beginnings mined from labelled rows)
and surface patterns; each says "toxic" or nothing. A generative label model estimates how often
each voter speaks in either class from the agreement of voters over all documents, by expectation
maximisation over the table of vote patterns; labelled rows start it and count as one more voter of
known accuracy. What the classes leave unexplained of the voters' second moments is their
correlation, and correlated voters share their say. The posteriors of all documents, labelled or
not, are the labels on which a linear classifier is trained, and that classifier scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import cut, small_batches, text_chunks

# Insults that vote whether or not labelled rows hold them.
LEXICON = ("bastard", "clown", "disgusting", "dumb", "filth", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "retard", "scum", "stupid", "trash", "vermin", "worthless")
#: Patterns that vote beside the lexicon.
PATTERNS = {"exclaimed": r"!{3,}", "masked": r"[^\W\d_][*#@$]{2,}[^\W\d_]", "shouted": r"\b[A-Z]{5,}\b[^a-z]{1,3}\b[A-Z]{5,}\b", "told_off": r"(?i)\b(?:shut up|get lost|go to hell)\b"}
WORD = re.compile(r"[^\W\d_]+")
#: Mined word beginnings have from 3 to 8 letters.
PREFIX_LETTERS = range(3, 9)


@dataclass(frozen=True)
class Params:
    """``train_rows`` bounds the labelled rows that terms are mined from and that start the label model
    (taken by hash of the id); every word and word beginning of theirs may become a term."""

    train_rows: int = 12_000
    min_support: int = 4
    min_gain: float = 24.0
    min_precision: float = 0.8
    threshold: float = 0.3
    held_out_modulus: int = 4
    held_out_rest: int = 2
    #: How far a label of a training row is believed when the label model weighs it against the voters.
    gold_accuracy: float = 0.98
    rounds: int = 40
    #: Rows of the table of vote patterns that one task reads.
    patterns_a_task: int = 50_000


def held_out(key: Column, p: Params = Params()) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % p.held_out_modulus == p.held_out_rest, F.lit(False))


def features_of(text: str) -> set[str]:
    """Whole words (``=word``) and word beginnings (``^beg``) of a text, lower-cased."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add("=" + w)
        out.update("^" + w[:n] for n in PREFIX_LETTERS if n < len(w))
    return out


class Voters:
    """Terms found by one automaton, then patterns; each votes or keeps silent."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.patterns = [re.compile(x) for x in PATTERNS.values()]
        self.width = len(terms) + len(self.patterns)
        self.automaton = ahocorasick.Automaton()
        spelled: dict[str, list] = {}
        for i, term in enumerate(terms):
            spelled.setdefault(term[1:], []).append((i, term[0] == "="))
        for word, wanted in spelled.items():
            self.automaton.add_word(word, (len(word), wanted))
        self.automaton.make_automaton()

    def votes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Votes (rows x voters) and the size class of each text: the binary logarithm of its words; null is empty."""
        votes, size = np.zeros((len(texts), self.width), dtype=bool), np.zeros(len(texts), dtype=np.int32)
        for row, text in enumerate(texts):
            if not text:
                continue
            low, mine = text.lower(), votes[row]
            size[row] = (low.count(" ") + low.count("\n") + 1).bit_length()
            if self.terms:
                for end, (n, wanted) in self.automaton.iter(low):
                    if end >= n and low[end - n].isalpha():
                        continue
                    ended = end + 1 == len(low) or not low[end + 1].isalpha()
                    for i, whole in wanted:
                        if ended or not whole:
                            mine[i] = True
            for k, pattern in enumerate(self.patterns, len(self.terms)):
                mine[k] = pattern.search(text) is not None
        return votes, size


def inputs(votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the linear classifier sees: each vote, how many voters spoke, how dense they are, the text's size."""
    spoke = votes.sum(1, keepdims=True)
    density = 50 * spoke / np.exp2(size)[:, None]
    return np.hstack([votes, np.log1p(spoke), density / (1 + density), size[:, None] / 10, np.ones((len(votes), 1))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def unpacked(bits, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(map(bytes, bits)), np.uint8)
    return np.unpackbits(flat.reshape(-1, -(-width // 8)), axis=1)[:, :width].astype(float)


@dataclass(frozen=True)
class LabelModel:
    """How often each voter speaks in class 0 (first row) and in the kinds of class 1, the shares of these, and each voter's voice: its share of the say it has with correlated voters.

    Class 1 comes in kinds, one for each group of voters that speak together (insults of one
    language, say): a voter's silence tells nothing of texts that its group has no words for.
    """

    rates: np.ndarray
    share: np.ndarray
    voice: np.ndarray
    gold_accuracy: float = 0.98

    def kinds(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """P(kind) of vote vectors (rows x kinds, class 0 first); what a voter says and its silence both count by its voice."""
        on, off = np.log(self.rates) * self.voice, np.log(1 - self.rates) * self.voice
        odds = votes @ (on - off).T + off.sum(1) + np.log(self.share)
        if gold is not None:  # -1: not known
            right, wrong = np.log(self.gold_accuracy), np.log(1 - self.gold_accuracy)
            odds[:, 0] += np.where(gold == 0, right, np.where(gold > 0, wrong, 0))
            odds[:, 1:] += np.where(gold > 0, right, np.where(gold == 0, wrong, 0))[:, None]
        odds = np.exp(odds - odds.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of vote vectors."""
        return 1 - self.kinds(votes, gold)[:, 0]


def summed(patterns: DataFrame, p: Params, width: int, score) -> np.ndarray:
    """The sum over the table of patterns of what ``score(votes, size, gold, n)`` adds up for some rows; a table of any size is summed by its tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            part = score(unpacked(batch["bits"], width), batch["size"].to_numpy(), batch["gold"].to_numpy(), batch["n"].to_numpy(float))
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    rows = patterns.mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for at, x in rows:
        out[at] = x
    return out


def smoothed(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rates, shares) from documents (first column) and votes of each kind; rates are held off 0 and 1 by a small count of pooled votes."""
    size, every = sums[:, 0], sums[:, 0].sum()
    pooled = (sums[:, 1:].sum(0) + 0.05) / (every + 1)
    rates = (sums[:, 1:] + 2 * pooled) / (size[:, None] + 2)
    return np.clip(rates, 1e-9, 1 - 1e-9), np.maximum(size, 1e-6 * max(every, 1)) / max(every, 1)


def estimate(patterns: DataFrame, start: LabelModel, p: Params) -> LabelModel:
    """Expectation maximisation over all documents' votes, and the voters' correlations within the kinds.

    The correlations come from the first estimate's residual second moments; the second estimate
    lets correlated voters share their say.
    """
    width, kinds, model = len(start.voice), len(start.share), start
    for second in (False, True):
        if second:
            moments = summed(patterns, p, width, residual_moments(model)).reshape(width, width)
            model = LabelModel(model.rates, model.share, voices(moments), model.gold_accuracy)
        for _ in range(p.rounds):
            was = model
            rates, share = smoothed(summed(patterns, p, width, kind_sums(model)).reshape(kinds, width + 1))
            model = LabelModel(rates, share, model.voice, model.gold_accuracy)
            if np.abs(model.rates - was.rates).max() < 1e-4 and np.abs(model.share - was.share).max() < 1e-4:
                break
    return model


def kind_sums(model: LabelModel):
    """Documents and votes by kind, in expectation."""

    def score(votes, size, gold, n):
        q = model.kinds(votes, gold) * n[:, None]
        return np.hstack([q.sum(0)[:, None], q.T @ votes]).ravel()

    return score


def residual_moments(model: LabelModel):
    """Second moments of what the kinds leave of the votes."""

    def score(votes, size, gold, n):
        q = model.kinds(votes, gold) * n[:, None]
        total = np.zeros((votes.shape[1], votes.shape[1]))
        for k in range(q.shape[1]):
            off = votes - model.rates[k]
            total += (off * q[:, k : k + 1]).T @ off
        return total.ravel()

    return score


def correlations(moments: np.ndarray) -> np.ndarray:
    """Correlations from second moments around the means."""
    spread = np.sqrt(np.maximum(np.diag(moments), 1e-9))
    out = moments / np.outer(spread, spread)
    np.fill_diagonal(out, 1)
    return out


def voices(moments: np.ndarray) -> np.ndarray:
    """A voter's own share of what it says: one over its correlations with all voters, itself included; those under the noise or negative don't count."""
    r = correlations(moments)
    return 1 / np.where(r > NOISE, r, 0).sum(1)


#: Correlations of voters that count as none.
NOISE = 0.05


def groups(second: np.ndarray, total: float) -> list[np.ndarray]:
    """Voters that speak together, by the second moments of the votes of all documents: components of their correlation graph, of two voters or more."""
    mean = np.diag(second) / max(total, 1)
    linked = correlations(second / max(total, 1) - np.outer(mean, mean)) > NOISE
    linked &= (np.diag(second) > 0)[:, None] & (np.diag(second) > 0)[None, :]
    of = np.arange(len(mean))
    while True:
        least = np.minimum(of, np.where(linked, of[None, :], len(of)).min(1, initial=len(of)))
        if (least == of).all():
            return [g for k in np.unique(of) if len(g := np.flatnonzero(of == k)) > 1]
        of = least


def fit_linear(patterns: DataFrame, model: LabelModel, p: Params, penalty: float = 2.0, steps: int = 20) -> np.ndarray:
    """Logistic regression on the posteriors of all documents, by Newton's method over the table of patterns."""
    width = len(model.voice)
    k = width + 4
    w = np.zeros(k)
    for _ in range(steps):

        def score(votes, size, gold, n, w=w):
            x = inputs(votes, size)
            guess, target = sigmoid(x @ w), model.posterior(votes, gold)
            hessian = (x * (n * guess * (1 - guess))[:, None]).T @ x
            return np.concatenate([x.T @ (n * (guess - target)), hessian.ravel()])

        got = summed(patterns, p, width, score)
        pull = np.eye(k) * penalty
        pull[-1, -1] = 1e-6
        step = np.linalg.solve(got[k:].reshape(k, k) + pull, got[:k] + pull @ w)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Model:
    terms: list
    weights: np.ndarray
    labeler: LabelModel

    def kept(self, docs: DataFrame, text_col: str, threshold: float) -> DataFrame:
        """The rows, all columns, whose text scores under the threshold; null and empty texts are scored too."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voters = Voters(model.terms)
            for batch in batches:
                for part in text_chunks(batch, text_col):
                    votes = voters.votes(part.column(part.schema.get_field_index(text_col)).to_pylist())
                    yield part.filter(pa.array(sigmoid(inputs(*votes) @ model.weights) < threshold))

        return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, p: Params, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, toxic) of at most ``train_rows`` labelled documents outside the held-out rest."""
    key = F.col(id_col)
    known = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & ~held_out(key, p)).groupBy(key.alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(p.train_rows)  # bounded by train_rows: two numbers a row
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "toxic")


def mine_terms(train: DataFrame, p: Params) -> list[str]:
    """Words and word beginnings whose presence goes with label 1, by greedy covering.

    Each accepted term halves the weight of the rows that hold it, so the other words of a toxic
    text and of its copies don't become voters. The bounded training rows hold all there is to mine.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text", 256 << 10):
                seen: dict[bool, Counter] = {False: Counter(), True: Counter()}
                n = Counter()
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen[toxic > 0].update(features_of(text or ""))
                    n[toxic > 0] += 1
                keys = list(seen[False].keys() | seen[True].keys())
                sums = [pa.array([n[k], *(seen[k][x] for x in keys)], pa.int64()) for k in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(["", *keys]), *sums], names=["feature", "pos", "neg"])

    rows = train.select("text", "toxic")
    counts = rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    kept = counts.where((F.col("feature") == "") | ((F.col("pos") >= p.min_support) & (F.col("pos") >= p.min_precision * (F.col("pos") + F.col("neg")))))
    found = kept.collect()  # of the words of train_rows texts
    totals = next((r for r in found if r.feature == ""), None)
    if totals is None or not totals.pos or not totals.neg:
        return []
    names = sorted(r.feature for r in found if r.feature)
    place = {f: i for i, f in enumerate(names)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                held = [sorted(place[f] for f in features_of(text or "") if f in place) for text in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), part.column(1)], names=["held", "toxic"])

    gathered = rows.mapInArrow(incidence, "held array<int>, toxic int").collect() if names else []  # train_rows rows, the candidates that each holds
    return covering(names, [r.held for r in gathered], np.array([r.toxic > 0 for r in gathered]), p) if gathered else []


def covering(names: list[str], held: list[list[int]], toxic: np.ndarray, p: Params) -> list[str]:
    """Terms by greedy covering over the sparse table of which rows hold which names; ties go to the longer, then the greater name."""
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    column = np.fromiter((i for h in held for i in h), np.int64, len(row))
    base, weight, live = toxic.mean(), np.ones(len(held)), np.ones(len(names), bool)
    terms: list[str] = []
    while True:
        mine = weight[row]
        pos, n = (np.bincount(column, w, len(names)) for w in (mine * toxic[row], mine))
        share = np.clip(pos / np.maximum(n, 1e-9), 1e-9, 1 - 1e-7)
        gain = 2 * n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
        gain = np.round(np.where(live & (share >= p.min_precision) & (pos >= p.min_support), gain, 0), 3)
        best = max(np.flatnonzero(gain == gain.max()).tolist(), key=lambda i: (len(names[i]), names[i]))
        if gain[best] < p.min_gain:
            return terms
        terms.append(names[best])
        weight[row[column == best]] *= 0.5
        body = names[best][1:]  # what implies it, or is implied by it, has no say of its own
        live[[i for i in np.flatnonzero(live) if names[i][1:].startswith(body) or (names[i][0] == "^" and body.startswith(names[i][1:]))]] = False


def voted(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, bits, size) of every row: its votes, packed, and the size class of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                votes, size = voters.votes(part.column(1).to_pylist())
                bits = pa.array([x.tobytes() for x in np.packbits(votes, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), bits, pa.array(size)], names=["id", "bits", "size"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bits binary, size int")


def start_model(patterns: DataFrame, width: int, p: Params) -> LabelModel:
    """Where estimation begins: a kind of class 1 for each group of voters, with smoothed rates of the labelled rows in which the group speaks.

    Labels give the sign of class 1 and no more. Without labels of both classes a group's voters
    speak ten times as often in their kind as elsewhere.
    """
    got = summed(patterns, p, width, lambda votes, size, gold, n: np.concatenate([[n.sum()], ((votes * n[:, None]).T @ votes).ravel()]))
    found = groups(got[1:].reshape(width, width), got[0]) if len(got) else []
    kinds = found or [np.arange(width)]

    def score(votes, size, gold, n):
        rows = [n * (gold == 0)] + [n * (gold > 0) * (votes[:, g].any(1) | (len(kinds) == 1)) for g in kinds]
        return np.concatenate([np.concatenate([[w.sum()], w @ votes]) for w in rows])

    sums = summed(patterns, p, width, score)
    sums = sums.reshape(len(kinds) + 1, width + 1) if len(sums) else np.zeros((len(kinds) + 1, width + 1))
    rates, share = smoothed(sums)
    for k, g in enumerate(kinds, 1):
        if not sums[0, 0] or not sums[k, 0]:
            rates[k], share[k] = rates[0], 0.1 / len(kinds)
            rates[k, g] = np.clip(10 * np.maximum(rates[0, g], 0.01), 0, 0.5)
    return LabelModel(rates, share / share.sum(), np.ones(width), p.gold_accuracy)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and the votes (id, bits, size) of every document.

    Mine voters, let them vote on all documents, estimate the label model and fit the classifier
    over the table of vote patterns, which holds all documents and stays distributed. Only
    fixed-size results reach the driver: terms, and sums of voters x voters numbers.
    """
    small_batches(docs.sparkSession)
    train = cut(training_rows(docs, labels, p, id_col, text_col, label_col))
    mined = mine_terms(train, p)
    terms = mined + [t for t in ("=" + w for w in LEXICON) if t not in mined]
    votes = cut(voted(docs, terms, id_col, text_col))
    gold = F.broadcast(train.groupBy("id").agg(F.max("toxic").alias("gold")))  # at most train_rows ids
    counted = votes.join(gold, "id", "left").groupBy("bits", "size", F.coalesce("gold", F.lit(-1)).alias("gold")).agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    n = counted.count()
    patterns = counted.coalesce(max(1, -(-n // p.patterns_a_task)))
    width = len(terms) + len(PATTERNS)
    labeler = start_model(patterns, width, p)
    if not n:
        return Model(terms, np.zeros(width + 4), labeler), votes
    labeler = estimate(patterns, labeler, p)
    return Model(terms, fit_linear(patterns, labeler, p), labeler), votes


def score_documents(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every document, whole texts; texts are read once to vote.

    Null and empty texts are scored like any text without votes; repeated rows score alike; a null
    id is never held out and never learned from; labels of unknown ids and null labels are ignored;
    without labels the fixed lexicon votes alone; other columns are ignored; an empty table gives no rows.
    """
    model, votes = fit(docs, labels, p, id_col, text_col, label_col)
    width = len(model.labeler.voice)

    @F.pandas_udf("double")
    def score(bits: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(inputs(unpacked(bits, width), size.to_numpy()) @ model.weights)) if len(bits) else pd.Series([], dtype=float)

    scored = votes.select(F.col("id").alias("doc_id"), score("bits", "size").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), p).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows, all columns, that the classifier doesn't reject; null ids, null texts and repeated rows as in ``score_documents``."""
    model, _ = fit(docs, labels, p)
    return model.kept(docs, "text", p.threshold)
