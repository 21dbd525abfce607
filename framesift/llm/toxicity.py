"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

The lexicon is read off a bounded sample of labelled rows. The label model then estimates each voter's
accuracies and the voters' correlations from how they vote on all documents, and the classifier learns
from its posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.linear import fit_logistic, sigmoid
from framesift.llm.tables import fold_of, read, small_batches, uniform

SAMPLE = 4000  # labelled rows the lexicon and the classifier are fitted on, at most
STEMS, REPEATS = (4, 5, 6, 7), 3  # lengths of word beginnings that may stand in the lexicon; counted up to so many words
TERMS, VOTERS = 120, 20  # lexicon entries and lexicon voters, at most
MIN_TOXIC, MIN_RATIO = 6, 25.0  # toxic rows with a term; its share among toxic rows over that among others
FEATURES, MIN_ROWS = 1500, 4  # terms the classifier weighs, and rows each must occur in
PURE = 8  # toxic rows for each other row that a further term of a voter needs
TIED = 0.3  # correlation within a class from which two voters are modelled together
LETTERS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[!?]{3,}|\b[A-Z]{4,}\b")
ADDRESS = re.compile(r"\b(you|your|du|dein|tu|ton|toi|vous)\b", re.IGNORECASE)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def terms_of(words: set[str]) -> list[str]:
    """Words and word beginnings: "abcd*2" says that at least two different words begin so."""
    out = list(words)
    for n in STEMS:
        for stem, count in Counter([w[:n] for w in words if len(w) > n]).items():
            out += [f"{stem}*{k}" for k in range(1, min(count, REPEATS) + 1)]
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Different words, pattern votes and label of at most `sample` rows outside the held-out fold.

    The rows are chosen by the hash of their id. A repeated id counts once, toxic if any row says so.
    """
    taught = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold_of(F.col("doc_id")) != 0)
    chosen = taught.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(uniform(F.lit("toxic"), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["toxic"], pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string())),
                                              pa.array([pattern_votes(t) for t in texts], pa.int32())], ["doc_id", "toxic", "words", "patterns"])

    out = rows.mapInArrow(features, "doc_id long, toxic int, words array<string>, patterns int").toArrow().sort_by("doc_id")
    return [set(w) for w in out["words"].to_pylist()], out["patterns"].to_numpy(), out["toxic"].to_numpy()


def pattern_votes(text: str | None) -> int:
    """Bits of the pattern voters: shouting, and addressing the reader."""
    return bool(text and SHOUT.search(text)) + 2 * bool(text and ADDRESS.search(text))


def lexicon(rows: list[set[str]], toxic: np.ndarray) -> list[list[str]]:
    """Terms that mark toxic rows, dealt to at most VOTERS voters; beginnings and the words or longer
    beginnings that start with them share one."""
    seen = {0: Counter(), 1: Counter()}
    for words, label in zip(rows, toxic):
        seen[int(label)].update(terms_of(words))
    n_toxic, n_other = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    ratio = {t: (c / n_toxic) / ((seen[0][t] + 0.5) / n_other) for t, c in seen[1].items() if c >= MIN_TOXIC}
    best = sorted((t for t in ratio if ratio[t] >= MIN_RATIO), key=lambda t: (-seen[1][t] * np.log(ratio[t]), t))
    voters: list[list[str]] = []
    count = 0
    for term in best:
        stem = term.partition("*")[0]
        home = next((v for v in voters if any(stem.startswith(x) or x.startswith(stem) for x in (t.partition("*")[0] for t in v))), None)
        if home is not None:
            if PURE * seen[0][term] > seen[1][term]:
                continue  # a loose relative would blunt its voter
            home.append(term)
        elif len(voters) < VOTERS:
            voters.append([term])
        else:
            min(voters, key=len).append(term)
        count += 1
        if count == TERMS:
            break
    return voters


def voter_bits(voters: list[list[str]]):
    """A function from (words, pattern bits) to the bits of all votes."""
    whole, stems = {}, {}
    for i, voter in enumerate(voters):
        for term in voter:
            stem, star, count = term.partition("*")
            if star:
                stems.setdefault(stem, []).append((int(count), 1 << i))
            else:
                whole[term] = 1 << i
    lengths = sorted({len(x) for x in stems})

    def bits(words: set[str], patterns: int) -> int:
        out = int(patterns) << len(voters)
        for w in whole.keys() & words:
            out |= whole[w]
        for n in lengths:
            for stem, count in Counter([p for p in [w[:n] for w in words if len(w) > n] if p in stems]).items():
                for least, bit in stems[stem]:
                    if count >= least:
                        out |= bit
        return out

    return bits


def vote_counts(docs: DataFrame, voters: list[list[str]], text: str) -> dict[int, int]:
    """How often each pattern of votes occurs over all documents: at most 2 ** votes rows."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def count(batches):
        bits, seen = voter_bits(shared.value), Counter()
        for b in batches:
            seen.update(bits(words_of(t), pattern_votes(t)) for t in b["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["bits", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "bits long, n long")
    return {r[0]: r[1] for r in rows.groupBy("bits").agg(F.sum("n")).collect()}


class LabelModel:
    """Two classes and, in each, a table of vote patterns for every group of correlated voters.

    Fitted by expectation maximisation from the counts of all vote patterns, started from the labelled
    sample, whose rows stay what they are. Voters whose votes correlate within a class by more than TIED
    are one group, at most six wide; groups are independent given the class. A lexicon voter votes toxic
    or abstains: a group that is silent says nothing, but whether all are silent is a vote of its own.
    Pattern voters vote either way. A voter's accuracies are the margins of its group's tables.
    """

    def __init__(self, bits: np.ndarray, counts: np.ndarray, start_bits: np.ndarray, start: np.ndarray, lexical: int, votes: int):
        self.lexical = lexical
        x = (start_bits[:, None] >> np.arange(votes)) & 1
        self.groups = self.tie(x, start, range(lexical)) + [[v] for v in range(lexical, votes)]
        anchor = np.stack([1 - start, start], 1).astype(float)
        self.count(start_bits, anchor)
        for _ in range(25):
            before, p = self.prior, self.posterior(bits)
            self.count(np.concatenate([bits, start_bits]), np.concatenate([np.stack([1 - p, p], 1) * counts[:, None], anchor]))
            if abs(before - self.prior) < 1e-6:
                break

    @staticmethod
    def tie(x: np.ndarray, y: np.ndarray, voters: range) -> list[list[int]]:
        strength = np.zeros((x.shape[1], x.shape[1]))
        for label in (0, 1):
            part = x[y == label].astype(float)
            if len(part) > 2:
                part = part - part.mean(0)
                spread = np.sqrt((part * part).sum(0)) + 1e-9
                strength = np.maximum(strength, np.abs(part.T @ part) / spread[:, None] / spread[None, :])
        groups: list[list[int]] = []
        for v in voters:
            home = next((g for g in groups if len(g) < 6 and max(strength[v, u] for u in g) > TIED), None)
            home.append(v) if home is not None else groups.append([v])
        return groups

    def spoken(self, bits: np.ndarray) -> np.ndarray:
        return (bits & ((1 << self.lexical) - 1)) > 0

    def pattern(self, bits: np.ndarray, group: list[int]) -> np.ndarray:
        return sum(((bits >> v) & 1) << i for i, v in enumerate(group))

    def shares(self, at: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        table = np.stack([np.bincount(at, weights=weight[:, c], minlength=size) for c in (0, 1)]) + 0.5
        return table / table.sum(1, keepdims=True)

    def count(self, bits: np.ndarray, weight: np.ndarray) -> None:
        spoken = self.spoken(bits)
        self.prior = float(np.clip(weight[:, 1].sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.silence = self.shares(spoken.astype(int), weight, 2)
        self.tables = [self.shares(self.pattern(bits, g)[spoken], weight[spoken], 1 << len(g)) if g[0] < self.lexical
                       else self.shares(self.pattern(bits, g), weight, 1 << len(g)) for g in self.groups]

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        spoken = self.spoken(bits).astype(int)
        odds = np.log(self.prior / (1 - self.prior)) + np.log(self.silence[1, spoken] / self.silence[0, spoken])
        for g, t in zip(self.groups, self.tables):
            at = self.pattern(bits, g)
            says = np.log(t[1, at] / t[0, at])
            odds += np.where(at > 0, np.maximum(says, 0.0), 0.0) if g[0] < self.lexical else says
        return sigmoid(odds)


def features_of(words: set[str], bits: int, votes: int) -> list[str]:
    """Terms of a text and a feature of its own for each vote."""
    return terms_of(words) + [f"*vote{v}" for v in range(votes) if bits >> v & 1]


def chosen_features(rows: list[list[str]], target: np.ndarray) -> dict[str, int]:
    """The FEATURES terms, of at least MIN_ROWS rows each, whose presence tells most about the target."""
    weight, total = Counter(), Counter()
    for terms, p in zip(rows, target):
        total.update(terms)
        if p > 1e-3:
            for t in terms:
                weight[t] += p
    share, names = float(target.mean()), [t for t, n in total.items() if n >= MIN_ROWS]
    gain = {t: (weight[t] - total[t] * share) ** 2 / total[t] for t in names}
    return {t: i for i, t in enumerate(sorted(names, key=lambda t: (-gain[t], t))[:FEATURES])}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict | None:
    """Voters and classifier weights; None if the labelled sample lacks a class.

    The classifier is fitted on the sample's rows with the label model's posterior as target.
    """
    rows, patterns, toxic = sample_rows(docs, labels, sample)
    if not 0 < toxic.sum() < len(toxic):
        return None
    voters = lexicon(rows, toxic)
    votes, to_bits = len(voters) + 2, voter_bits(voters)
    own = np.array([to_bits(w, p) for w, p in zip(rows, patterns)], np.int64)
    counts = vote_counts(docs, voters, text)
    model = LabelModel(np.array(list(counts), np.int64), np.array(list(counts.values()), float), own, toxic, len(voters), votes)
    target = model.posterior(own)
    terms = [features_of(w, b, votes) for w, b in zip(rows, own)]
    place = chosen_features(terms, target)
    slots = [[place[t] for t in ts if t in place] for ts in terms]
    index = np.array([i for s in slots for i in s], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in slots])])
    w, b = fit_logistic(starts, index, np.ones(len(index)), target, len(place), l2=1e-4, steps=150, rate=0.3)
    return {"voters": voters, "weights": {t: float(w[i]) for t, i in place.items()}, "b": b}


def scored(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every document, from its whole text alone; empty and null texts get the score of
    no words, and without a model every score is 0."""
    small_batches(docs.sparkSession)
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()

    def score(batches):
        m = shared.value
        if m:
            bits, votes, weigh = voter_bits(m["voters"]), len(m["voters"]) + 2, m["weights"].get
        for b in batches:
            out = []
            for t in b["_text"].to_pylist():
                words = words_of(t)
                known = filter(None, map(weigh, features_of(words, bits(words, pattern_votes(t)), votes))) if m else ()
                out.append(float(sigmoid(m["b"] + fsum(known))) if m else 0.0)  # fsum: the same sum in any order
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(out, pa.float64())], ["_key", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(score, f"_key {kind}, score double")
    return rows.withColumnRenamed("_key", key)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
