"""Toxicity by a weighted finite-state pattern grammar over clauses.

Acceptors map words to classes: insult, threat, intent, target, negation, report, other.  Five
transducers are composed, each relabelling what the one before it wrote: insults become hits;
threat words become hits where an intent opened them; a hit near a target is aimed; a
hit inside a negation's reach is denied; a hit after a verb of speaking is reported.  Each label of
the composed grammar has its own weight, fitted on the labelled texts' clauses around a prior in
which denied hits count nothing and reported ones little.

Insults are learned from labelled rows as words and word beginnings, with log-odds weights, so
that inflected and compounded forms of any language match; the other classes are short lists.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, labelled_sample, logistic, new_name, table

#: Bound of the training sample: rows for each class; their texts are read whole.
TRAIN_ROWS = 2500
STEM_LENGTHS = (4, 5, 6, 7, 8)

TARGETS = frozenset("you your yours yourself u he she him her they them du dich dir ihr euch sie tu te toi vous ils elle tú ti usted ustedes él ella".split())
NEGATIONS = frozenset("not never no nor without isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais ni nunca tampoco".split())
REPORTS = frozenset("said says say wrote writes claimed claims quoted reported alleged called sagte schrieb behauptete nannte dit écrit déclara dijo escribió afirmó".split())
THREATS = frozenset("kill murder destroy hurt beat stab shoot töten umbringen tuer frapper matar golpear".split())
INTENTS = frozenset("will shall gonna going i'll we'll must want werde werden will vais allons vamos voy".split())
CLAUSE = re.compile(r"[.!?;:\n]+")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
#: Hits are symbols from here on: HIT plus the bits of their labels.
HIT = 7
IS_THREAT, AIMED, DENIED, REPORTED = 1, 2, 4, 8
LABELS = 16
SYMBOLS = HIT + LABELS
#: What the transducers of a hit multiply its weight by before any label has been seen.
PRIOR = {AIMED: 2.0, DENIED: 0.0, REPORTED: 0.2}
#: Weight of a threat word, on the scale of the insults' log-odds, and how far labels may move the prior.
THREAT_WEIGHT, LOOSENESS = 7.0, 0.02


class Transducer:
    """Deterministic: arcs[state][symbol read] = (next state, symbol written)."""

    def __init__(self, arcs: list[list[tuple[int, int]]]):
        self.arcs = arcs

    def compose(self, after: "Transducer") -> "Transducer":
        """Reads like this one; what it writes is read by ``after``, which writes the result."""
        n, arcs = len(after.arcs), []
        for mine in self.arcs:
            for theirs in after.arcs:
                arcs.append([(a * n + theirs[w][0], theirs[w][1]) for a, w in mine])
        return Transducer(arcs)

    def read(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, w = self.arcs[state][s]
            out.append(w)
        return out


def insults() -> Transducer:
    return Transducer([[(0, HIT if s == INSULT else s) for s in range(SYMBOLS)]])


def within(trigger: int, reach: int, write) -> Transducer:
    """Writes ``write(symbol)`` for ``reach`` words after ``trigger``, and every other symbol as it is."""
    return Transducer([[(reach if s == trigger else max(0, left - 1), write(s) if left else s) for s in range(SYMBOLS)] for left in range(reach + 1)])


def threats(reach: int = 4) -> Transducer:
    """A threat word becomes a hit only where an intent was stated shortly before."""
    return within(INTENT, reach, lambda s: HIT + IS_THREAT if s == THREAT else s)


def marked(trigger: int, reach: int, bit: int) -> Transducer:
    return within(trigger, reach, lambda s: HIT + (s - HIT | bit) if s >= HIT else s)


def grammar() -> tuple[Transducer, Transducer]:
    """The composed transducer, read from left to right, and the target's, which also reads back from right to left."""
    target = marked(TARGET, 4, AIMED)
    return insults().compose(threats()).compose(target).compose(marked(NEGATION, 3, DENIED)).compose(marked(REPORT, 8, REPORTED)), target


def prior(label: int) -> float:
    out = 1.0
    for bit, factor in PRIOR.items():
        out *= factor if label & bit else 1.0
    return out


@dataclass(frozen=True)
class ToxicityModel:
    stems: dict[str, float]
    weights: tuple[float, ...]
    intercept: float


def without_copies(sample: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Drop exact and most near copies (a shared least hash of word triples), whose rare words would look typical of a class."""
    seen, kept = set(), []
    for y, text in sample:
        words = text.lower().split()
        triples = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
        keys = {(seed, min(zlib.crc32(t, seed) for t in triples)) for seed in (1, 2, 3)}
        if not keys & seen:
            kept.append((y, text))
        seen |= keys
    return kept


def learn_stems(sample: list[tuple[int, str]], least_ratio: float = 20.0) -> dict[str, float]:
    """Word beginnings (and whole words, ended by a space) far commoner in toxic rows, with their log-odds.

    A beginning is kept only if no shorter kept one already covers it at least as purely.
    """
    import math

    df = (Counter(), Counter())
    n = [0, 0]
    for y, text in sample:
        n[y] += 1
        words = set(WORDS.findall(text.lower()))
        df[y].update({w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k} | {w + " " for w in words})
    if not n[0] or not n[1]:
        return {}
    least = max(3, n[1] // 60)
    odds = {}
    for s, a in df[1].items():
        b = df[0][s]
        if a >= least and a / n[1] >= least_ratio * (b + 0.5) / n[0]:
            odds[s] = math.log((a + 0.5) / n[1]) - math.log((b + 0.5) / n[0])
    kept: dict[str, float] = {}
    for s in sorted(odds, key=lambda s: (len(s), s)):
        shorter = [s[:k] for k in STEM_LENGTHS if k < len(s) and s[:k] in kept]
        if not shorter or odds[s] > max(kept[x] for x in shorter) + 1.0:
            kept[s] = odds[s]
    # the longest form with nearly the same toxic rows is the safest name for a stem
    grown = {}
    for s in kept:
        longer = [t for t in odds if t.startswith(s) and df[1][t] >= 0.98 * df[1][s]]
        best = max(longer, key=lambda t: (len(t), t), default=s)
        grown[best] = max(kept[s], odds[best])
    return grown


class ClauseScorer:
    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.forward, self.backward = grammar()
        starts = [re.escape(s.strip()) + (r"(?![^\W_])" if s.endswith(" ") else "") for s in sorted(stems, key=lambda s: (-len(s), s))]
        starts += [re.escape(t) + r"(?![^\W_])" for t in sorted(THREATS)]
        self.hit = re.compile(r"(?<![^\W_])(?:" + "|".join(starts) + ")")

    def _class(self, word: str) -> tuple[int, float]:
        best = self.stems.get(word + " ", 0.0)
        for k in STEM_LENGTHS:
            if len(word) >= k:
                best = max(best, self.stems.get(word[:k], 0.0))
        if best:
            return INSULT, best
        for words, c, w in ((THREATS, THREAT, THREAT_WEIGHT), (INTENTS, INTENT, 0.0), (TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0)):
            if word in words:
                return c, w
        return OTHER, 0.0

    def clauses(self, text: str) -> list[list[tuple[int, float]]]:
        """The hits, as (label, weight), of each clause that has any; only clauses around an insult or a threat word are read."""
        low, out, done = text.lower(), [], 0
        for m in self.hit.finditer(low):
            if m.start() < done:
                continue
            start = done
            for stop in ".!?;:\n":
                start = max(start, low.rfind(stop, start, m.start()) + 1)
            end = CLAUSE.search(low, m.start())
            done = end.end() if end else len(low)
            tagged = [self._class(w) for w in WORDS.findall(low, start, done)]
            written = self.forward.read([c for c, _ in tagged])
            written = self.backward.read(written[::-1])[::-1]
            hits = [(s - HIT, w) for s, (_, w) in zip(written, tagged, strict=True) if s >= HIT]
            if hits:
                out.append(hits)
        return out

    def features(self, text: str) -> list[float]:
        """Summed weights of the hits of each label over the clauses of the whole text."""
        x = [0.0] * LABELS
        for clause in self.clauses(text) if text else ():
            for label, w in clause:
                x[label] += w
        return x


def fit_weights(x, y, weight) -> tuple[tuple[float, ...], float]:
    """A weight for each label and the intercept: a common scale of the prior, from which labels depart as the data ask.

    Departures are held back by the ridge, so a label that the labelled texts hardly show keeps its prior.
    """
    import numpy as np

    p = np.array([prior(k) for k in range(LABELS)])
    fitted = logistic(np.column_stack([x @ p, LOOSENESS * x]), y, weight)
    scale = max(float(fitted[0]), 0.0)
    weights = np.maximum(scale * p + LOOSENESS * fitted[1:-1], 0.0)
    return tuple(map(float, weights)), float(fitted[-1])


def train(sample: list[tuple[int, str]], totals: dict[int, int]) -> ToxicityModel:
    """Stems from the sample, then label weights on out-of-fold features; with one class, its share is every score."""
    import numpy as np

    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    sample = without_copies(sample)
    ys = [y for y, _ in sample]
    if min(ys.count(0), ys.count(1)) < 3:
        return ToxicityModel({}, (0.0,) * LABELS, float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else 0.0)
    xs, y = [], []
    halves = [[r for label in (0, 1) for r in [r for r in sample if r[0] == label][part::2]] for part in range(2)]
    for own, other in (halves, halves[::-1]):
        scorer = ClauseScorer(learn_stems(other))
        xs += [scorer.features(text) for _, text in own]
        y += [float(label) for label, _ in own]
    y = np.array(y)
    weight = np.where(y == 1, n1 / ys.count(1), n0 / ys.count(0))
    weights, intercept = fit_weights(np.array(xs), y, weight * len(y) / weight.sum())
    return ToxicityModel(learn_stems(sample), weights, intercept)


def log_odds(scorer: ClauseScorer, model: ToxicityModel, text: str | None) -> float:
    return model.intercept + sum(w * x for w, x in zip(model.weights, scorer.features(text or ""), strict=True))


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score from 0 to 1; null and empty texts have no clause and get the fitted base value."""

    @F.pandas_udf(T.DoubleType())
    def score(s):
        import numpy as np
        import pandas as pd

        scorer = ClauseScorer(model.stems)
        x = np.array([log_odds(scorer, model, t) for t in s], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    return score(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows_per_class: int = TRAIN_ROWS) -> ToxicityModel:
    allowed = fold(F.col("doc_id"), 5) != 0 if allowed is None else allowed
    return train(*labelled_sample(docs, labels, "toxic", allowed, rows_per_class))


def score_toxicity(docs: DataFrame, labels: DataFrame, out: str = "toxicity_score", **bounds) -> DataFrame:
    """All rows and columns of ``docs`` plus the score in column ``out``, which must be new.

    Null and empty texts get the base score, repeated rows and null ids are scored like others, whole texts of any
    length are read, and an empty table gives an empty result.
    """
    return docs.withColumn(new_name(docs, out), toxicity_score(F.col("text"), fit_toxicity(docs, labels, **bounds)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the base score, null ids are not held out, repeated rows and ties get equal scores, very
    long texts are read whole, an empty table gives no rows, and other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )
