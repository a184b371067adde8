"""A classifier of abusive, hateful and lewd passages that does not hang on who is spoken of."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .passages import pieces, words
from .plainwriting import DISGUISE, MASK, plain

# Names of groups of people, as far as they are known beforehand; others are found in the labelled texts.
GROUPS = (
    "women men girls boys gays lesbians homosexuals jews muslims christians catholics hindus blacks whites asians arabs turks poles"
    " gypsies roma immigrants migrants refugees foreigners natives disabled frauen männer juden muslime türken polen ausländer flüchtlinge"
    " femmes juifs musulmans arabes étrangers immigrés mujeres judíos musulmanes moros extranjeros inmigrantes"
).split()

#: The usual threshold on the log-odds of a passage, and the abusive texts that it counts as.
PRIOR_THRESHOLD, PRIOR_TEXTS = -1.5, 20

#: The abusive texts that a feature must stand in to speak for abuse: a wrong label makes what stands in one text heavy.
LEAST_TEXTS = 2

#: What a passage of an abusive text counts as a sound one where another passage clearly earned the label.
OTHERS = 0.5

#: How much an n-gram counts beside a word or a pair of words.
GRAM_SHARE = 0.3

_NAME = re.compile(r"(?<=[a-zß-ÿ,] )[A-ZÀ-Þ][a-zß-ÿ]+")
_SMALL = re.compile(r"(?<=[a-zß-ÿ,] )[a-zß-ÿ]+")
_BITS = np.uint64(45)  # 2 ** 19 places of the first test of a feature


@dataclass(frozen=True)
class Model:
    """score of a passage = bias + the weights of its features; a text scores as its worst passage.

    Features are words, pairs of neighbouring words and character n-grams of words, each once in a passage, known by
    64-bit hashes in ascending order. A passage without any feature of the model scores the bias.
    """

    bias: float
    features: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    groups: tuple[str, ...] = field(default=())

    @cached_property
    def _known(self) -> np.ndarray:
        known = np.zeros(1 << 19, bool)
        known[self.features >> _BITS] = True
        return known

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The log-odds of the worst passage of each text, the bias at least."""
        out = np.full(len(texts), self.bias)
        if not self.features.size:
            return out
        for places, part in pieces([plain(t) if t else "" for t in texts]):
            w = words(part)
            hashes, at = w.features()
            maybe = np.flatnonzero(self._known[hashes >> _BITS])
            i = np.searchsorted(self.features, hashes[maybe])
            i[i == self.features.size] = 0
            true = self.features[i] == hashes[maybe]
            once = np.unique(at[maybe[true]] * self.features.size + i[true])
            passage, i = np.divmod(once, self.features.size)
            if passage.size:
                number, first = np.unique(passage, return_index=True)
                np.maximum.at(out, np.array(places)[w.doc[number]], self.bias + np.add.reduceat(self.weights[i], first))
        return out

    def weight(self, said: str) -> float:
        """The weight of a word, or of a pair of words, in plain writing."""
        w = words([said])
        i = int(np.searchsorted(self.features, (w.pair if w.pair.size else w.word)[0])) if w.word.size else self.features.size
        return float(self.weights[i]) if i < self.features.size and self.features[i] == (w.pair if w.pair.size else w.word)[0] else 0.0

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


@dataclass
class _Sample:
    """The distinct passages of labelled texts, their features, and the texts that hold them."""

    passages: list[str]
    owners: list[np.ndarray]  # passages of each text
    hashes: np.ndarray  # distinct features, ascending
    row: np.ndarray  # passage and feature, sorted by passage
    col: np.ndarray
    is_gram: np.ndarray  # of each feature


def _features(passages: list[str], offset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """passage, hash and whether it is an n-gram, once each."""
    rows, hashes, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for places, part in pieces(passages):
        w = words(part)
        h, at = w.features()
        at = np.array(places, np.int64)[w.doc[at]] if h.size else at
        gram = np.arange(h.size) >= w.word.size + w.pair.size
        order = np.lexsort((h, at))
        new = np.ones(h.size, bool)
        new[1:] = (np.diff(at[order]) != 0) | (np.diff(h[order]) != 0)
        rows.append(at[order][new] + offset)
        hashes.append(h[order][new])
        grams.append(gram[order][new])
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(grams)


def _sample(texts: list[str | None], y: np.ndarray) -> _Sample:
    """Features that stand in one passage only are left out, and n-grams that stand in less than LEAST_TEXTS abusive texts."""
    known: dict[str, int] = {}
    owners: list[list[int]] = [[] for _ in texts]
    for places, part in pieces([plain(t) if t else "" for t in texts]):
        w = words(part)
        for doc, p in zip(w.doc.tolist(), w.passages(), strict=True):
            owners[places[doc]].append(known.setdefault(" ".join(p.split()), len(known)))
    own = [np.unique(np.array(o, np.int64)) for o in owners]
    passages = list(known)
    row, hashes, gram = _features(passages)
    names, col = np.unique(hashes, return_inverse=True)
    is_gram = np.zeros(names.size, bool)
    is_gram[col[gram]] = True
    held = np.bincount(np.concatenate([np.empty(0, np.int64), *own]), minlength=len(passages))
    bad = _in_texts(row, col, [o for o, v in zip(own, y, strict=True) if v], names.size)
    keep = (np.bincount(col, held[row], names.size) > 1) & (~is_gram | (bad >= LEAST_TEXTS))
    new = np.cumsum(keep) - 1
    row, col = row[keep[col]], new[col[keep[col]]]
    return _Sample(passages, own, names[keep], row, col, is_gram[keep])


def _in_texts(row: np.ndarray, col: np.ndarray, owners: list[np.ndarray], size: int) -> np.ndarray:
    """How many of the texts hold each feature; row is sorted."""
    out = np.zeros(size)
    last = int(row[-1]) + 1 if row.size else 0
    ends = np.searchsorted(row, np.arange(last + 1))
    for own in owners:
        held = [col[ends[i] : ends[i + 1]] for i in own if i < last]
        if held:
            out[np.unique(np.concatenate(held))] += 1
    return out


def find_groups(passages: list[str], in_bad: np.ndarray, in_good: np.ndarray, names: set[str], known: Iterable[str] = GROUPS, least: int = 3, shares: int = 2) -> list[str]:
    """Names that stand in the same places as each other in abusive texts and not in others: groups that are spoken of.

    A place is a pair of neighbours. Names are taken that share at least ``shares`` places with another name, where these
    places occur in ``least`` abusive texts or more and four times as often as in others. in_bad, in_good: the texts of
    either kind that hold each passage. names: words that are mostly written with a capital within a sentence.
    """
    bad, good = Counter(), Counter()
    fillers: dict[tuple[str, str], set[str]] = {}
    for p, b, g in zip(passages, in_bad, in_good, strict=True):
        said = p.split(" ")
        if b:
            for a, w, c in zip(said, said[1:], said[2:], strict=False):
                bad[a, c] += int(b)
                if w in names:
                    fillers.setdefault((a, c), set()).add(w)
    for p, g in zip(passages, in_good, strict=True):
        if g:
            said = p.split(" ")
            for at in zip(said, said[2:], strict=False):
                if at in fillers:
                    good[at] += int(g)
    shared: dict[str, Counter] = {}
    for place, held in fillers.items():
        if len(held) > 1 and bad[place] >= max(least, 4 * good[place]):
            for w in held:
                shared.setdefault(w, Counter()).update(held - {w})
    found = {w for w, c in shared.items() if max(c.values()) >= shares and w not in (MASK, DISGUISE)}
    return sorted(found | set(known))


def train(texts: list[str | None], labels: list[int], *, rounds: int = 4, steps: int = 60, ridge: float = 0.003, swap: float = 2.0, groups: Iterable[str] | None = None, seed: int = 5) -> Model:
    """Fit a model on texts with noisy labels (1: some passage is abusive, 0: none). No word is known to be abusive beforehand.

    The label of a text says nothing about which passage earned it: each round, the worst passage of each abusive text
    (at first by how much more often its features are in abusive texts) and all passages of the others are fitted by
    logistic regression. Counterfactual regularisation: for passages that name a group, the same passage about another
    group is made, and the squared change of the score is penalised with the weight ``swap``; where a group is named
    without abuse or with it, the name itself thus carries next to nothing. A feature that stands in fewer than
    LEAST_TEXTS abusive texts can't speak for abuse, only against it.

    Texts may be None, empty or of any length. Without both kinds of labels the model scores everything below its
    threshold.
    """
    y = np.asarray(labels, bool)
    if not y.any() or y.all():
        return Model(-9.0, np.empty(0, np.uint64), np.empty(0))
    s = _sample(texts, y)
    n, size = len(s.passages), s.hashes.size
    in_bad, in_good = np.zeros(n), np.zeros(n)
    for own, v in zip(s.owners, y, strict=True):
        (in_bad if v else in_good)[own] += 1
    names = sorted(set(groups)) if groups is not None else find_groups(s.passages, in_bad, in_good, capitalised(texts))
    row, col = s.row, s.col
    value = np.where(s.is_gram, GRAM_SHARE, 1.0)

    # how much more often than by chance a feature is in abusive texts
    bad = _in_texts(row, col, [o for o, v in zip(s.owners, y, strict=True) if v], size)
    good = _in_texts(row, col, [o for o, v in zip(s.owners, y, strict=True) if not v], size)
    rate = y.mean()
    odds = np.log((bad + 3 * rate) / (bad + good + 3) / rate)
    excess = (bad - (bad + good) * rate) / np.sqrt((bad + good) * rate * (1 - rate) + 1)
    told = np.where((bad >= LEAST_TEXTS) & (excess >= 1.5) & ~s.is_gram, odds, 0.0)
    length = np.maximum(1, np.bincount(row, ~s.is_gram[col], n))
    score = np.bincount(row, told[col], n) / np.sqrt(length) - 2.0  # a sentence that repeats word by word is evidence once

    ra, ca, rb, cb = _swapped(s, names, np.random.default_rng(seed))
    pairs = max(ra.max(initial=-1), rb.max(initial=-1)) + 1

    common = (in_good >= 2) & (in_bad < 3 * in_good)  # what sound texts hold as well did not earn the label
    w, bias = np.zeros(size), -6.0
    below = bad < LEAST_TEXTS
    x = value[col]
    for turn in range(rounds):
        positive, rest = np.zeros(n), np.zeros(n)
        for own, v in zip(s.owners, y, strict=True):
            if v:
                may = own[~common[own] & (score[own] > 0 if turn == 0 else score[own] > -1)]
                if may.size:  # else the label is taken for an error
                    best = may[np.argmax(score[may])]
                    positive[best] += 1
                    rest[own[score[own] < score[best] - 2]] += OTHERS
        weight_bad, weight_good = positive, np.sqrt(in_good + rest)
        total = weight_bad.sum() + weight_good.sum()
        slope, spread = np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, steps + 1):
            q = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, (w * value)[col], n), -30, 30)))
            d = (weight_good + weight_bad) * q - weight_bad
            grad = np.bincount(col, d[row] * x, size)
            if swap and pairs:
                own = w * value
                gap = np.bincount(ra, own[ca], pairs) - np.bincount(rb, own[cb], pairs)
                grad += swap * value * (np.bincount(ca, gap[ra], size) - np.bincount(cb, gap[rb], size))
            grad += ridge * total * w / 100
            grad = np.append(grad, d.sum())
            slope = 0.9 * slope + 0.1 * grad
            spread = 0.99 * spread + 0.01 * grad**2
            move = slope / (1 - 0.9**step) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8) * (0.12 * (1 - step / steps) + 0.003)
            w -= move[:-1]
            w[below] = np.minimum(w[below], 0)
            bias -= move[-1]
        score = bias + np.bincount(row, (w * value)[col], n)
    worst = np.array([score[own].max(initial=bias) for own in s.owners])
    few = PRIOR_TEXTS / (PRIOR_TEXTS + int(y.sum()))  # a threshold fitted on few abusive texts is drawn to the usual one
    threshold = max((1 - few) * best_threshold(worst, y) + few * PRIOR_THRESHOLD, bias + 0.1)
    heavy = np.abs(w * value) > 0.02
    return Model(float(bias), s.hashes[heavy], (w * value)[heavy], float(threshold), tuple(names))


def _swapped(s: _Sample, names: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of the passages that name a group, and of the same ones about another group."""
    group = set(names)
    first, second = [], []
    if len(names) > 1:
        for p in s.passages:
            said = p.split(" ")
            if not group.isdisjoint(said):
                first.append(p)
                second.append(" ".join(names[rng.integers(len(names))] if x in group else x for x in said))

    def known(passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        row, hashes, _ = _features(passages)
        i = np.searchsorted(s.hashes, hashes)
        i[i == s.hashes.size] = 0
        true = s.hashes[i] == hashes if s.hashes.size else np.zeros(i.size, bool)
        return row[true], i[true]

    return *known(first), *known(second)


def capitalised(texts: Iterable[str | None], share: float = 0.6) -> set[str]:
    """Words that stand within a sentence, written with a capital in at least that share of all their places."""
    high, low = Counter(), Counter()
    for t in texts:
        high.update(_NAME.findall(t or ""))
        low.update(_SMALL.findall(t or ""))
    return {w.lower() for w, n in high.items() if n >= share * (n + low[w.lower()])}


def best_threshold(scores: np.ndarray, labels: np.ndarray, tolerance: float = 0.015) -> float:
    """In the range of thresholds around the best one at which F1 is within tolerance of the best, a fifth from its low end.

    Wrong labels and small samples move the best one at random within that range; and passages that the model was not
    fitted on score lower than those that it was.
    """
    order = np.argsort(-scores, kind="stable")
    s = scores[order]
    f1 = 2 * np.cumsum(labels[order]) / (np.arange(1, len(order) + 1) + labels.sum())
    cut = np.append(s[1:] < s[:-1], True)  # a threshold can't part equal scores
    k = int(np.argmax(np.where(cut, f1, -1)))
    fine = np.where(cut, f1 >= f1[k] * (1 - tolerance), True)
    first = k - int(np.argmin(fine[: k + 1][::-1])) + 1 if not fine[: k + 1].all() else 0
    last = k + int(np.argmin(fine[k:])) - 1 if not fine[k:].all() else len(s) - 1
    first, last = next(i for i in range(first, k + 1) if cut[i]), next(i for i in range(last, k - 1, -1) if cut[i])
    below = lambda i: (s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1.0
    return float(0.2 * below(first) + 0.8 * below(last))


#: Labelled documents that a model is fitted on, at most, and characters of their texts.
MOST_LABELLED, MOST_CHARACTERS = 8000, 1 << 26


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "abusive", most: int = MOST_LABELLED, most_characters: int = MOST_CHARACTERS, **how) -> Model:
    """A model fitted on at most ``most`` labelled documents with at most most_characters in all, by hashes of their keys.

    The label of a document is what most of its readers said; null labels and ties say nothing. Whole texts are read; a
    text that alone has more than most_characters is not drawn. One task fits the model, which alone goes to the driver.
    """
    said = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("said")).where("said <> 0.5")
    drawn = said.orderBy(F.xxhash64(key), key).limit(most)
    order = W.partitionBy("one").orderBy(F.xxhash64("key"), "key")  # of the drawn ones alone
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") <= most_characters)
    held = held.join(F.broadcast(drawn.select(F.col(key).alias("key"), "said")), "key").withColumn("one", F.lit(1))
    held = held.where(F.col("text").isNotNull()).withColumn("so_far", F.sum(F.length("text")).over(order)).where(F.col("so_far") <= most_characters)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        m = train(rows["text"].tolist(), (rows["said"] > 0.5).astype(int).tolist(), **how)
        return pd.DataFrame([[m.bias, m.features.tobytes(), m.weights.tobytes(), m.threshold, list(m.groups)]], columns=["bias", "features", "weights", "threshold", "groups"])

    fitted = held.select("one", F.struct(F.xxhash64("key").alias("h"), "key").alias("k"), "text", "said").withColumn("place", F.row_number().over(W.partitionBy("one").orderBy("k"))).drop("k")
    got = fitted.groupBy("one").applyInPandas(one, "bias double, features binary, weights binary, threshold double, groups array<string>").collect()
    if not got:
        return train([], [])
    m = got[0]
    return Model(m["bias"], np.frombuffer(bytes(m["features"]), np.uint64), np.frombuffer(bytes(m["weights"])), m["threshold"], tuple(m["groups"]))


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """docs without the text, with score: the log-odds of the worst passage less the threshold (above 0: abusive).

    Null and empty texts score as a text without any suspicious word. One pass without an exchange; other columns stay.
    """
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = model.scores(part.column(len(keep)).to_pylist()) - model.threshold
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*[F.col(c) for c in keep], text).mapInArrow(run, f"{schema}, `{column}` double")
