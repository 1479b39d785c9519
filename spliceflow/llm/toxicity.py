"""Toxicity by maximum-scoring segments over token log-odds.

A word's tokens are its beginnings of a few lengths and the whole word, so that inflected and compounded forms share what is learned of
their stem; scripts that don't part words give a token for each character. Training counts them in toxic and other labelled documents and
turns them into log-odds with a Dirichlet prior, less two standard errors. A word scores as its best token, unless a longer one is known
as clean; one without scores a constant below zero such that a segment's expected score is negative. A text's toxic passages are its
maximal-scoring segments (linear time), significant ones being those whose extreme-value (Karlin-Altschul) expectation in a text of that
length is small. The least expectation, the number of significant passages and the sum of the scores are calibrated to a probability on
training rows that the counts haven't seen.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import cut, frame

#: Strength of the prior: pseudo-counts shared out by the tokens' overall frequency, and their most as a share of all counts.
PRIOR = 500.0
PRIOR_SHARE = 0.01
#: Least pseudo-count of a token: a token that one class lacks then has a finite standard error.
PRIOR_LEAST = 0.5
#: Standard errors that are taken off a token's log-odds.
MIN_Z = 2.0
#: What must at least be left for a token to enter the model. Each of these is tried on the calibration rows.
ODDS = (0.0, 0.7, 1.2, 1.7, 2.2)
#: Labelled rows used for fitting, at most about: a sample by hash where there are more. Their ids are sent to the tasks.
TRAINING_ROWS = 200_000
#: One in so many of them is kept from the counts and used for calibration.
CALIBRATION = 4
#: Expected chance segments at which a passage still counts as significant.
MAX_E = 0.05
CUTOFF = 0.3
#: Lengths of a word's beginnings: each up to 8, then farther apart, so that all of a word's tokens are at most a few times its length.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128)
#: Tokens that a task counts before it hands them on.
COUNTED = 150_000
#: Ends the token of a whole word; no word holds it.
WHOLE = "$"
#: Toxic documents that a token must be in to be taken into the model as a sign of toxicity, and documents for one of the opposite.
MIN_DOCS = 5
COUNTS = "token string, n0 long, n1 long, c0 long, c1 long"
PASSAGES = "doc_id long, first_word long, end_word long, score double, expected double, words string"
#: Thai to Burmese and Khmer, kana, Han and Hangul, which are read by the character.
_UNPARTED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORD, _CHARACTER, _ANY = re.compile(r"\w+"), re.compile(f"[{_UNPARTED}]"), re.compile(f"[{_UNPARTED}]|[^{_UNPARTED}]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased; single characters of scripts that don't part words."""
    if not isinstance(text, str):
        return []
    words = _WORD.findall(text.lower())
    if text.isascii() or not _CHARACTER.search(text):
        return words
    return [part for word in words for part in _ANY.findall(word)]


def tokens(word: str) -> list[str]:
    """The beginnings of a word, shortest first, and the whole of it."""
    out = [word[:n] for n in BEGINNINGS[: bisect_left(BEGINNINGS, len(word))]]
    out.append(word + WHOLE)
    return out


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Token scores (0 for a token that is known as clean), score of any other word, Karlin-Altschul lambda and K, calibration weights."""

    scores: dict
    other: float
    rate: float
    scale: float
    weights: tuple = (0.0, 0.0, 0.0, 0.0)
    heads: frozenset = frozenset()

    def word_score(self, word: str) -> float | None:
        """The best of its tokens down from the longest; a clean one ends the search."""
        best = None
        for token in reversed(tokens(word)):
            s = self.scores.get(token)
            if s == 0:
                break
            if s is not None and (best is None or s > best):
                best = s
        return best

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment (from, to, score), in order of place: linear in the number of words."""
        heads, seen, stack, total, at = self.heads, {}, [], 0.0, 0
        for k, word in enumerate(words):
            if word[:3] not in heads:
                continue
            if word not in seen:
                seen[word] = self.word_score(word)
            s = seen[word]
            if s is None:
                continue
            total += self.other * (k - at)
            at = k + 1
            if s <= 0:
                total += s
                continue
            # Each entry: left sum, right sum, from, to.
            left, start = total, k
            total += s
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= left:
                    j = stack[j][4]
                if j < 0 or stack[j][1] >= total:
                    stack.append((left, total, start, k + 1, j))
                    break
                left, start = stack[j][0], stack[j][2]
                del stack[j:]
        return [(a, b, right - left) for left, right, a, b, _ in stack]

    def features(self, words: list[str]) -> tuple[float, float, float]:
        """Minus log10 of the least expectation, number of significant passages and sum of all scores, each as log(1 + x)."""
        found = self.segments(words)
        if not found:
            return 0.0, 0.0, 0.0
        chance = np.log(self.scale * len(words)) - self.rate * np.array([s for _, _, s in found])
        good = int((chance <= np.log(MAX_E)).sum())
        return float(np.log1p(max(0.0, -chance.min() / np.log(10)))), float(np.log1p(good)), float(np.log1p(sum(s for _, _, s in found)))

    def probability(self, words: list[str]) -> float:
        b, *w = self.weights
        x = b + sum(x * y for x, y in zip(w, self.features(words), strict=True))
        return float(1 / (1 + np.exp(-x))) if x > -700 else 0.0


def _karlin(values: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """lambda > 0 with E[exp(lambda * score)] = 1, and a bound on K, under the background distribution of scores."""
    low, high = 1e-6, 1.0
    moment = lambda x: float((weight * np.exp(np.minimum(x * values, 700))).sum())
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    rate = (low + high) / 2
    drift = -float((weight * values).sum())
    return rate, drift / max(float((weight * np.maximum(values, 0)).sum()) + drift, 1e-9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """The model from the labelled documents that aren't held out.

    Labels other than 0 and 1, null labels and labels of ids that documents lack are passed over. Without rows of both classes the
    model gives every text the share of toxic labels (0.0 without labels).
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(toxic_col).cast("int").alias("toxic")).where("toxic in (0, 1) and __id is not null").where(~held_out(F.col("__id")))
    known = cut(known.groupBy("__id").agg(F.max("toxic").alias("toxic")).withColumn("__draw", F.pmod(F.xxhash64("__id"), F.lit(1 << 30))))
    kept = min(1.0, TRAINING_ROWS / max(known.count(), 1))
    known = known.where(F.col("__draw") < int(kept * (1 << 30)))
    # A bounded list of ids: the texts stay where they are.
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id").drop("__id")
    labelled = labelled.withColumn("part", (F.col("__draw") % CALIBRATION == 0).cast("int")).drop("__draw")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = tuple(Counter() for _ in range(4))
        for batch in batches:
            for text, toxic, part in zip(batch["text"], batch["toxic"], batch["part"], strict=True):
                # A token counts once for each document: one long text can't make a token toxic. The empty token counts documents.
                seen[2 * part + toxic].update({"", *(token for word in set(words_of(text)) for token in tokens(word))})
            if sum(map(len, seen)) > COUNTED:
                yield _counted(seen)
                seen = tuple(Counter() for _ in range(4))
        yield _counted(seen)

    counts = cut(labelled.mapInPandas(count, COUNTS).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "c0", "c1"))))
    rows = counts.where("token = ''").first()
    n0, n1 = (rows["n0"] + rows["c0"], rows["n1"] + rows["c1"]) if rows else (0, 0)
    if not min(n0, n1):
        share = n1 / max(n0 + n1, 1)
        return Model({}, -1.0, 1.0, 1.0, (float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0, 0.0, 0.0))
    # The threshold and the map to a probability come from rows that the counts before it haven't seen; the counts then take in all.
    odds, weights = _calibrated(_models(counts.select("token", "n0", "n1"), ODDS), ODDS, labelled.where("part = 1"))
    return replace(_models(counts.select("token", (F.col("n0") + F.col("c0")).alias("n0"), (F.col("n1") + F.col("c1")).alias("n1")), (odds,))[0], weights=weights)


def _models(counts: DataFrame, thresholds: tuple[float, ...]) -> list[Model]:
    """A model for each least score, from counts(token, n0, n1) of documents. Their number of tokens is bounded by the training rows'."""
    counts = counts.where("token <> ''")
    sums = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    t0, t1 = float(sums["n0"] or 0), float(sums["n1"] or 0)
    strength = min(PRIOR, PRIOR_SHARE * (t0 + t1))
    prior = F.lit(strength) * (F.col("n0") + F.col("n1")) / max(t0 + t1, 1.0) + PRIOR_LEAST
    odds = lambda n, total: F.log((n + prior) / (total + strength - n + 0.01))
    error = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    scored = counts.select("token", "n0", "n1", (odds(F.col("n1"), t1) - odds(F.col("n0"), t0)).alias("delta"), (MIN_Z * error).alias("margin"))
    toxic = scored.where((F.col("delta") - F.col("margin") >= min(thresholds)) & (F.col("n1") >= MIN_DOCS)).select("token", "n0", (F.col("delta") - F.col("margin")).alias("score")).collect()
    heads = counts.sparkSession.createDataFrame(frame(sorted({(_head(r["token"]),) for r in toxic}), "head string"), "head string")
    clean = scored.where((F.col("delta") + F.col("margin") < 0) & (F.col("n0") + F.col("n1") >= MIN_DOCS)).withColumn("head", F.substring("token", 1, 3)).join(F.broadcast(heads), "head")
    clean = [r["token"] for r in clean.select("token").collect()] if toxic else []
    base = {r["token"]: float(r["n0"]) for r in toxic}
    return [_model({r["token"]: float(r["score"]) for r in toxic if r["score"] >= least}, clean, base, t0) for least in thresholds]


def _head(token: str) -> str:
    return token.removesuffix(WHOLE)[:3]


def _model(scores: dict, clean: list[str], base: dict, total: float) -> Model:
    """Scores with the constant for other words and the parameters of the extreme-value distribution in clean texts."""
    held = np.array([*scores.values(), 0.0])
    weight = np.array([*(base[t] for t in scores), 0.0])
    weight[-1] = max(total - weight.sum(), 1.0)
    weight /= weight.sum()
    # Any other word costs a little: the mean gain of the model's tokens in clean texts, twice, and at least a hundredth.
    held[-1] = other = -max(0.01, 2 * float((weight * held).sum()))
    # Clean tokens matter where a part of them is toxic.
    below = {t: 0.0 for t in clean if t not in scores and any(p in scores for p in tokens(t.removesuffix(WHOLE)) if t.startswith(p))}
    return Model({**below, **{t: max(s, 1e-9) for t, s in scores.items()}}, other, *_karlin(held, weight), heads=frozenset(map(_head, scores)))


def _counted(seen: tuple) -> pd.DataFrame:
    words = list(set().union(*seen))
    return pd.DataFrame({"token": pd.Series(words, dtype=object), **{n: np.fromiter((c[w] for w in words), dtype=np.int64, count=len(words)) for n, c in zip(("n0", "n1", "c0", "c1"), seen, strict=True)}})


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a slightly damped logistic regression, and its mean log loss."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.1, x.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _calibrated(models: list[Model], thresholds: tuple[float, ...], check: DataFrame) -> tuple[float, tuple]:
    """The threshold whose model tells the calibration rows apart best, and the weights from its features to a log-odds."""
    shared = check.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                rows.append([v for m in shared.value for v in m.features(words)])
            yield pd.DataFrame({"x": rows, "toxic": batch["toxic"].to_numpy()})

    rows = check.mapInPandas(measure, "x array<double>, toxic int").collect()  # a bounded sample
    if not rows:
        return thresholds[-1], (-2.2, 1.0, 1.0, 0.0)
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows])
    fitted = [_logistic(np.column_stack([np.ones(len(y)), x[:, 3 * k : 3 * k + 3]]), y) for k in range(len(models))]
    best = min(range(len(models)), key=lambda k: (fitted[k][1], -k))
    return thresholds[best], tuple(float(v) for v in fitted[best][0])


def score(text: Column, model: Model) -> Column:
    """The probability of each text, 0 to 1; null and empty texts get that of a text without toxic passages."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.probability(words_of(t)) for t in batch], dtype="float64")

    return of(text)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_e: float = MAX_E) -> DataFrame:
    """(doc_id, first_word, end_word, score, expected, words): every significant toxic passage; words as words_of() gives them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = []
            for id_, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                words = words_of(text)
                for a, b, s in m.segments(words):
                    expected = m.scale * len(words) * float(np.exp(-m.rate * s))
                    if expected <= max_e:
                        out.append((None if pd.isna(id_) else int(id_), a, b, s, expected, " ".join(words[a:b])))
            yield frame(out, PASSAGES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(find, PASSAGES)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, null and repeated ids included; an empty table gives an empty one."""
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic."""
    return docs.where(score(F.col(text_col), fit(docs, labels, id_col, text_col)) < CUTOFF)
