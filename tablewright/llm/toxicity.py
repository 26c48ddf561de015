"""Toxicity scores by weak supervision.

Many lexicon and pattern voters look at every text. A generative model of the true label and the votes is fitted by
expectation maximisation to the counts of all vote patterns in the corpus: it estimates the voters' accuracies, then the
correlations that are left given the label; voters that depend on each other become one composite voter, and the model is
fitted again. A linear classifier over lexicon features learns the model's posterior labels, and human labels of the
learning folds calibrate its scores.

Lexicons are some words that are stated below, and words and word beginnings that labelled rows of the learning folds show to be
toxic beyond chance (Chernoff's bound over all candidates; all of these are used). So four of the voters lean on human labels, and the others on none. Rows are ``held_out`` when crc32 of the id as text leaves 2 modulo 4;
no label of theirs is used.

Bounds (parameters): at most ``Limits.labelled`` labelled documents of each class feed the lexicon and the calibration, at most
``Limits.train`` documents the classifier, taken in an order by hash; everything else is computed over all documents.

Fixed results: a null text is the empty one; texts without words get the score of no evidence; a null id is ``held_out`` false
and its labels are unused; repeated labels of a document count once, toxic if any says so; of several texts under one labelled id, and of copies in the
learning sample, the smallest is learnt from, so results do not hang on the order of rows; without toxic labels the lexicon is the
stated one; a very long text is read whole, in memory in proportion to it; repeated rows get equal scores; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, slim, staged, texts_of

THRESHOLD = 0.3

#: Common English words of abuse, by voter.
INSULTS = ("idiot", "moron", "stupid", "loser", "clown", "imbecile", "dumb", "fool", "jerk", "retard")
CONTEMPT = ("pathetic", "worthless", "disgusting", "scum", "trash", "garbage", "filth", "vermin", "ugly", "subhuman")
PROFANITY = ("fuck", "fucking", "shit", "bitch", "bastard", "asshole", "crap", "damn", "whore", "slut")
THREATS = ("kill", "die", "hate", "destroy", "hang", "shoot", "beat", "rape", "murder", "burn")


@dataclass(frozen=True)
class Limits:
    labelled: int = 8_000
    train: int = 20_000


VOTERS = ("insults", "contempt", "profanity", "threats", "words", "begin4", "begin5", "begin6", "dense", "aimed", "shout", "clean_words", "clean_begins")
_WORD = re.compile(r"[^\W\d_]{2,}")
_AIMED = re.compile(r"\b(?:you|your|he|she|they|this|that|these|those|tu|du|usted|vous|sie)\s+(?:are\s+|is\s+|re\s+|all\s+)?(?:an?\s+|such\s+an?\s+|the\s+)?(\w+)")
_BEGIN = (4, 5, 6)
#: Words by which the learning sample tells copies.
_SKETCH = 6


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _terms(words: set[str]) -> set[str]:
    """Lexicon candidates: whole words, and beginnings of longer words."""
    out = {f"w:{w}" for w in words if len(w) > 2}
    for n in _BEGIN:
        out.update({f"{n}:{w[:n]}" for w in words if len(w) > n})
    return out


def _sketch(text: str) -> int:
    """The words with the smallest hashes as one number, which close copies share and other texts hardly ever do."""
    least = sorted({xxhash.xxh64_intdigest(w, 0) for w in set(text.lower().split())})[:_SKETCH]
    return xxhash.xxh64_intdigest(repr(least).encode(), 0) >> 1


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``doc_id, text, toxic`` of labelled documents of the learning folds, one of each group of copies."""
    marks = slim(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(6))
    chosen = [marks.where(f"toxic {op} 0").orderBy(order).limit(limit) for op in (">", "=")]
    few = staged(chosen[0].unionByName(chosen[1]), "labelled")
    rows = slim(docs, "doc_id", "text").join(F.broadcast(few), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            groups = [_sketch(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "toxic")), pa.array(groups, pa.int64())], names=["doc_id", "text", "toxic", "group"])

    kind, mark = dict(docs.dtypes)["doc_id"], dict(rows.dtypes)["toxic"]
    return rows.select("doc_id", "text", "toxic").mapInArrow(sketch, f"doc_id {kind}, text string, toxic {mark}, group bigint").groupBy("group", "toxic").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", F.xxhash64("text"))).alias("one")).select("one.*", "toxic")


def learn_lexicon(docs: DataFrame, labels: DataFrame, limits: Limits) -> list[str]:
    """Terms that labelled toxic documents hold far more often than chance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in by_size(batches):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                found = _terms(set(_WORD.findall(text.lower())))
                found.add("")
                seen[toxic > 0].update(found)
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], names=["term", "clean", "toxic"])

    counts = _labelled(docs, labels, limits.labelled).mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = staged(counts, "terms")
    total = counts.where("term = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return []
    base = total["toxic"] / (total["toxic"] + total["clean"])
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    strong = counts.where("term <> '' AND toxic >= 4").where((p > max(0.6, base)) & (n * gain > math.log(100.0 * max(1, counts.count()))))
    return [r["term"] for r in strong.select("term").orderBy("term").collect()]  # words of the bounded labelled sample


class Lexicon:
    """Stated and learnt terms, each with a feature number."""

    def __init__(self, learnt: list[str]):
        stated = [f"w:{w}" for w in (*INSULTS, *CONTEMPT, *PROFANITY, *THREATS)]
        self.number = {t: i for i, t in enumerate(dict.fromkeys([*stated, *learnt]))}
        self.learnt = {k: {t.split(":", 1)[1] for t in learnt if t.startswith(f"{k}:")} for k in ("w", *map(str, _BEGIN))}
        self.dense = len(self.number)
        self.size = self.dense + 5

    def read(self, text: str) -> tuple[str, list[int], list[float]]:
        """Votes (one character a voter: t toxic, c clean, ``-`` none), and the features of a whole text."""
        lower = text.lower()
        words = _WORD.findall(lower)
        kinds = set(words)
        hit = {}
        for name, lexicon in (("insults", INSULTS), ("contempt", CONTEMPT), ("profanity", PROFANITY), ("threats", THREATS)):
            hit[name] = kinds.intersection(lexicon)
        hit["words"] = kinds & self.learnt["w"]
        for n in _BEGIN:
            own = self.learnt[str(n)]
            hit[f"begin{n}"] = {w for w in kinds if len(w) > n and w[:n] in own} if own else set()
        bad = set().union(*hit.values())
        strong = bad - hit["threats"] - hit["profanity"]
        times = sum(1 for w in words if w in strong) if strong else 0
        aimed = bool(bad) and any(m in bad for m in _AIMED.findall(lower))
        marks = text.count("!")
        upper = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if marks else 0
        votes = {k: "t" if v else "-" for k, v in hit.items()}
        votes["dense"] = "t" if times >= 2 or times and 50 * times >= len(words) else "-"
        votes["aimed"] = "t" if aimed else "-"
        votes["shout"] = "t" if marks and 5 * upper > len(words) else "-"
        votes["clean_words"] = "c" if not (hit["insults"] or hit["contempt"] or hit["words"]) else "-"
        votes["clean_begins"] = "c" if not any(hit[f"begin{n}"] for n in _BEGIN) else "-"
        features = {self.number[t] for t in (f"w:{w}" for w in bad) if t in self.number}
        for n in _BEGIN:
            features.update(self.number[f"{n}:{w[:n]}"] for w in hit[f"begin{n}"])
        values = dict.fromkeys(features, 1.0)
        extra = (math.log1p(times), 100 * times / max(20, len(words)), float(bool(strong)), float(len(strong) > 1), float(votes["shout"] == "t"))
        values.update({self.dense + i: v for i, v in enumerate(extra) if v})
        return "".join(votes[v] for v in VOTERS), list(values), list(values.values())


def featurize(docs: DataFrame, learnt: list[str]) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learnt)
        for batch in by_size(batches):
            rows = [lexicon.read(t) for t in texts_of(batch)]
            votes, at, values = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "votes", "at", "value"])

    return slim(docs, "doc_id", "text").mapInArrow(each, f"doc_id {kind}, votes string, at array<int>, value array<double>")


@dataclass
class LabelModel:
    """P(label) and P(vote | label) for groups of dependent voters."""

    prior: float
    groups: list[tuple[int, ...]]
    tables: list[dict[str, tuple[float, float]]]

    def log_odds(self, votes: str) -> float:
        out = math.log(self.prior / (1 - self.prior))
        for group, table in zip(self.groups, self.tables):
            clean, toxic = table.get("".join(votes[i] for i in group), (0.5, 0.5))
            out += math.log(toxic / clean)
        return out

    def posterior(self, votes: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.log_odds(votes)))))


def _fit(patterns: list[str], counts: np.ndarray, groups: list[tuple[int, ...]], start: np.ndarray, rounds: int = 50) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation from the posteriors ``start``. Laplace's half counts keep all probabilities positive."""
    codes = []
    for g in groups:
        names = ["".join(p[i] for i in g) for p in patterns]
        kinds = sorted(set(names))
        codes.append((kinds, np.array([kinds.index(n) for n in names])))
    post = start
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        total = weight.sum(1)
        prior = float(np.clip(total[1] / max(total.sum(), 1e-9), 0.005, 0.5))
        tables, odds = [], np.full(len(patterns), math.log(prior / (1 - prior)))
        for kinds, code in codes:
            p = np.stack([np.bincount(code, w, len(kinds)) + 0.5 for w in weight])
            p /= p.sum(1, keepdims=True)
            odds += np.log(p[1] / p[0])[code]
            tables.append({k: (float(p[0, i]), float(p[1, i])) for i, k in enumerate(kinds)})
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = float(np.abs(new - post).max()) < 1e-6
        post = new
        if done:
            break
    return LabelModel(prior, groups, tables), post


def fit_label_model(patterns: list[str], counts: list[int], dependent: float = 0.25) -> LabelModel:
    """Accuracies first, then correlations given the label; voters correlated above ``dependent`` are joined."""
    n = np.array(counts, float)
    start = np.array([min(0.95, 0.02 + 0.3 * p.count("t")) if "t" in p else 0.02 for p in patterns])
    model, post = _fit(patterns, n, [(i,) for i in range(len(VOTERS))], start)
    x = np.array([[1.0 if c == "t" else -1.0 if c == "c" else 0.0 for c in p] for p in patterns])
    cov = np.zeros((len(VOTERS), len(VOTERS)))
    for w in (n * (1 - post), n * post):
        mean = (w[:, None] * x).sum(0) / max(w.sum(), 1e-9)
        cov += ((x - mean) * w[:, None]).T @ (x - mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / spread[:, None] / spread
    group = list(range(len(VOTERS)))
    for i in range(len(VOTERS)):
        for j in range(i):
            if abs(corr[i, j]) > dependent:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    joined = [tuple(i for i, g in enumerate(group) if g == k) for k in sorted(set(group))]
    return _fit(patterns, n, joined, post)[0]


def _logistic(rows: list[tuple[list[int], list[float]]], target: np.ndarray, weight: np.ndarray, size: int, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear classifier for targets in [0, 1], by accelerated gradient steps."""
    at = np.concatenate([np.array(a, np.int64) for a, _ in rows] + [np.zeros(0, np.int64)])
    value = np.concatenate([np.array(v) for _, v in rows] + [np.zeros(0)])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    weight = weight / weight.sum()
    squares = 1 + np.bincount(row, value * value, len(rows))
    step = 4 / float((weight * squares).sum() + 4 * ridge)
    w, b, vw, vb = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(rounds):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        z = np.bincount(row, value * lw[at], len(rows)) + lb
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        vw = 0.9 * vw - 0.2 * step * (np.bincount(at, error[row] * value, size) + ridge * lw)
        vb = 0.9 * vb - 0.2 * step * error.sum()
        w, b = w + vw, b + vb
    return np.append(w, b)


def _logits(rows: list[tuple[list[int], list[float]]], w: np.ndarray) -> np.ndarray:
    return np.array([w[-1] + sum(w[i] * v for i, v in zip(a, x)) for a, x in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row."""
    learnt = learn_lexicon(docs, labels, limits)
    kind = dict(docs.dtypes)["doc_id"]
    table = staged(featurize(docs, learnt), "features")
    patterns = table.groupBy("votes").count().collect()  # at most 2 ** voters rows
    model = fit_label_model([r[0] for r in patterns], [r[1] for r in patterns]) if patterns else None
    size = Lexicon(learnt).size

    order = F.xxhash64("doc_id", F.lit(7))
    toxic = [r[0] for r in patterns if model.posterior(r[0]) >= 0.5] if model else []
    half = limits.train // 2
    sample = [r for cond in (F.col("votes").isin(toxic), ~F.col("votes").isin(toxic)) for r in table.where(cond).orderBy(order).limit(half).select("votes", "at", "value").collect()] if patterns else []
    weights = np.zeros(size + 1)
    if sample:
        target = np.array([model.posterior(r["votes"]) for r in sample])
        side = target >= 0.5
        weight = np.where(side, 1 / max(1, side.sum()), 1 / max(1, (~side).sum()))
        weights = _logistic([(r["at"], r["value"]) for r in sample], target, weight, size)
    marks = slim(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    few = staged(marks.orderBy(order).limit(2 * limits.labelled), "marks")
    # One row of each labelled id, the one with the smallest votes and features.
    one = table.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("votes", "toxic", "at", "value")).alias("r"))
    known = one.orderBy("doc_id").select("r.toxic", "r.at", "r.value").collect()
    slope, bias = 1.0, 0.0
    if known:
        z = _logits([(r["at"], r["value"]) for r in known], weights)
        y = np.array([float(r["toxic"]) for r in known])
        mean, spread = float(z.mean()), float(z.std()) or 1.0
        slope, bias = _logistic([([0], [v]) for v in ((z - mean) / spread).tolist()], y, np.ones(len(y)), 1, 1e-4, 500)
        slope, bias = max(slope, 1e-3) / spread, bias - max(slope, 1e-3) * mean / spread

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            z = _logits(list(zip(batch.column("at").to_pylist(), batch.column("value").to_pylist())), weights) if ids else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(slope * z + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), batch.column("votes")], names=["doc_id", "held_out", "score", "predicted", "votes"])

    return table.select("doc_id", "at", "value", "votes").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int, votes string")
