"""Operator 9, toxicity: a subsequence-kernel support vector machine on Nyström landmarks, trained on labelled sentences."""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.llm.common import give_back, keep_in_worker, packed_row, share, stage, table
from rolecall.llm.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bounds of what is learnt from: labelled documents of each class, and sentences of each class of these.
TOXIC_DOCUMENTS, CLEAN_DOCUMENTS = 3_000, 6_000
TRAIN_SENTENCES = 15_000
LONGEST_SENTENCE = 2_000
LANDMARKS = 128
DECAY = 0.75
#: A subsequence's last character lies at most this far after its first.
SPAN = 5
FEATURE_BITS = 18
CACHED_WORDS = 500_000
LONGEST, OVERLAP = 48, 12
STEP = 4_000
#: Three or more characters one by one, with a blank or a sign between them.
SPELLED = re.compile(r"(?<!\S)\w(?:[ ._*-]\w){2,}(?!\w)")
#: What stands for no word where a text has fewer than a feature looks at.
NO_WORD = -2.0
THRESHOLD = 0.7


def units(text: str) -> list[str]:
    """Words in lower case; spelled-out words are joined, over-long words cut into overlapping pieces."""
    text = SPELLED.sub(lambda m: m[0][::2], text.lower())
    found = text.split()
    if len(text) > LONGEST and max(map(len, found), default=0) > LONGEST:
        step = LONGEST - OVERLAP
        found = [p for w in found for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - OVERLAP, step)])]
    return found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word ``(word number, feature, weight)``: its subsequences of three characters, decaying with their span.

    Words carry a mark at either end. The weights of a word are scaled to length one, so the inner
    product of two words is their normalised kernel with gaps of bounded length.
    """
    marked = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the word's end
    rows, features, weights = [], [], []
    for last in range(2, SPAN + 1):
        first = np.flatnonzero(left > last)
        for middle in range(1, last):
            mixed = codes[first] * np.uint64(0x9E3779B97F4A7C15) + codes[first + middle] * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[first + last] * np.uint64(0x94D049BB133111EB)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            rows.append(owner[first])
            features.append((mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
            weights.append(np.full(len(first), DECAY ** (last + 1)))
    row, feature, weight = np.concatenate(rows), np.concatenate(features), np.concatenate(weights)
    norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
    return row, feature, weight / norm[row]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel between words and landmarks."""
    out = np.empty((len(words), len(landmarks)), np.float32)
    l_row, l_feature, l_weight = subsequences(landmarks)
    known, place = np.unique(l_feature, return_inverse=True)
    dense = np.zeros((len(landmarks), len(known)))
    np.add.at(dense, (l_row, place), l_weight)
    for at in range(0, len(words), STEP):
        row, feature, weight = subsequences(words[at : at + STEP])
        near = np.searchsorted(known, feature)
        near[near == len(known)] = 0
        some = known[near] == feature
        row, near, weight = row[some], near[some], weight[some]
        for j, mark in enumerate(dense):
            out[at : at + STEP, j] = np.bincount(row, weight * mark[near], len(words[at : at + STEP]))
    return out


def gapped(word: str, n: int) -> list[str]:
    """Disguises of a word to learn from: a character put in, a sign between two characters, a character doubled."""
    at = 1 + n % max(1, len(word) - 1)
    sign, letter = "-.*_'"[n % 5], "aeiostrnxz"[n % 10]
    return [word[:at] + letter + word[at:], word[:at] + sign + word[at:], word[:at] + word[at - 1] + word[at:]]


@dataclass(frozen=True)
class Model:
    """``weight`` holds the machine as one number per feature: the landmarks' features times their coefficients."""

    weight: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        row, feature, weight = subsequences(words)
        return np.bincount(row, weight * self.weight[feature], len(words)) + self.bias


@dataclass(frozen=True)
class Scale:
    """Logistic regression from what ``describe`` says of a document to the chance of label 1."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Scale:
        mean, spread = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - mean) / spread, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
            w += np.linalg.solve(hessian, z.T @ (y - p) - 1e-2 * w)
        return Scale(mean, spread, w)

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))] @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def describe(scores: np.ndarray) -> list[float]:
    """The worst word, the three and the eight worst, and how many words are bad, of a text's word scores."""
    worst = np.append(scores, [NO_WORD] * 8)
    worst = np.sort(np.partition(worst, len(worst) - 8)[-8:])[::-1]
    n, bad = len(scores), int((scores > 0.5).sum())
    return [worst[0], worst[:3].mean(), worst.mean(), np.log1p(bad), np.log1p(n), bad / np.sqrt(n + 1)]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = (y * (x @ w)) < 1
        a, c = x[active], (cost * weight[active]).astype(x.dtype)
        new = np.linalg.solve(ridge + a.T @ (c[:, None] * a), a.T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit(sentences: list[tuple[int, str, int]], landmarks: int = LANDMARKS) -> Model:
    """Learn from ``(document, sentence, label)``.

    A toxic document's sentences all carry its label although few of its words do harm, so the
    machine is trained on words: those of clean sentences against, for each toxic document, the words
    that the machine of the round before finds worst, at first those that tell the classes apart best.
    """
    split = [(doc, set(units(s)), label) for doc, s, label in sentences]
    count = {0: Counter(), 1: Counter()}
    total = Counter(label for _, _, label in split)
    for _, own, label in split:
        count[label].update(own)
    if not (total[0] and total[1]):  # one class only: nothing to tell apart
        return Model(np.zeros(1 << FEATURE_BITS), -1.0 if not total[1] else 1.0)
    vocabulary = sorted(count[0].keys() | count[1].keys())
    index = {w: i for i, w in enumerate(vocabulary)}
    clean = np.array([count[0][w] for w in vocabulary], float)
    toxic = np.array([count[1][w] for w in vocabulary], float)
    p, q = toxic / total[1], clean / total[0]
    mean = (toxic + clean) / (total[0] + total[1])
    apart = (p - q) / np.sqrt(mean * (1 / total[0] + 1 / total[1]) + 1e-12)
    by_apart = np.argsort(-apart, kind="stable")[: landmarks * 3 // 4]
    common = [i for i in np.argsort(-clean, kind="stable") if i not in set(by_apart)][: landmarks - len(by_apart)]
    marks = [vocabulary[i] for i in [*by_apart, *common]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    root = root.astype(np.float32)
    features = kernel(vocabulary, marks) @ root

    own_words: dict[int, np.ndarray] = {}
    for doc, own, label in split:
        if label:
            got = np.fromiter((index[w] for w in own), np.int64, len(own))
            own_words[doc] = np.union1d(own_words[doc], got) if doc in own_words else got
    against = np.flatnonzero(clean)
    score = np.where(apart > 3, apart, -np.inf)
    machine = None
    for _ in range(4):
        worst = [i for words in own_words.values() if len(words) for i in words[np.argsort(-score[words])[:4]] if score[i] > 0]
        chosen, times = np.unique(np.array(worst, np.int64), return_counts=True)
        if not len(chosen):
            break
        disguised = kernel([d for n, i in enumerate(chosen) for d in gapped(vocabulary[i], n)], marks) @ root
        x = np.vstack([features[chosen], disguised, features[against]])
        y = np.r_[np.ones(4 * len(chosen)), -np.ones(len(against))]
        share = times / times.sum()
        # a word that clean texts hold as well counts on both sides, and rare clean words count too
        spared = 4 * clean[against] / clean[against].sum() + 8 / len(against)
        machine = svm(x, y, np.r_[share, np.repeat(share, 3) / 9, spared] * len(own_words))
        score = features @ machine[:-1] + machine[-1]
    if machine is None:
        return Model(np.zeros(1 << FEATURE_BITS), -1.0)
    row, feature, weight = subsequences(marks)
    dense = np.bincount(feature, weight * (root @ machine[:-1])[row], 1 << FEATURE_BITS)
    return Model(dense, float(machine[-1]))


class WordScores:
    """What the word scores of texts say; scores of words are kept, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def describe(self, texts: list[str]) -> list[list[float]]:
        split = [units(t) for t in texts]
        unknown = list(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        if len(self.known) + len(unknown) > CACHED_WORDS:
            self.known.clear()
            unknown = list(set(chain.from_iterable(split)))
        for at in range(0, len(unknown), STEP):
            words = unknown[at : at + STEP]
            self.known.update(zip(words, self.model.words(words).tolist(), strict=True))
        return [describe(np.array(list(map(self.known.__getitem__, words)))) for words in split]


def descriptions(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``found``, what the machine finds in each whole text; a null text counts as empty."""
    narrow = docs.select(*keys) if text in keys else docs.select(*keys, text)
    at = narrow.columns.index(text)
    shared, name = share(docs.sparkSession, model), f"toxicity {uuid.uuid4().hex}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = keep_in_worker(name, lambda: WordScores(shared()))
        for batch in batches:
            found, texts, held = [], [], 0
            for value in batch.column(at):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= 1 << 20:
                    found += scores.describe(texts)
                    texts, held = [], 0
            found += scores.describe(texts)
            column = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], column], names=[*keys, "found"])
        give_back()

    schema = T.StructType([*narrow.schema.fields[: len(keys)], T.StructField("found", T.ArrayType(T.DoubleType()))])
    return narrow.mapInArrow(score, schema)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, Scale]:
    """Fit on labelled documents that are not held out: a bounded number of each class, by a hash of the id.

    Only ``doc_id``, ``text`` and the label ``toxic`` are read; rows without one of them are left out.
    """
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out() & F.col("toxic").isin(0, 1))
    learn = learn.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    toxic = learn.where("label = 1").orderBy(order, "doc_id").limit(TOXIC_DOCUMENTS)
    clean = learn.where("label = 0").orderBy(order, "doc_id").limit(CLEAN_DOCUMENTS)
    chosen = F.broadcast(toxic.union(clean))  # 9,000 rows at most
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    own = stage(own, "toxicity-labelled")
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("line"), F.lit(1)), F.lit(LONGEST_SENTENCE)),
        lambda at: F.substring("line", at, F.lit(LONGEST_SENTENCE)),
    )
    sentences = (
        own.select("doc_id", "label", F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("line"))
        .select("doc_id", "label", F.explode(cut).alias("sentence"))
        .where("sentence <> ''")
    )
    rows = []
    for label in (0, 1):
        some = sentences.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", "sentence"), "doc_id", "sentence")
        rows += [(r["doc_id"], r["sentence"], label) for r in some.limit(TRAIN_SENTENCES).collect()]
    model = fit(rows)
    seen = descriptions(own, model, ["label"]).collect()
    if len({r["label"] for r in seen}) < 2:  # no scale without both classes
        flat = np.zeros(len(describe(np.array([]))))
        return model, Scale(flat, flat + 1, np.append(flat, -1.0))
    return model, Scale.fit(np.array([r["found"] for r in seen]), np.array([r["label"] for r in seen], float))


def score_documents(docs: DataFrame, model: Model, scale: Scale, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``score``, the chance from 0 to 1 that a text is toxic. Every row gives one row.

    Null and empty texts have the score of a text without words; other columns are ignored. Very
    long texts are read whole, and over-long words in overlapping pieces.
    """
    found = descriptions(docs, model, keys, text)
    z = F.lit(float(scale.weight[-1]))
    for n, (mean, spread, weight) in enumerate(zip(scale.mean, scale.spread, scale.weight, strict=False)):
        z = z + (F.col("found")[n] - float(mean)) / float(spread) * float(weight)
    return found.select(*keys, (1 / (1 + F.exp(-z))).alias("score"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``."""
    model, scale = train(docs, labels)
    packed = docs.select(packed_row(docs), F.col("text").alias("_text"))
    scored = score_documents(packed, model, scale, ["_row"], "_text")
    return scored.where(F.col("score") < threshold).select("_row.*")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, scale = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, scale, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
