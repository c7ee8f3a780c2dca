"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's score is a logistic function of the weights of its distinct words; a document is toxic unless all of its
sentences are not: 1 - product(1 - sentence score). Only documents are labelled, so the gradient of the document's
log-likelihood is shared out among its sentences by their part in the noisy-or, and the sentences that explain the label
take the weight. Features are a word and its beginnings, which inflected forms share. `score` then names the worst
sentence, with its place in the text.

Training uses at most `sample` labelled rows (those lowest by a hash of the id, so reruns agree), and needs ids and
labels only to choose them. Executors count in how many sample documents, and toxic ones, each feature stands, keep the
features that are tied to the label, and number each sentence's features; only these numbers go to the driver, which fits
the weights. The texts themselves never do. Scoring is one pass over whole texts.

Null or empty texts and those without words score 0. Labels that are null, or of ids without a document, aren't used; of
labels that share an id the largest counts, of documents that do the smallest text is learned from. With no labelled rows,
or one class only, there are no weights and the score is the prior of each sentence (0). Repeated rows and equal texts are
scored alike. A very long text is one row of Arrow: its sentences are scored one by one, and learned from by their
different feature sets. Columns named like the outputs are replaced, other columns pass through. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import discard, store, tidied

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6_000
#: Tasks that the sample is dealt to.
PARTS = 32
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5, 6, 7, 8)
#: Standard errors of its log odds that a word's tie to the label must have.
LEAST_Z = 3.5
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"\w+")
_CACHE = 1 << 16


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    """A word and its beginnings (marked, as they aren't the same as a word so spelt)."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SENTENCE.finditer(text))


def _bags(text: str | None) -> Iterator[set[str]]:
    """Words of each sentence that has any, in lower case."""
    lower = (text or "").lower()
    for a, b in sentences(lower):
        if words := set(_WORD.findall(lower, a, b)):
            yield words


def document_features(text: str | None) -> set[str]:
    """Distinct features of a whole text."""
    return {f for w in set().union(*_bags(text)) for f in features(w)}


def tied(n: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Whether a feature that `n` documents have, `toxic` of them toxic, stands in more toxic ones than chance explains.

    The rest would be learned by heart.
    """
    odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((n - toxic + 0.5) / (n_clean - n + toxic + 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (n - toxic + 0.5))
    return (odds > LEAST_Z * error) & (toxic >= 2)


def encoded(text: str | None, number: dict[str, int]) -> tuple[list[int], list[int], list[int]]:
    """A text's sentences by the chosen features: of each different set of them its size, its members and how many sentences
    have it (those with none of them included)."""
    known: dict[str, list[int]] = {}
    sets: Counter[tuple[int, ...]] = Counter()
    for words in _bags(text):
        own: set[int] = set()
        for w in words:
            if (found := known.get(w)) is None:
                found = known[w] = [number[f] for f in features(w) if f in number]
            own.update(found)
        sets[tuple(sorted(own))] += 1
    return [len(x) for x in sets], [i for x in sets for i in x], list(sets.values())


def optimise(names: list[str], y: np.ndarray, bags: list[tuple], epochs: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood of the noisy-or by Adam over the whole sample: labels and `encoded` sentences of its documents."""
    sizes, slot, times = (np.array([i for b in bags for i in b[k]], np.int64) for k in range(3))
    if not len(sizes) or y.min(initial=1) == y.max(initial=0):
        return Model({}, -20.0)
    n, doc = len(sizes), np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    sentence = np.repeat(np.arange(n), sizes)
    w, bias = np.zeros(len(names)), -4.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(sentence, w[slot], n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(doc, times * np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        p_doc = np.clip(-np.expm1(log_none), 1e-6, 1 - 1e-9)
        # d loss / d z of a sentence: p for label 0; -p (1 - P) / P for label 1
        share = np.where(y[doc] > 0, -(1 - p_doc[doc]) / p_doc[doc], 1.0) * p * times / len(y)
        g = np.append(np.bincount(slot, share[sentence], len(names)) + decay * np.sign(w) / 10, share.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(dict(zip(names, w.tolist())), float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled documents (see the module's text)."""
    l = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    l = l.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample).drop("_h")  # `sample` ids at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(l), "doc_id")
    rows = store(rows.repartition(PARTS, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label")), "toxicity-sample")
    n_toxic, n = rows.agg(F.coalesce(F.sum("_label"), F.lit(0)), F.count("*")).first()

    def count(batches):
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                own = document_features(text.as_py())
                n.update(own)
                if y.as_py():
                    toxic.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[f] for f in n], pa.int64())], names=["feature", "n", "toxic"])

    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(tied(*(batch.column(k).to_numpy() for k in (1, 2)), n_toxic, n - n_toxic)))

    schema = "feature string, n long, toxic long"
    counted = rows.select("text", "_label").mapInArrow(tidied(count), schema).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    names = sorted(r.feature for r in counted.mapInArrow(choose, schema).select("feature").collect())
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def encode(batches):
        for batch in batches:
            columns = zip(*(encoded(x.as_py(), sent.value) for x in batch.column(1))) if batch.num_rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(list(c), pa.list_(pa.int32())) for c in columns)], names=["doc_id", "label", "sizes", "slots", "times"])

    made = rows.select(F.col("doc_id").cast("long"), "text", "_label").mapInArrow(encode, "doc_id long, label int, sizes array<int>, slots array<int>, times array<int>")
    bags = sorted(map(tuple, made.collect()))  # numbers of the chosen features only, for `sample` rows at most
    discard(rows)
    return optimise(names, np.array([b[1] for b in bags], np.float64), [b[2:] for b in bags])


class _WordWeights(dict):
    """Weight of a word, worked out when first asked for; bounded."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.short = {f[: STEMS[0]] for f in weights if f[-1:] == "-"}

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        get = self.weights.get
        x = get(word, 0.0)
        if word[: STEMS[0]] in self.short:
            x = sum(get(f, 0.0) for f in features(word))
        self[word] = x
        return x


class Scorer:
    def __init__(self, model: Model):
        self.bias, self.weight = model.bias, _WordWeights(model.weights).__getitem__

    def __call__(self, text: str | None) -> tuple[float, int, int, float]:
        """Score, and where the worst sentence is and what it scores."""
        if not text:
            return 0.0, 0, 0, 0.0
        lower = text.lower()
        if len(lower) != len(text):  # so that places hold
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        weight, find, bias = self.weight, _WORD.findall, self.bias
        none, worst, start, end = 0.0, -math.inf, 0, 0
        for a, b in sentences(lower):
            if words := find(lower, a, b):
                z = bias + sum(map(weight, set(words)))
                z = 20.0 if z > 20 else -30.0 if z < -30 else z
                none -= math.log1p(math.exp(z))
                if z > worst:
                    worst, start, end = z, a, b
        return -math.expm1(none), start, end, 1 / (1 + math.exp(-worst)) if end else 0.0


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with score, worst_start, worst_end (code points) and worst_score; columns so named are replaced."""
    made = ["score", "worst_start", "worst_end", "worst_score"]
    keep = [c for c in df.columns if c not in made]
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("worst_start", T.LongType()), T.StructField("worst_end", T.LongType()), T.StructField("worst_score", T.DoubleType())])

    def work(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            rows = [scorer(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            columns = zip(*rows) if rows else [()] * 4
            made_arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *made_arrays], names=[*keep, *made])

    return df.mapInArrow(tidied(work), schema)


def held_out(doc_id) -> object:
    """The contract's fifth of the ids that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
