"""Toxicity classifier: non-negative positive-unlabelled learning over words and word beginnings.

Features are the distinct words of a text (lower case, without signs at either end), their beginnings of
three to seven characters (BEGINNINGS; a longer word has its own feature besides), and whether two or
three of the words share such a beginning. A linear model over their presence is fitted by the
class-prior-corrected risk. Features are chosen by four parameters of `train`: at least `least_texts`
confirmed texts must have one, its over-representation against unlabelled texts must reach a z of
`least_z`, the share of toxic texts among those that have it, as the prior lets it be estimated, must
reach `least_share`, and of these the `most` largest z are kept. Only the text is read: no labels,
language, source or id are inputs. Parameters choose features; no row is left out by them.

Defined results: null and empty texts have no features and get the model's base score; repeated rows
get equal scores, texts of any length are read whole; without any confirmed example every score is the
prior, 0, and where every label that may be learnt from is 1, it is 1; an empty table gives no rows;
other columns, whatever they are called, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pu_learning
from .pu_learning import fit_nn_pu, sigmoid, training_sample
from .quality_pu import scored
from .shared import text_or_empty

MOD, REMAINDER, THRESHOLD, WORDS_KEPT, GROUP_CHARS = 3, 1, 0.7, 300_000, 3_000_000
#: How features are chosen; see above.
FEATURES, LEAST_TEXTS, LEAST_Z, LEAST_SHARE, BEGINNINGS = 400, 3, 4.0, 0.6, (3, 7)


def features(words: set[str]) -> set[str]:
    """The features of a text's distinct words; a beginning that two or three of them share counts extra."""
    shared = Counter(f for w in {bare(w) for w in words} for f in features_of(w))
    return {*shared, *(f"{f}*{k}" for f, n in shared.items() for k in (2, 3) if n >= k)}


def bare(word: str) -> str:
    """Lower case, without signs at either end."""
    w = word.lower()
    if w.isalnum():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def features_of(word: str) -> list[str]:
    """A bare word itself (marked) and its beginnings; none for the empty word."""
    return [f"={word}", *[word[:k] for k in range(BEGINNINGS[0], min(BEGINNINGS[1], len(word)) + 1)]] if word else []


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    intercept: float
    prior: float
    kept: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def hits(self, word: str) -> bool:
        """Whether any kept feature can come from the word."""
        found = self.kept.get(word)
        if found is None:
            found = any(f in self.index or f + "*2" in self.index or f + "*3" in self.index for f in features_of(bare(word)))
            if len(self.kept) < WORDS_KEPT:
                self.kept[word] = found
        return found

    def present(self, texts: list[str]) -> list[list[int]]:
        """The kept features that each text has, each once."""
        out, group, size = [], [], 0
        for k, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS or k == len(texts) - 1:
                out += self._present(group)
                group, size = [], 0
        return out

    def _present(self, texts: list[str]) -> list[list[int]]:
        split = [x.split() for x in texts]
        flat = pa.array([w for ws in split for w in ws], pa.large_string()).dictionary_encode()
        words = flat.dictionary.to_pylist()
        code = np.asarray(flat.indices)
        at = np.flatnonzero(np.array([self.hits(w) for w in words])[code]) if len(code) else code
        owner = np.searchsorted(np.cumsum([len(ws) for ws in split]), at, "right")
        found: list[set[str]] = [set() for _ in texts]
        for k, c in zip(owner.tolist(), code[at].tolist()):
            found[k].add(words[c])
        return [sorted(self.index[f] for f in features(s) if f in self.index) for s in found]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        return sigmoid(np.array([self.intercept + self.weights[f].sum() for f in self.present(texts)]))


def fit(positive: list[list[int]], unlabelled: list[list[int]], index: dict[str, int], prior: float) -> Model:
    def dense(rows):
        x = np.zeros((len(rows), len(index)), np.float32)
        for k, f in enumerate(rows):
            x[k, f] = 1
        return x

    weights, intercept = fit_nn_pu(dense(positive), dense(unlabelled), prior)
    return Model(index, weights, intercept, prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = MOD, remainder: int = REMAINDER, max_positive: int = pu_learning.MAX_POSITIVE, max_unlabelled: int = pu_learning.MAX_UNLABELLED, most: int = FEATURES, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z, least_share: float = LEAST_SHARE) -> Model:
    """Feature counts of the bounded sample are added up by Spark; the chosen features and the sample's
    short lists of them come to the driver, where the model is fitted."""
    sample, prior = training_sample(docs, labels, label, mod, remainder, max_positive, max_unlabelled)
    counted = T.StructType([T.StructField("feature", T.StringType()), T.StructField("p", T.LongType()), T.StructField("u", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for positive, text in zip(batch["positive"].to_pylist(), batch["text"].to_pylist()):
                kinds[not positive].update(features(set(text.split())))
        names = [*kinds[0], *(f for f in kinds[1] if f not in kinds[0])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kinds[0][f] for f in names], pa.int64()), pa.array([kinds[1][f] for f in names], pa.int64())], names=counted.names)

    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True) or not n.get(False) or prior == 1:
        return Model({}, np.zeros(0), 0.0, prior)
    sums = sample.mapInArrow(count, counted).groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= least_texts)
    share = (F.col("p") + F.col("u")) / (n[True] + n[False])
    z = F.try_divide(F.col("p") / n[True] - F.col("u") / n[False], F.sqrt(share * (1 - share) * (1 / n[True] + 1 / n[False])))  # null for what every text has
    toxic = prior * (F.col("p") / n[True]) / ((F.col("u") + 0.5) / n[False])  # share of the texts with the feature, as estimated
    best = sums.withColumn("z", z).where((F.col("z") >= least_z) & (toxic >= least_share)).orderBy(F.desc("z"), "feature").limit(most).collect()
    index = {r["feature"]: k for k, r in enumerate(best)}
    bare = Model(index, np.zeros(0), 0.0, prior)
    listed = T.StructType([T.StructField("positive", T.BooleanType()), T.StructField("f", T.ArrayType(T.IntegerType()))])

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(bare.present(batch["text"].to_pylist()), pa.list_(pa.int32()))], names=listed.names)

    rows = sorted((r["positive"], list(r["f"])) for r in sample.mapInArrow(list_, listed).collect())
    if not index:
        return bare
    return fit([f for p, f in rows if p], [f for p, f in rows if not p], index, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, mod: int = MOD, remainder: int = REMAINDER) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return scored(slim, model.scores).select("doc_id", pu_learning.held_out("doc_id", mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
