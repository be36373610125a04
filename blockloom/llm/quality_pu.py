"""Quality classifier: positive-unlabelled learning over the shape of a text.

Every text is described by some twenty shares and means (distinct words, repeated neighbours,
signs, capitals, repeated lines, ...), each unfolded into steps at quantiles of the sample, and a
linear model over them is fitted by non-negative unbiased risk. Only the text is read: no labels,
language, source or id are inputs of a score. The prior is the share of label 1 among labelled rows that
may be learnt from, and is taken to hold for the unlabelled texts too. All numbers are defined for texts of every length: runs of
two or five words of a shorter text are one run of all its words, a mean over no pairs is 0, and the
share of the top word counts its repetitions (its occurrences but one).

Defined results: null and empty texts have all shares 0 and get a score like any other text;
repeated rows get equal scores, texts of any length are described whole; where no label, or every label
that may be learnt from, is 1, every score is the prior (0 or 1); an empty table gives no rows; other
columns, whatever they are called, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pu_learning
from .pu_learning import fit_nn_pu, sigmoid, training_sample
from .shared import text_or_empty

MOD, REMAINDER, THRESHOLD, KNOTS, WORDS_KEPT, GROUP_CHARS = 5, 0, 0.3, 8, 200_000, 2_000_000


class _Shapes(dict):
    """Word -> its counts: characters, letters, digits, signs, upper case, only signs, ends in signs, short, capital."""

    def __missing__(self, w: str) -> tuple:
        n = len(w)
        letters = sum(map(str.isalpha, w))
        digits = 0 if letters == n else sum(map(str.isdigit, w))
        signs = n - letters - digits
        out = (n, letters, digits, signs, n > 1 and letters > 1 and w.isupper(), not letters and not digits, signs > 1 and n > 2 and not (w[-1].isalnum() or w[-2].isalnum()), n <= 3, w[0].isupper())
        if len(self) < WORDS_KEPT:
            self[w] = out
        return out


_shapes = _Shapes()
NAMES = (
    "words", "distinct words", "repeats of the top word", "word length", "letters", "digits", "signs", "upper case", "only signs", "ends in signs", "short words", "capitals",
    "repeated neighbours", "repeated after two", "distinct pairs", "distinct fives", "repeated lines", "words a line", "characters",
)


def describe(texts: list[str]) -> np.ndarray:
    """A row of len(NAMES) numbers for each text."""
    rows, group, size = [np.zeros((0, len(NAMES)))], [], 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS or k == len(texts) - 1:
            rows.append(_describe(group))
            group, size = [], 0
    return np.concatenate(rows)


def _describe(texts: list[str]) -> np.ndarray:
    split = [x.split() for x in texts]
    flat = pa.array([w for ws in split for w in ws], pa.large_string()).dictionary_encode()
    code = np.asarray(flat.indices).astype(np.int64)
    shape = np.array([_shapes[w] for w in flat.dictionary.to_pylist()], np.float64).reshape(-1, 9)
    out, at = np.zeros((len(texts), len(NAMES))), 0
    mean = lambda x: np.count_nonzero(x) / max(1, len(x))
    distinct = lambda x: len(np.unique(x)) / len(x) if len(x) else 1.0
    for k, (text, words) in enumerate(zip(texts, split)):
        n = len(words)
        if not n:
            continue
        c = code[at : at + n]
        at += n
        total = shape[c].sum(0)
        chars = total[0]
        lines = [x for x in text.split("\n") if x]
        pairs = c[1:] * len(shape) + c[:-1]
        fives = (pairs[:-3] * 1_000_003 + pairs[3:]) * 1_000_003 + c[2:-2]
        counts = np.unique(c, return_counts=True)[1]
        out[k] = (
            np.log1p(n), len(counts) / n, (counts.max() - 1) / n, chars / n, total[1] / chars, total[2] / chars, total[3] / chars, *(total[4:] / n),
            mean(c[1:] == c[:-1]), mean(c[2:] == c[:-2]), distinct(pairs), distinct(fives),
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(len(text)),
        )
    return out


@dataclass
class Model:
    knots: np.ndarray  # one row of ascending knots for each number
    weights: np.ndarray
    intercept: float

    def unfolded(self, x: np.ndarray) -> np.ndarray:
        """Each number as its position among the knots: 1 for every knot passed, a share for the one underway."""
        low = np.hstack([self.knots[:, :1] - 1, self.knots[:, :-1]])
        step = (x[:, :, None] - low) / np.maximum(self.knots - low, 1e-9)
        return np.clip(step, 0, 1).reshape(len(x), -1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row's sum does not depend on the rows beside it, so equal texts get equal scores."""
        if not len(self.weights):
            return np.full(len(texts), self.intercept)
        return sigmoid((self.unfolded(describe(texts)) * self.weights).sum(1) + self.intercept)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    both = np.concatenate([positive, unlabelled])
    knots = np.maximum.accumulate(np.quantile(both, np.linspace(0.005, 0.995, KNOTS), axis=0).T + np.arange(KNOTS) * 1e-6, axis=1)
    model = Model(knots, np.zeros(0), prior)
    model.weights, model.intercept = fit_nn_pu(model.unfolded(positive), model.unfolded(unlabelled), prior)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = MOD, remainder: int = REMAINDER, max_positive: int = pu_learning.MAX_POSITIVE, max_unlabelled: int = pu_learning.MAX_UNLABELLED) -> Model:
    """Descriptions of the bounded sample come to the driver (a few MB), where the model is fitted."""
    sample, prior = training_sample(docs, labels, label, mod, remainder, max_positive, max_unlabelled)
    schema = T.StructType([T.StructField("positive", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def described(batches):
        for batch in batches:
            rows = describe(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["positive"], pa.array([r.tobytes() for r in rows], pa.binary())], names=schema.names)

    rows = sorted((r["positive"], bytes(r["x"])) for r in sample.mapInArrow(described, schema).collect())
    x = {kind: np.frombuffer(b"".join(b for p, b in rows if p == kind)).reshape(-1, len(NAMES)) for kind in (True, False)}
    if not len(x[True]) or not len(x[False]) or prior == 1:
        return Model(np.zeros((0, 0)), np.zeros(0), prior)
    return fit(x[True], x[False], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, mod: int = MOD, remainder: int = REMAINDER) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return scored(slim, model.scores).select("doc_id", pu_learning.held_out("doc_id", mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored(df: DataFrame, scores, text_col: str = "text") -> DataFrame:
    """df without its texts, with a score for each row."""
    names = [c for c in df.columns if c != text_col]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(scores(batch[text_col].to_pylist()), pa.float64())], names=schema.names)

    return df.mapInArrow(work, schema)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; no shuffle."""
    at, schema = docs.columns.index(text_col), docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) >= threshold))

    return docs.mapInArrow(work, schema)
