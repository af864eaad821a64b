"""Quality grades by ordinal cumulative-link regression on hashed text.

Rated documents have grade 0 (harmful), 1 (poor) or 2 (good). One weight vector over hashed text
features is shared by all grades; ordered thresholds cut its score: P(grade <= k) is the logistic
function of threshold k less the score. The fit minimises the penalised negative log-likelihood on
a bounded sample of rated documents; every document is then graded in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text

#: Rated documents that the model is fitted on at most, those first in a hash order of their ids.
SAMPLE = 8000
GRADES = 3
BITS = 20
#: A feature has a weight if so many documents of the sample have it.
LEAST_DOCS = 5
PENALTY = 1e-3
STEPS = 150
#: A document with more features than the square of this gives each less.
FEATURE_ROOT = 10.0
#: Least probability of the top grade for a document to be accepted.
ACCEPT = 0.5

_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+")
_PLAIN_MARKS = frozenset((".", ",", ";", ":", "!", "?", "-", "'", '"', "(", ")"))


@lru_cache(maxsize=100_000)
def _hashed(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind} {value}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def features(text: str) -> np.ndarray:
    """Distinct hashed features: words, their beginnings, marks, and shares of odd shapes."""
    tokens = _TOKENS.findall(text)
    words = [t for t in tokens if t[0].isalpha()]
    marks = [t for t in tokens if not t[0].isalnum()]
    n = len(words) or 1
    found = set()
    for w in {w.lower() for w in words}:
        found.add(_hashed("word", w))
        if len(w) > 4:
            found.add(_hashed("begin", w[:4]))
    for m in {m[:3] for m in marks}:
        found.add(_hashed("mark", m))
    shares = (
        ("marks", len(marks)), ("odd marks", sum(m not in _PLAIN_MARKS for m in marks)),
        ("capitals", sum(len(w) > 1 and w.isupper() for w in words)),
        ("repeats", sum(a == b for a, b in zip(words, words[1:], strict=False))),
        ("distinct", len(set(words))), ("bars", text.count("|")),
    )
    for name, count in shares:
        found.add(_hashed("share", f"{name} {int(np.ceil(min(count / n, 1) * 10))}"))
    found.add(_hashed("size", str(n.bit_length())))
    return np.fromiter(found, np.int64, len(found))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by feature and ascending thresholds; without thresholds every grade is ``only``."""

    weights: np.ndarray
    thresholds: np.ndarray
    only: int | None = None

    def probabilities(self, text: str) -> np.ndarray:
        """P(grade = 0), P(grade = 1), P(grade = 2)."""
        if self.only is not None:
            return np.eye(GRADES)[self.only]
        found = features(text)
        score = self.weights[found].sum(dtype=np.float64) * min(1.0, FEATURE_ROOT / np.sqrt(len(found)))
        upto = np.concatenate([[0.0], _logistic(self.thresholds - score), [1.0]])
        return np.diff(upto)


def fit(texts: list[str], grades: list[int], penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Penalised maximum likelihood by full gradients with adaptive steps; always the same result."""
    y = np.array(grades, np.int64)
    there = np.unique(y)
    if len(there) < 2:
        return Model(np.zeros(0), np.zeros(0), int(there[0]) if len(there) else GRADES - 1)
    found = [features(t) for t in texts]
    docs = np.bincount(np.concatenate(found), minlength=1 << BITS)
    kept = np.flatnonzero(docs >= min(LEAST_DOCS, len(y)))
    column = np.full(1 << BITS, -1)
    column[kept] = np.arange(len(kept))
    value = np.array([min(1.0, FEATURE_ROOT / np.sqrt(len(f))) for f in found])
    row = np.repeat(np.arange(len(y)), [len(f) for f in found])
    at = column[np.concatenate(found)]
    row, at = row[at >= 0], at[at >= 0]
    share = np.bincount(y, minlength=GRADES)
    weight = np.sqrt(1 / share[y])
    weight /= weight.mean()
    n = len(y)
    x = np.concatenate([np.zeros(len(kept)), np.linspace(-2, -1, GRADES - 1)])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        score = np.bincount(row, x[at], n) * value
        cuts = np.sort(x[len(kept):])
        x[len(kept):] = cuts
        upto = np.concatenate([np.zeros((1, n)), _logistic(cuts[:, None] - score), np.ones((1, n))])
        slope = upto * (1 - upto)
        likely = np.maximum(upto[y + 1, np.arange(n)] - upto[y, np.arange(n)], 1e-12)
        up, down = slope[y + 1, np.arange(n)] / likely * weight, slope[y, np.arange(n)] / likely * weight
        grad = np.bincount(at, ((up - down) * value)[row], len(kept)) / n + penalty * x[: len(kept)]
        cut_grad = [(down[y == k + 1].sum() - up[y == k].sum()) / n for k in range(GRADES - 1)]
        g = np.concatenate([grad, cut_grad])
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        x -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = x[: len(kept)]
    return Model(weights, np.sort(x[len(kept):]))


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(text, grade)`` of at most ``sample`` rated documents.

    ``labels`` has ``(doc_id, quality, toxic)``: a toxic document has grade 0, another one of
    quality 0 grade 1, of quality 1 grade 2. Labels with a null id or quality rate nothing unless
    toxic; of several labels of a document the lowest grade counts.
    """
    grades = (
        labels.filter("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("r_id"),
            F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
        .filter("grade is not null").groupBy("r_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("r_id"), "r_id").limit(sample)
    )
    return docs.join(F.broadcast(grades), F.col("doc_id") == F.col("r_id")).select("doc_id", "text", "grade")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the sample, gathered in id order so that it doesn't hang on the partitions."""
    rows = rated(docs, labels, sample).orderBy("doc_id", F.xxhash64("text")).limit(sample).collect()
    return fit([r.text for r in rows], [r.grade for r in rows])


def grade(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``docs(doc_id, text)`` graded: ``(doc_id, grade, expected_grade, p_good, accepted)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            p = np.array([shared.value.probabilities(t) for t in batch["text"].to_pylist()]).reshape(-1, GRADES)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in batch.schema.names if c != "text"], pa.array(p.argmax(1).astype(np.int32)),
                 pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1]), pa.array(p[:, -1] >= accept)],
                [*[c for c in batch.schema.names if c != "text"], "grade", "expected_grade", "p_good", "accepted"])

    return docs.mapInArrow(
        read, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
        + ", grade int, expected_grade double, p_good double, accepted boolean")


def graded_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, grade, expected_grade, p_good, accepted)``.

    ``grade`` is the likeliest, ``expected_grade`` the mean and ``p_good`` the tail probability of
    the top grade; a document is accepted if that is ``accept`` or more. A null text is the empty
    text, which its shape alone grades. Null ids and repeated rows are graded like any row. Without
    labels all documents are accepted; with labels of one grade all get it. Other columns are not
    read.
    """
    own = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), whole_text("text").alias("text"))
    return grade(own, train(own, labels, sample), accept)


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that are accepted, all columns as they came."""
    own = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(f"`{text_col}`").alias("text"))
    model = train(own, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series([shared.value.probabilities(t)[-1] >= accept for t in texts])

    return docs.filter(good(whole_text(f"`{text_col}`")))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Every document graded by a model of the rated ones."""
    return graded_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
