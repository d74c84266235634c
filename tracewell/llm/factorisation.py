"""Document quality by a factorisation machine."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import whole_text

#: Sizes of the model: buckets of hashed words, factors, bins per statistic.
WORD_BUCKETS, FACTORS, BINS = 1 << 14, 8, 12
#: The model is fitted on at most so many labelled rows, drawn by a hash of their id.
SAMPLE_ROWS = 8000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.1, 2e-5
THRESHOLD = 0.3
RESULTS = ("score", "predicted")

_KIND = np.full(256, 6)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"!?()-")):
    _KIND[list(_chars)] = _i
_KIND[128:] = 7
N_STATS = 16


def statistics(text: str, counts: Counter, metadata: float) -> list[float]:
    """Structure of a text: lengths, shares of kinds of bytes, repetition of words and lines, and the metadata."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    kinds = np.bincount(_KIND[data], minlength=8) / max(1, len(data))
    words = sum(counts.values())
    most = max(counts.values(), default=0)
    lines = text.split("\n")
    return [np.log1p(len(data)), np.log1p(words), len(data) / max(1, words), most / max(1, words), len(counts) / max(1, words) ** 0.8,
            np.log1p(len(lines)), len(set(lines)) / len(lines), max(map(len, counts), default=0), *kinds.tolist()[:7],
            metadata]


def features(text: str, metadata: float) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, buckets of the hashed words and their values, which have length one together."""
    counts = Counter(text.lower().split())
    stats = statistics(text, counts, metadata)
    buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), "i8", len(counts)) % WORD_BUCKETS
    weights = np.bincount(buckets, np.log1p(np.fromiter(counts.values(), "f8", len(counts))), WORD_BUCKETS) if len(counts) else np.zeros(WORD_BUCKETS)
    at = np.flatnonzero(weights)
    return stats, at, weights[at] / max(1e-12, float(np.sqrt((weights[at] ** 2).sum())))


@dataclass
class Model:
    """Bias, weight and factors of each feature; ``edges`` cut each statistic into bins."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """Number of the feature that each statistic falls into."""
        bins = np.stack([np.searchsorted(e, stats[:, i], "right") for i, e in enumerate(self.edges)], axis=1)
        return WORD_BUCKETS + np.arange(len(self.edges)) * BINS + bins

    def scores(self, rows: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Raw scores of n documents from flat (row, feature, value).

        Pairwise interactions cost linear time: half of the squared sum minus
        the sum of squares of the factors times values.
        """
        vx = self.factors[at] * x[:, None]
        starts = np.searchsorted(rows, np.arange(n))
        sums, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares)


def _flat(model: Model, rows: list[tuple[list[float], np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (row, feature, value): the bins of the statistics (value one half), then the words, of each row."""
    bins = model.binned(np.array([r[0] for r in rows]))
    at = np.concatenate([part for b, r in zip(bins, rows) for part in (b, r[1])])
    x = np.concatenate([part for r in rows for part in (np.full(N_STATS, 0.5), r[2])])
    return np.repeat(np.arange(len(rows)), [N_STATS + len(r[1]) for r in rows]), at, x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit(rows: list[tuple[list[float], np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit by adaptive gradient steps on the logistic loss. Without rows every score is one half."""
    size = WORD_BUCKETS + N_STATS * BINS
    draw = np.random.default_rng(17)
    model = Model(0.0, np.zeros(size), draw.normal(0.0, 0.05, (size, FACTORS)), np.zeros((N_STATS, BINS - 1)))
    if not rows:
        model.factors[:] = 0.0
        return model
    stats = np.array([r[0] for r in rows])
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    weight_steps, factor_steps, bias_steps = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            row, at, x = _flat(model, [rows[i] for i in chosen])
            error = _sigmoid(model.scores(row, at, x, len(chosen))) - labels[chosen]
            vx = model.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, np.searchsorted(row, np.arange(len(chosen))), axis=0)
            step = (error[row] * x)[:, None] * (sums[row] - vx)
            used, place = np.unique(at, return_inverse=True)
            gradient = np.bincount(place, error[row] * x, len(used)) / BATCH + DECAY * model.weights[used]
            weight_steps[used] += gradient ** 2
            model.weights[used] -= RATE * gradient / np.sqrt(weight_steps[used])
            for f in range(FACTORS):
                gradient = np.bincount(place, step[:, f], len(used)) / BATCH + DECAY * model.factors[used, f]
                factor_steps[used, f] += gradient ** 2
                model.factors[used, f] -= 0.3 * RATE * gradient / np.sqrt(factor_steps[used, f])
            slope = float(error.mean())
            bias_steps += slope ** 2
            model.bias -= RATE * slope / bias_steps ** 0.5
    return model


def is_held_out(doc_id: str) -> Column:
    """Every fifth id, by checksum of its text: never used for fitting. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _metadata(docs: DataFrame, column: str) -> Column:
    """The declared length over the real one, 0 where it is missing or not a number."""
    if column not in docs.columns:
        return F.lit(0.0)
    ratio = F.col(column).try_cast("double") / F.greatest(F.length(whole_text("text")), F.lit(1))
    return F.coalesce(F.when(F.isnan(ratio) | (F.abs(ratio) > 1e6), 0.0).otherwise(ratio), F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that are not held out.

    The sample is drawn from the labels alone, so only its rows are read
    whole, and only their features reach the driver. Labels other than 0 and
    1 and labels without a document are passed over.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least")
    sample = sample.select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", whole_text("text").alias("_t_text"), _metadata(docs, "n_chars").alias("_t_meta"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t, m) for t, m in zip(batch["_t_text"], batch["_t_meta"])]
            yield pd.DataFrame({"quality": batch["quality"], "doc_id": batch["doc_id"], "stats": [m[0] for m in made],
                                "at": [m[1].astype("i4") for m in made], "x": [m[2] for m in made]})

    kind = dict(rows.dtypes)["doc_id"]
    found = rows.join(F.broadcast(sample), "doc_id").mapInPandas(
        run, f"quality int, doc_id {kind}, stats array<double>, at array<int>, x array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable").head(2 * sample_rows)  # one order, whatever the partitions were
    made = [(list(s), np.asarray(a, "i8"), np.asarray(x, "f8")) for s, a, x in zip(found["stats"], found["at"], found["x"])]
    return fit(made, found["quality"].to_numpy("f8"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 at ``threshold`` or more) to every row.

    Whole texts are scored, NULL as an empty one, which has statistics and no
    words. Labels, language, source and id are no inputs. The model has a
    fixed size and travels with the tasks; nothing is shuffled, repeated rows
    get equal scores, and an empty table gives an empty result.
    """
    docs = docs.drop(*RESULTS)

    @F.pandas_udf("double")
    def scores(texts: pd.Series, metadata: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for start in range(0, len(texts), BATCH):
            rows = [features(t, m) for t, m in zip(texts[start:start + BATCH], metadata[start:start + BATCH])]
            out[start:start + BATCH] = _sigmoid(model.scores(*_flat(model, rows), len(rows)))
        return pd.Series(out)

    scored = docs.withColumn("score", scores(whole_text("text"), _metadata(docs, "n_chars")))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
