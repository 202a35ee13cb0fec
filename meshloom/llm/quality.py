"""Quality by a generalised additive model with pairwise interactions.

Every whole text becomes a short vector of shape features.  Features are cut
into quantile bins; boosting cycles over the features and adds, each time, a
tree of at most two splits over the bins of one feature to that feature's
lookup table.  Pairs whose coarse joint bins still explain residuals get tables
of their own, by trees of one split along each side.  A score is a logistic
function of summed table entries, so scoring is bin lookups and additions.

Defined cases: null and empty texts have all-zero features and get the score of
such texts.  Labels that are null are left out.  Without labels of both kinds
every score is the share of good labels, 1 where there are none.  Repeated rows
are scored each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.toxicity import in_training
from meshloom.llm.workers import tidy
from meshloom.plans.scratch import materialize

#: Labelled rows that the model is fitted on, at most: those with the smallest hashed ids.
MAX_LABELLED = 30_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 120, 40, 0.15
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "bangs", "bars", "stops", "symbols",
    "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "words_a_line", "entropy", "non_ascii", "marked_words",
)
_SYMBOLS = list(b"#$%&*@^~<>{}[]\\_=+")
_MARKED = frozenset("#$%&*@^~!|")


def features(text: str) -> list[float]:
    """The shape of a whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n, n_words = len(data), len(words)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    share = seen[seen > 0] / n
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log(n), math.log(n_words), n / n_words, upper / max(1, upper + lower), seen[48:58].sum() / n,
        seen[[33, 63, 44, 46, 58, 59]].sum() / n, seen[33] / n_words, seen[124] / n_words, seen[46] / n_words, seen[_SYMBOLS].sum() / n,
        len(counts) / n_words, pairs / max(1, n_words - 1), max(counts.values()) / n_words, len(set(lines)) / len(lines),
        math.log(n_words / len(lines)), float(-(share * np.log(share)).sum()), seen[128:].sum() / n,
        sum(k for w, k in counts.items() if w[-1] in _MARKED) / n_words,
    ]


def featurise(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``, a row for each row of ``docs (doc_id, text)``."""
    schema = docs.select("doc_id", F.array(F.lit(0.0)).alias("x")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[float(v) for v in features(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)


@dataclass
class Model:
    """``edges``: bin edges of each feature; ``tables`` and ``pair_tables``: what bins add to the log odds."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.bias)
        if len(x) and self.edges:
            at = self.bins(x)
            for k, table in enumerate(self.tables):
                odds += table[at[:, k]]
            for (i, j), table in self.pair_tables.items():
                odds += table[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, splits: int = 2, ridge: float = 2.0) -> np.ndarray:
    """Newton steps by bin: a tree of so many splits, each the best one, over the sums of gradients and weights."""
    pieces = [(0, len(g))]
    for _ in range(splits):
        best = (1e-9, None, 0)
        for at, (a, b) in enumerate(pieces):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (gain[cut], at, a + cut + 1)
        if best[1] is None:
            break
        a, b = pieces[best[1]]
        pieces[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in pieces:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """The best four-quadrant step over joint bins, and its gain."""
    corner = lambda m: np.cumsum(np.cumsum(m, 0), 1)
    cg, ch = corner(g), corner(h)
    best, gain = None, 0.0
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            q = [
                (slice(0, i + 1), slice(0, j + 1), cg[i, j], ch[i, j]),
                (slice(0, i + 1), slice(j + 1, None), cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]),
                (slice(i + 1, None), slice(0, j + 1), cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]),
                (slice(i + 1, None), slice(j + 1, None), cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]),
            ]
            got = sum(a * a / (b + ridge) for _, _, a, b in q) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
            if got > gain:
                best, gain = q, got
    step = np.zeros_like(g)
    for rows, columns, a, b in best or []:
        step[rows, columns] = a / (b + ridge)
    return step, gain


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on ``x`` and 0/1 labels ``y``."""
    if len(y) == 0 or y.min() == y.max():
        return Model(bias=30.0 if len(y) == 0 or y[0] else -30.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = Model(bias=math.log(y.mean() / (1 - y.mean())), edges=edges)
    at = model.bins(x)
    n_bins = [len(e) + 1 for e in edges]
    model.tables = [np.zeros(n) for n in n_bins]
    model.coarse = [np.arange(n) * min(PAIR_BINS, n) // n for n in n_bins]
    odds = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[:, k], g, n_bins[k]), np.bincount(at[:, k], h, n_bins[k]))
            model.tables[k] += step
            odds += step[at[:, k]]
    joint = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (min(PAIR_BINS, n_bins[i]), min(PAIR_BINS, n_bins[j]))
            joint[i, j] = (model.coarse[i][at[:, i]] * shape[1] + model.coarse[j][at[:, j]], shape)

    def pair_step(pair: tuple[int, int]) -> tuple[np.ndarray, float]:
        cells, shape = joint[pair]
        g, h = slopes()
        n = shape[0] * shape[1]
        return _pair_tree(np.bincount(cells, g, n).reshape(shape), np.bincount(cells, h, n).reshape(shape))

    gains = {pair: pair_step(pair)[1] for pair in joint}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pair_tables[pair] = np.zeros(joint[pair][1])
    for _ in range(PAIR_ROUNDS):
        for pair, table in model.pair_tables.items():
            step = RATE * pair_step(pair)[0]
            table += step
            odds += step.ravel()[joint[pair][0]]
    return model


def training_rows(featured: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled training rows, one for each id (its least features)."""
    rows = labels.where(in_training(F.col("doc_id")) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = featured.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # limit rows of two numbers
    found = featured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas()  # limit rows
    found = found.sort_values("doc_id")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    return x, (found["y"] > 0).to_numpy(dtype=float)


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, score)``, a row for each row of ``docs (doc_id, text)``; learns from ``labels (doc_id, quality)``."""
    featured = materialize(featurise(docs), "quality-features")
    model = fit(*training_rows(featured, labels, "quality", limit))
    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return featured.mapInArrow(tidy(work), schema)
