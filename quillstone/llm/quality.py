"""Quality rules: fixed base rules and gradient-boosted trees over document statistics.

The trees are trained here, with a logistic loss on binned statistics, from at most
``FIT_ROWS`` labelled documents (those with the lowest hash of their id, so the bound
does not depend on the size of the table).  Chosen statistics are constrained to
lower the score as they rise: at each split on one, the two sides' values must be
in order, and the midpoint bounds everything below.  The forest is flattened into
node arrays, and all trees advance together over a batch of documents.

Edge cases: null texts have no words and fail the base rules; documents without a
label are scored like any other; labels that are null, or name no document, are not
used for fitting; with no usable labels of both kinds only the base rules decide;
repeated documents each get their row; other columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import two_columns, with_columns_from

FIT_ROWS = 4000
#: The most that the threshold may cost of the documents labelled good, in the fit.
GOOD_LOSS = 0.002

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics of the trees, with 1 or -1 for a constraint to rise or fall.
STATISTICS = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0, "bangs": -1, "punctuation": 0, "distinct": 0, "long_words": 0}

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _BANGS, _POINTS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:"
_ALPHA = _UPPER + bytes(range(97, 123))


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """The five base figures, and the statistics in the order of STATISTICS."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    gone = lambda drop: len(data) - len(data.translate(None, drop))
    chars = len(text or "") - gone(_SPACE)
    symbols = gone(_SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            covered = bytearray(n)
            for k, w in enumerate(windows):
                if times[w] > 1:
                    covered[k : k + 3] = b"\1\1\1"
            repeat = sum(covered)
    letters = max(1, gone(_ALPHA))
    one = max(1, chars)
    stats = [np.log1p(n), chars / max(1, n), symbols / one, dup / max(1, len(lines)), repeat / max(1, n), gone(_UPPER) / letters, gone(_DIGITS) / one, gone(_BANGS) / one, gone(_POINTS) / one, len(set(words)) / max(1, n), sum(1 for w in words if len(w) > 20) / max(1, n)]
    return [n, chars, symbols, dup, repeat], stats


class Forest:
    """Node arrays of all trees: feature (-1 at a leaf), threshold, children, value."""

    def __init__(self, base: float, threshold: float, trees: list[list[tuple]]):
        self.base, self.threshold = base, threshold
        self.roots = np.cumsum([0, *map(len, trees)])[:-1]
        flat = [(f, t, left + r, right + r, v) for r, tree in zip(self.roots, trees, strict=True) for f, t, left, right, v in tree]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
        self.feature, self.left, self.right = (np.asarray(columns[k], np.int64) for k in (0, 2, 3))
        self.cut, self.value = (np.asarray(columns[k], float) for k in (1, 4))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of good quality per row."""
        if not len(self.roots):
            return np.ones(len(x))
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            go = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, go, at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, ridge: float = 1.0, good_loss: float = GOOD_LOSS) -> Forest:
    """Boosting on histograms with monotonic constraints."""
    if not len(y) or y.min() == y.max():
        return Forest(0.0, 0.0, [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, grown = np.full(len(y), base), []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + ridge) * v * v)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        nodes: list[tuple] = []
        step = np.zeros(len(y))

        def grow(rows, level, low, high, grad=grad, hess=hess, nodes=nodes, step=step):
            me = len(nodes)
            g, h = grad[rows].sum(), hess[rows].sum()
            own = leaf(g, h, low, high)
            nodes.append((-1, 0.0, 0, 0, rate * own))
            best = None
            if level < depth and len(rows) >= 2 * least:
                for f, sign in enumerate(signs):
                    k = len(cuts[f]) + 1
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (grad[rows], hess[rows], None))
                    for c in np.flatnonzero((nl >= least) & (len(rows) - nl >= least)):
                        vl, vr = leaf(gl[c], hl[c], low, high), leaf(g - gl[c], h - hl[c], low, high)
                        if sign * (vr - vl) < 0:
                            continue
                        won = gain(gl[c], hl[c], vl) + gain(g - gl[c], h - hl[c], vr) - gain(g, h, own)
                        if won > 1e-9 and (best is None or won > best[0]):
                            best = (won, f, c, vl, vr)
            if best is None:
                step[rows] = rate * own
                return me
            _, f, c, vl, vr = best
            middle, sign = (vl + vr) / 2, signs[f]
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[sign]
            side = binned[rows, f] <= c
            left = grow(rows[side], level + 1, *bounds[0])
            right = grow(rows[~side], level + 1, *bounds[1])
            nodes[me] = (f, float(cuts[f][c]), left, right, 0.0)
            return me

        grow(np.arange(len(y)), 0, -np.inf, np.inf)
        total += step
        grown.append(nodes)
    forest = Forest(base, 0.0, grown)
    forest.threshold = min(0.5, float(np.quantile(forest.score(x[y == 1]), good_loss)))
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS, **how) -> Forest:
    """Fit on at most ``fit_rows`` labelled documents."""
    spark = docs.sparkSession
    usable = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    rows = usable.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows).collect()
    if not rows:
        return Forest(0.0, 0.0, [])
    few = F.broadcast(spark.createDataFrame(sorted({r.id for r in rows}), "long").withColumnRenamed("value", "doc_id"))  # at most fit_rows ids
    found = two_columns(docs, id_col, text_col).join(few, "doc_id", "left_semi")
    got = dict(_with_figures(found).groupBy("doc_id").agg(F.min("statistics")).collect())  # one row per id
    pairs = [(got[r.id], r.y) for r in rows if r.id in got]
    x = np.asarray([p[0] for p in pairs], float).reshape(len(pairs), len(STATISTICS))
    return fit(x, np.asarray([p[1] for p in pairs], float), list(STATISTICS.values()), **how)


def _with_figures(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with the base figures, and the statistics or (given a forest) the score."""
    fields = [T.StructField(c, T.LongType()) for c in BASE]
    fields.append(T.StructField("score", T.DoubleType()) if forest else T.StructField("statistics", T.ArrayType(T.DoubleType())))

    def make():
        def work(texts):
            both = [describe(t) for t in texts.strings()]
            base = [pa.array([b[0][k] for b in both], pa.int64()) for k in range(len(BASE))]
            stats = [b[1] for b in both]
            return [*base, pa.array(forest.score(np.asarray(stats, float))) if forest else pa.array(stats, pa.list_(pa.float64()))]

        return work

    return with_columns_from(docs, "text", fields, make, keep_text=False)


def quality_verdicts(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base figures, base_failed, score, kept."""
    rows = _with_figures(two_columns(docs, id_col, text_col), forest)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= forest.threshold)).alias("kept"))
