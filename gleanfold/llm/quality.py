"""Quality rules: gradient-boosted trees over document statistics.

The trees are trained here, on a bounded sample of labelled documents, by histogram splits on
binned statistics, with monotonic constraints on chosen ones: a split that would let the score
move against its constraint isn't taken, and the midpoint of a constrained split bounds the values
below it. The trained forest is one set of flat numpy node arrays, so scoring a batch is a few vector
operations per level: every document steps down every tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics the trees see, and the direction in which each may move the score (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "letter_share": 1, "punct_share": 0, "distinct_share": 0}
_SYMBOLS = "#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def text_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (BASE) and the trees' statistics (FEATURES) of one whole text; null counts as empty."""
    import numpy as np

    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    buf = np.frombuffer(joined, np.uint8)
    counts = np.bincount(buf, minlength=256)
    word_chars = int(counts[:128].sum() + counts[192:].sum())  # without UTF-8 continuation bytes
    n_symbols = int(sum(counts[ord(c)] for c in _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = distinct = 0
    if n:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        distinct = len(ids)
        if n > 3:
            _, pair = np.unique(code[:-1] * distinct + code[1:], return_inverse=True)
            _, place, times = np.unique(pair[:-1].astype(np.int64) * distinct + code[2:], return_inverse=True, return_counts=True)
            again = times[place] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            n_repeat = int(covered.sum())
    base = [n, word_chars, n_symbols, n_dup_lines, n_repeat]
    m, c = max(n, 1), max(word_chars, 1)
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum() + counts[192:].sum())
    punct = int(sum(counts[ord(x)] for x in ".,!?;:"))
    return base, [float(np.log1p(n)), word_chars / m, n_symbols / m, n_dup_lines / max(len(lines), 1), n_repeat / m, upper / c, letters / c, punct / m, distinct / m]


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf points to itself."""

    roots: object
    feature: object
    threshold: object
    left: object
    right: object
    value: object
    bias: float
    depth: int

    def score(self, x):
        """Probabilities for rows of statistics."""
        import numpy as np

        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def train_forest(x, y, monotone: list[int], n_trees: int = 40, depth: int = 4, rate: float = 0.2, n_bins: int = 64, ridge: float = 1.0, min_rows: int = 8) -> Forest:
    """Logistic gradient boosting; ``monotone`` has -1, 0 or 1 for each column of x."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(monotone))]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(monotone)), int)
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows, level: int, low: float, high: float, grad, hess) -> int:
        me = len(nodes)
        g, h = float(grad[rows].sum()), float(hess[rows].sum())
        nodes.append([0, np.inf, me, me, rate * leaf(g, h, low, high)])
        best = None
        if level < depth and len(rows) >= 2 * min_rows:
            for j, way in enumerate(monotone):
                n = len(edges[j]) + 1
                if n < 2:
                    continue
                b = binned[rows, j]
                gs, hs, cs = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                ok = (cs >= min_rows) & (len(rows) - cs >= min_rows)
                a, c = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
                if way:
                    ok &= way * (c - a) >= 0
                gain = np.where(ok, gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge), -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = float(gain[k]), j, k, float(a[k]), float(c[k])
        if best:
            _, j, k, a, c = best
            here = binned[rows, j] <= k
            mid = (a + c) / 2
            lo_l, hi_l, lo_r, hi_r = low, high, low, high
            if monotone[j] > 0:
                hi_l, lo_r = mid, mid
            elif monotone[j] < 0:
                lo_l, hi_r = mid, mid
            nodes[me][:2] = j, float(edges[j][k])
            nodes[me][2] = grow(rows[here], level + 1, lo_l, hi_l, grad, hess)
            nodes[me][3] = grow(rows[~here], level + 1, lo_r, hi_r, grad, hess)
        return me

    def flat() -> Forest:
        f, t, left, right, v = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(0, int),) * 5
        return Forest(np.array(roots, int), f.astype(int), t.astype(float), left.astype(int), right.astype(int), v.astype(float), bias, depth)

    for _ in range(n_trees if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        at = np.full(len(x), roots[-1])
        f, t, left, right, v = (np.array(c) for c in zip(*nodes[first:]))
        for _ in range(depth):
            at = np.where(x[np.arange(len(x)), f[at - first]] <= t[at - first], left[at - first], right[at - first])
        margin += v[at - first]
    return flat()


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """doc_id, the base counts, and the statistics (``features``) or, with a forest, the score."""
    last = "score double" if forest else "features array<double>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = [text_statistics(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([m[0][i] for m in made], pa.int64()) for i in range(len(BASE))]
            x = [m[1] for m in made]
            end = pa.array(forest.score(np.array(x, float).reshape(len(x), len(FEATURES)))) if forest else pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, end], names=["doc_id", *BASE, last.split()[0]])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, ", ".join(["doc_id long", *(f"{b} long" for b in BASE), last]))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Train on at most ``sample_rows`` labelled documents, those with the smallest hashed identifiers.

    Without a usable label the forest is a constant that keeps everything.
    """
    good = labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").alias("quality"))
    chosen = good.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    picked = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("label_id")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "quality").repartition(8)
    ids = picked.select("doc_id", "quality").dropDuplicates(["doc_id"])
    made = statistics(picked, "doc_id", "text").dropDuplicates(["doc_id"]).join(ids, "doc_id").orderBy("doc_id").select("features", "quality").toPandas()  # at most sample_rows rows
    if made.quality.nunique() < 2:
        made = made.iloc[:0]
    forest = train_forest(made.features.tolist(), made.quality.tolist(), list(FEATURES.values()))
    if not len(made):
        forest.bias = 9.0
    return forest


def quality_rules(docs: DataFrame, forest: Forest, keep_at: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept for every document.

    Base rule: fewer than 50 words, or over half of them in repeated 3-word windows, fails. Otherwise
    the trees decide: kept from a probability of ``keep_at`` on, so that a doubtful document stays. Null
    and empty texts fail by the base rule. Repeated rows get a row each; an empty table gives none. Other columns are ignored, whatever
    their names. Very long texts are read whole. Equal statistics give equal scores, so ties don't arise.
    """
    scored = statistics(docs, id_col, text_col, forest)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep_at)).select("doc_id", *BASE, "base_failed", "kept", "score")


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def verdict_column(forest: Forest, text_col: str, keep_at: float = 0.3) -> F.Column:
    """Whether quality_rules keeps the text, to be used beside other columns."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        import numpy as np

        made = [text_statistics(t) for t in texts]
        score = forest.score(np.array([m[1] for m in made], float).reshape(len(made), len(FEATURES)))
        return pd.Series([not base_failed(m[0][0], m[0][4]) and bool(x >= keep_at) for m, x in zip(made, score)], dtype=bool)

    return kept(F.col(text_col))
