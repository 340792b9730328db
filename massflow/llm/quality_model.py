"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on statistics of whole texts; every path from a root to
a node is a conjunctive rule; a lasso logistic model weighs the rules, and those
with weight become one Spark column expression over the statistics.

Training rows are a bounded sample: at most ``TRAIN_ROWS`` labelled rows by hash
of doc_id, of those outside the held-out fifth, as ``len(STATS)`` numbers each.  A
tree is grown on ``TREE_ROWS`` draws with replacement from them (as many as there
are rows, if those are fewer).

Defined results: null and empty texts have all statistics zero and get a score
like any other; an empty table gives an empty result; without usable labels every
score is 0.5; a doc_id with several labels counts with the least; null labels are
skipped; of rows of equal doc_id that of least text hash is learned; repeated rows
get equal results; a long text is measured whole, with its words in memory once;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.llm.common import bucket5, map_text, table

#: Labelled rows that are learned, and draws from them for each tree.
TRAIN_ROWS, TREE_ROWS = 4000, 1200
TREES, DEPTH, LEAST_LEAF, CUTS = 40, 3, 10, 24
LASSO = 2e-3
#: Most steps of the fit, which stops at the optimum.
STEPS = 5_000
CUTOFF = 0.3
SEED = 29

STATS = (
    "log_bytes", "words", "word_bytes", "distinct_words", "lines", "dup_lines", "words_per_line",
    "symbols", "digits", "upper", "punctuation", "non_ascii", "controls", "entropy", "top_word",
)


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars.encode())] = 1
    return m


_CLASSES = np.stack([
    _mask("#*$%&|<>"), _mask("0123456789"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(".,;:!?'\"()-"),
    np.r_[np.zeros(128), np.ones(128)], np.r_[np.ones(9), np.zeros(2), np.ones(21), np.zeros(224)],
], 1)


def statistics(text: bytes | None) -> list[float]:
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist[hist > 0] / n
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        float(np.log1p(n)), float(len(words)), sum(map(len, words)) / k, len(counts) / k, float(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), *(hist @ _CLASSES / n).tolist(),
        float(-(share * np.log2(share)).sum()), max(counts.values(), default=0) / k,
    ]


#: A rule: (statistic, at most or over, cut) of each condition on its path.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score, from columns named as in STATS."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for stat, below, cut in rule:
                c = F.col(STATS[stat])
                cond = cond & ((c <= cut) if below else (c > cut))
            total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x))))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for stat, below, cut in rule:
        ok &= (x[:, stat] <= cut) == below
    return ok


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tree_rows: int = TREE_ROWS) -> list[Rule]:
    """All node paths of one tree, grown on ``tree_rows`` draws, by Gini gain on
    random statistics."""
    found: list[Rule] = []

    def grow(rows: np.ndarray, path: Rule) -> None:
        if len(path) >= depth or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
            return
        best = (1e-9, 0, 0.0)
        n, ones = len(rows), y[rows].sum()
        for stat in rng.choice(x.shape[1], max(1, int(x.shape[1] * 0.6)), replace=False):
            v = x[rows, stat]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))):
                left = v <= cut
                a = left.sum()
                if a < LEAST_LEAF or n - a < LEAST_LEAF:
                    continue
                p, q = y[rows][left].sum(), ones - y[rows][left].sum()
                gain = p * p / a + q * q / (n - a) - ones * ones / n
                if gain > best[0]:
                    best = (gain, int(stat), float(cut))
        if best[0] <= 1e-9:
            return
        for below in (True, False):
            rule = (*path, (best[1], below, best[2]))
            found.append(tuple(sorted(rule)))
            grow(rows[(x[rows, best[1]] <= best[2]) == below], rule)

    grow(rng.choice(len(x), min(len(x), tree_rows), replace=True), ())
    return found


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y):
        return RuleModel([], [], 0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    rules = sorted({r for _ in range(TREES) for r in tree_rules(x, y, rng, DEPTH)})
    if not rules:
        return RuleModel([], [], base)
    r = np.stack([holds(k, x) for k in rules], 1).astype(np.float64)
    mean, sd = r.mean(0), np.maximum(r.std(0), 0.02)
    z = np.hstack([(r - mean) / sd, np.ones((len(x), 1))])  # the last weight is the bias, without penalty
    pays = np.r_[np.full(len(rules), LASSO), 0.0]
    w = np.r_[np.zeros(len(rules)), base]
    ahead, t = w, 1.0
    step = 4 * len(z) / (np.linalg.norm(z, 2) ** 2)
    for _ in range(STEPS):  # proximal gradient with momentum, which ends where it leads uphill
        slope = z.T @ (1 / (1 + np.exp(-(z @ ahead))) - y) / len(y)
        off = np.where(ahead != 0, np.abs(slope + pays * np.sign(ahead)), np.maximum(np.abs(slope) - pays, 0))
        if off.max() < LASSO / 100:
            w = ahead
            break
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * pays, 0)
        if (ahead - new) @ (new - w) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    w, b = w[:-1], float(w[-1])
    use = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[i] for i in use], [float(w[i] / sd[i]) for i in use], float(b - (w * mean / sd).sum()))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the statistics of every whole text."""

    def make():
        def fn(texts: list[bytes | None], _: pa.RecordBatch) -> list[pa.Array]:
            rows = np.array([statistics(t) for t in texts]).reshape(-1, len(STATS))
            return [pa.array(rows[:, i]) for i in range(len(STATS))]

        return fn

    return map_text(docs, keep, make, [T.StructField(s, T.DoubleType(), False) for s in STATS])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleModel:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket5(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    picked = F.broadcast(known.withColumnRenamed("doc_id", "pick_id"))  # train_rows rows at most
    text = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("pick_id")).select("doc_id", "y", F.xxhash64("text").alias("th"), "text")
    got = measure(text, ["doc_id", "y", "th"]).groupBy("doc_id", "y").agg(F.min(F.struct("th", *STATS)).alias("s")).select("doc_id", "y", "s.*").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([[r[s] for s in STATS] for r in got]).reshape(-1, len(STATS))
    return fit(x, np.array([float(r["y"]) for r in got]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    made = measure(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", model.column().alias("score"))
    return made.select("doc_id", (bucket5(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
