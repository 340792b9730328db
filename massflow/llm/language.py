"""Language identification with error-correcting output codes.

Every language gets a codeword of bits (all 2^(K-1) - 1 dichotomies for up to
five languages, else the most separated of seeded random codes).  One binary
logistic classifier over hashed byte trigrams predicts each bit, and decoding
picks the codeword of least loss, where each bit's logistic loss is weighted by
its classifier's accuracy on rows kept from its training.

Every language that a label names is learned.  Training rows are a bounded sample:
of each language those of least hash of doc_id outside the held-out fifth,
``PER_LANGUAGE`` of them, or fewer where there are so many languages that they come
to more than ``TRAIN_ROWS`` (but one at least).  Two scans find them: counts of hash levels give each
language a hash bound, and the rows within the bound become fixed-size vectors on the
executors.  The driver gets max(TRAIN_ROWS, languages) x DIM numbers at most.
Prediction covers every whole text.

Defined results: ``und`` with score 0 for null, empty and letterless texts and
where no label could be learned; an empty table gives an empty result; a null
doc_id counts as held out; repeated rows get equal results; of rows of equal
doc_id and label that of least text hash is learned; equal losses go to the first
language by name; a text of any length is one vector of DIM numbers, made in
pieces; extra columns are ignored.  ``ambiguous`` marks a weighted loss margin
below ``AMBIGUOUS`` between the two nearest codewords.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.llm.common import bucket5, free_name, map_text, materialise, table

DIM = 4096
#: Most rows that are learned of a language, and of all.
PER_LANGUAGE = 400
TRAIN_ROWS = 25_600
AMBIGUOUS = 0.5
SEED = 17
#: Trigrams that are hashed at once.
SPAN = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
_ASCII_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    raw = np.frombuffer(text, np.uint8)
    if _ASCII_LETTER[raw].any():
        return True
    return bool((raw > 127).any()) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def vector(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of a whole text."""
    whole = _FOLD[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)]
    if len(whole) < 3:
        return np.zeros(DIM, np.float32)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(whole) - 2, SPAN):
        raw = whole[at : at + SPAN + 2].astype(np.uint32)
        code = (raw[:-2] * np.uint32(2654435761) + raw[1:-1] * np.uint32(2246822519) + raw[2:] * np.uint32(3266489917)) >> np.uint32(20)
        counts += np.bincount(code, minlength=DIM)
    return np.sqrt(counts / (len(whole) - 2)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = np.array([b for b in product((1, -1), repeat=k) if b[0] == 1 and -1 in b])
        return bits.T.astype(float)
    width = max(15, int(np.ceil(10 * np.log2(k))))
    best, apart = None, -1
    for seed in range(min(200, max(4, 20_000 // k))):
        code = np.random.default_rng(SEED + seed).choice((-1.0, 1.0), (k, width))
        far = int(((width - code @ code.T) / 2 + width * np.eye(k)).min())
        if far > apart:
            best, apart = code, far
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    coef: np.ndarray
    bias: np.ndarray
    weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and the loss margin."""
        f = x @ self.coef + self.bias
        near, far = self.weight * np.logaddexp(0, -f), self.weight * np.logaddexp(0, f)  # loss of a bit where a codeword has +1, or -1
        up = (self.code > 0).T.astype(float)
        loss = near @ up + far @ (1 - up)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(x))
        low = loss[rows, order[:, 0]]
        margin = loss[rows, order[:, 1]] - low if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return order[:, 0], 1 / np.exp(low[:, None] - loss).sum(1), margin


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Columns of y in {-1, 1}; accelerated gradient steps for all bits at once."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    y = y.astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    turned, ahead, rate = np.ascontiguousarray(x1.T), w.copy(), np.float32(2)
    for t in range(steps):
        grad = -(turned @ (y / (1 + np.exp(np.clip(y * (x1 @ ahead), -30, 30))))) / np.float32(len(x)) + np.float32(ridge) * ahead
        new = ahead - rate * grad
        ahead, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w[:-1], w[-1]


def fit(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIM, 1)), np.ones(1), np.ones(1))
    y = code[[languages.index(v) for v in labels]]
    check = np.arange(len(x)) % 5 == 0
    coef, bias = _logistic(x[~check], y[~check])
    right = (np.sign(x[check] @ coef + bias) == y[check]).mean(0) if check.any() else np.ones(code.shape[1])
    coef, bias = _logistic(x, y)
    weight = np.maximum(right, 1e-3)
    return Model(languages, code, coef, bias, weight / weight.mean())


def level(h: Column) -> Column:
    """The level of a hash among 64 x 16, finer toward 0: its bits and the four
    after the first one."""
    bits = F.length(F.bin(h))
    top = F.when(bits > 5, F.expr("shiftrightunsigned(h, int(length(bin(h)) - 5))")).otherwise(h)
    return F.when(h < 16, h).otherwise((bits - 1) * 16 + top.bitwiseAND(F.lit(15))).cast("int")


def sample_bounds(rows: DataFrame, per_language: int = PER_LANGUAGE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(pick_lang, most, each): the level up to which a language's rows hold
    ``each`` rows or all; ``rows`` has lang and h."""
    counts = rows.groupBy("lang", level(F.col("h")).alias("level")).agg(F.count("*").alias("n"))
    counts = materialise(counts, "levels")
    known = counts.select("lang").distinct().count()
    each = min(per_language, max(1, train_rows // max(1, known)))
    upto = counts.selectExpr("lang", "level", "sum(n) OVER (PARTITION BY lang ORDER BY level) AS upto")
    most = F.coalesce(F.min(F.when(F.col("upto") >= each, F.col("level"))), F.max("level"))
    return materialise(upto.groupBy(F.col("lang").alias("pick_lang")).agg(most.alias("most")).withColumn("each", F.lit(each)), "bounds")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, train_rows: int = TRAIN_ROWS) -> Model:
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (bucket5(F.col("doc_id")) != 0))
    rows = rows.withColumn("h", F.expr("shiftrightunsigned(xxhash64(doc_id), 1)"))
    bounds = sample_bounds(rows.select("lang", "h"), per_language, train_rows)
    # a row for each language: Spark broadcasts the table while its file is below the threshold
    near = rows.join(bounds, (F.col("lang") == F.col("pick_lang")) & (level(F.col("h")) <= F.col("most")))
    near = near.select("doc_id", "lang", "h", "each", F.xxhash64("text").alias("th"), "text")

    def make():
        def fn(texts, _):
            return [pa.array([has_letter(t) for t in texts]), pa.array([vector(t).tobytes() for t in texts], pa.binary())]

        return fn

    got = map_text(near, ["doc_id", "lang", "h", "each", "th"], make, [T.StructField("ok", T.BooleanType()), T.StructField("x", T.BinaryType())])
    got = got.filter("ok").groupBy("lang", "h", "doc_id").agg(F.min(F.struct("th", "x")).alias("s"), F.max("each").alias("each"))
    # a level holds at most a sixteenth of the rows below twice its hash, so a window's group is small
    got = got.withColumn("place", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, doc_id)")).filter("place <= each")
    got = got.select("doc_id", "lang", "s.x").collect()  # max(train_rows, languages) rows at most
    got.sort(key=lambda r: (r[0], r[1]))
    if not got:
        return Model([], np.ones((0, 1)), np.zeros((DIM, 1)), np.zeros(1), np.ones(1))
    return fit(np.stack([np.frombuffer(r[2], np.float32) for r in got]), [r[1] for r in got])


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and lang_pred, score, ambiguous of every row."""

    def make():
        def fn(texts: list[bytes | None], _: pa.RecordBatch) -> list[pa.Array]:
            known = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
            lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                best, p, margin = model.decode(np.stack([vector(texts[j]) for j in part]))
                score[part], doubt[part] = p, margin < AMBIGUOUS
                for j, b in zip(part.tolist(), best.tolist(), strict=True):
                    lang[j] = model.languages[b]
            return [pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)]

        return fn

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return map_text(docs, keep, make, fields)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    made = identify(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return made.select("doc_id", (bucket5(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is determined: those without letters
    or with a score under one half and an ambiguous codeword go."""
    model = train(docs)
    new = {"lang_pred", "score", "ambiguous"}
    safe = {c: free_name(docs, f"doc_{c}") for c in docs.columns if c.lower() in new}
    made = identify(docs.withColumnsRenamed(safe), model, [safe.get(c, c) for c in docs.columns])
    kept = made.filter("lang_pred <> 'und' AND NOT (ambiguous AND score < 0.5)")
    return kept.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
