"""Token counts from distinct pre-tokens.

No piece of the model crosses from a non-blank to a blank, and none holds a
newline, so the tokens of a text are those of its pre-tokens: a run of blanks
with the characters up to the next blank or newline.  A task counts the pieces
of each distinct pre-token once, joins the counts to the pre-token frequencies
of each document, and sums; the ids of a text are never built.

The join is a lookup inside the task, which holds the document's frequencies
anyway, so nothing is shuffled; the table of counts restarts at ``CACHE_ENTRIES``
(that costs work, not rows).  Both conditions are checked against the model.

Defined results: a null text is empty; empty texts have 0 tokens; an empty table
gives an empty result; repeated rows get equal results; a long text is counted whole,
with its distinct pre-tokens in memory, and one without blanks is one pre-token; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from massflow.llm.common import map_text, table

LIMIT = 4096
CACHE_ENTRIES = 600_000

_PRE = re.compile("[ ▁]+[^ ▁\n]*|\n+|[^ ▁\n]+")
_models: dict[str, object] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str):
    """The model, checked for what the operator relies on; one per process."""
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross blanks or newlines")
        probe = " ﬁ a  b　\xbd "
        if m.decode(m.encode(probe)) != probe or m.encode("a")[0] != m.piece_to_id("▁a"):
            raise ValueError("this model changes its text or adds no leading blank")
        _models[path] = m
    return _models[path]


class Counts:
    """Pieces of distinct pre-tokens."""

    def __init__(self, path: str):
        self.model = load(path)
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
        led = [w for w in new if w[0] in " ▁" and len(w) > 1]
        bare = [w for w in new if w[0] not in " ▁\n"]
        self.known.update(zip(led, map(len, self.model.encode([w[1:] for w in led], num_threads=1)), strict=True))
        # the leading blank and the newline that keep a bare word bare are two pieces
        self.known.update(zip(bare, (len(x) - 2 for x in self.model.encode(["\n" + w for w in bare], num_threads=1)), strict=True))
        self.known.update((w, len(w)) for w in new if w[0] == "\n")
        self.known.update((w, 1) for w in (" ", "▁"))  # a lone blank, which the library drops from an empty text

    def totals(self, texts: list[str]) -> list[int]:
        freqs = [Counter(_PRE.findall(" " + t)) if t else {} for t in texts]
        known = self.known
        new = {w for f in freqs for w in f if w not in known}
        if new:
            if len(known) + len(new) > CACHE_ENTRIES:
                new = {w for f in freqs for w in f}
            self.learn(list(new))
        return [sum(n * known[w] for w, n in f.items()) for f in freqs]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = model or default_model()

    def make():
        counts = Counts(path)

        def fn(texts: list[bytes | None], _: pa.RecordBatch) -> list[pa.Array]:
            raw = [t or b"" for t in texts]
            sums: list[int] = []
            for i in range(0, len(raw), 128):
                sums += counts.totals([t.decode("utf-8", "replace") for t in raw[i : i + 128]])
            return [pa.array([len(t) for t in raw], pa.int64()), pa.array(sums, pa.int64()), pa.array([n > limit for n in sums], pa.bool_())]

        return fn

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_text(docs.select("doc_id", "text"), ["doc_id"], make, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
