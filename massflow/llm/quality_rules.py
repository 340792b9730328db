"""Quality rules with thresholds from mergeable quantile sketches.

Base counts are taken from every whole text.  Four ratios, as whole numbers,
get adaptive bounds for each language and source: a ratio is put in a bucket of
a sketch (exact below 64, then 32 buckets an octave, so 3 % wide), sketches are
tables of (language, source, rule, bucket, count) that merge by adding, and a
group's bounds are its quartiles widened by ``FENCE`` times their distance plus
the rule's slack.  A group's quartiles are weighed by its rows against ``PRIOR_ROWS``
rows at the quartiles of its language, and those against as many of the whole
table: small groups lean on larger ones, and no size is a special case.

Defined results: null text counts as text without words (base_failed); null
language or source is a group of its own; repeated rows get equal results;
empty tables give empty results; a long text is counted whole, in one row's
arrays of its words and window hashes; extra columns are kept out of the way.
Window hashes are XXH64 of eight words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import BROADCAST_ROWS, NOT_SPACE, SPACE, free_name, materialise, table
from massflow.operators.joins import join_spread

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FENCE = 6
PRIOR_ROWS = 50
#: Ratio (SQL over the counts), slack above its upper quartile, slack below its
#: lower quartile or None where small values are no fault.
RULES: dict[str, tuple[str, int, int | None]] = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1L)", 30, None),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1L)", 400, None),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1L)", 280, None),
    "word_length": ("100 * word_chars div greatest(n_words, 1L)", 200, 200),
}

_JAVA_SPACE = SPACE.replace("\\", "\\\\")
_JAVA_WORD = NOT_SPACE.replace("\\", "\\\\")

#: Words covered by 8-word windows that occur twice; ``w`` is bound once.
_REPEATS = f"""transform(array(w), w -> transform(
  array(IF(size(w) < {WINDOW + 1}, cast(array() AS array<bigint>), transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))))), h ->
  IF(size(array_distinct(h)) = size(h), 0L,
    transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
      transform(array(sort_array(transform(filter(s, (e, k) -> coalesce(e.x = get(s, k - 1).x, false) OR coalesce(e.x = get(s, k + 1).x, false)), e -> e.i))), p ->
        aggregate(transform(p, (v, k) -> least({WINDOW}, coalesce(get(p, k + 1) - v, {WINDOW}))), 0L, (a, v) -> a + v))[0])[0]))[0])[0]"""


def counts(text: str = "text") -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words of a text column."""
    t = f"coalesce(`{text}`, '')"
    words = f"transform(array(regexp_replace({t}, '^{_JAVA_SPACE}+|{_JAVA_SPACE}+\\\\z', '')), x -> IF(x = '', cast(array() AS array<string>), split(x, '{_JAVA_SPACE}+')))[0]"
    lines = f"filter(split({t}, '\\n'), x -> x RLIKE '{_JAVA_WORD}')"
    return F.expr(f"""transform(array(struct({words} AS w, {lines} AS l)), v -> struct(
        cast(size(v.w) AS bigint) AS n_words,
        cast(length({t}) - regexp_count({t}, '{_JAVA_SPACE}') AS bigint) AS word_chars,
        cast(regexp_count({t}, '[#*$%&|<>]') AS bigint) AS n_symbols,
        cast(size(v.l) AS bigint) AS n_lines,
        cast(size(v.l) - size(array_distinct(v.l)) AS bigint) AS n_dup_lines,
        {_REPEATS.replace("array(w), w ->", "array(v.w), w ->", 1)} AS n_repeat_words))[0]""")


def bucket(x: str) -> str:
    """The sketch bucket of a whole number: itself below 64, then 32 an octave."""
    e = f"(length(bin({x})) - 6)"
    return f"IF({x} < 64, {x}, 32 * {e} + shiftright({x}, {e}))"


def least_of(b: str) -> str:
    """The least number of a bucket."""
    e = f"(({b} div 32) - 1)"
    return f"IF({b} < 64, {b}, shiftleft(32L + {b} % 32, cast({e} AS int)))"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) from rows of lang, source and counts."""
    ratios = ", ".join(f"struct('{k}' AS rule, cast({v[0]} AS bigint) AS x)" for k, v in RULES.items())
    each = measured.selectExpr("lang", "source", f"explode(array({ratios})) AS r")
    return each.selectExpr("lang", "source", "r.rule", f"cast({bucket('r.x')} AS bigint) AS bucket").groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, own_rows (rows of the group) and each rule's bounds.

    A window here spans the buckets of one sketch, a bounded number."""
    def bounds(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        by = ", ".join([*keys, "rule"])
        run = df.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        run = run.selectExpr(*keys, "rule", "bucket", f"sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto", f"sum(n) OVER (PARTITION BY {by}) AS total")
        q = run.groupBy(*keys, "rule").agg(F.max("total").alias("total"), F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"))
        q = q.selectExpr(*keys, "rule", "total", f"{least_of('q1')} AS lo", f"{least_of('q3')} AS hi")
        pairs = F.map_from_entries(F.collect_list(F.struct("rule", F.struct("lo", "hi"))))
        return q.groupBy(*keys).agg(F.max("total").alias(f"{name}_rows"), pairs.alias(name))

    own = bounds(sketch, ["lang", "source"], "own")
    lang = bounds(sketch, ["lang"], "mid").withColumnRenamed("lang", "mid_lang")
    whole = bounds(sketch, [], "whole")
    joined = own.join(lang, own["lang"].eqNullSafe(lang["mid_lang"])).join(F.broadcast(whole))  # one row

    def leaning(rows: str, q: str, far: str) -> str:
        return f"(({rows} * {q} + {PRIOR_ROWS} * {far}) div ({rows} + {PRIOR_ROWS}))"

    for k in RULES:
        for end in ("lo", "hi"):
            mid = leaning("mid_rows", f"mid['{k}'].{end}", f"whole['{k}'].{end}")
            joined = joined.withColumn(f"{k}_{end}_q", F.expr(leaning("own_rows", f"own['{k}'].{end}", mid)))
    cuts = []
    for k, (_, above, below) in RULES.items():
        lo, hi = F.col(f"{k}_lo_q"), F.col(f"{k}_hi_q")
        far = FENCE * (hi - lo)
        low = (lo - far - below) if below is not None else F.lit(-1).cast("long")
        cuts += [low.alias(f"{k}_lo"), (hi + far + above).alias(f"{k}_hi")]
    return joined.select("lang", "source", "own_rows", *cuts)


def verdict(prefix: str = "") -> str:
    """SQL of kept over counts, base_failed and thresholds."""
    return " AND ".join([f"NOT {prefix}base_failed", *(f"{_over(v[0], prefix)} BETWEEN {k}_lo AND {k}_hi" for k, v in RULES.items())])


def _over(ratio: str, prefix: str) -> str:
    for c in ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_repeat_words", "n_words"):
        ratio = ratio.replace(c, prefix + c)
    return f"({ratio})"


BASE_FAILED = f"{{0}}n_words < {MIN_WORDS} OR 100 * {{0}}n_repeat_words > {MAX_REPEAT_PERCENT} * {{0}}n_words"


def with_cuts(own: DataFrame, counts_of: DataFrame) -> DataFrame:
    """``own`` with the bounds of its group; ``counts_of`` has lang, source and
    counts.  The table of groups is counted: it is broadcast up to
    ``BROADCAST_ROWS`` rows, and beyond that large groups are dealt to several tasks."""
    key = free_name(own, "rule_group")
    cuts = materialise(thresholds(sketches(counts_of)).selectExpr(f"struct(lang, source) AS {key}", "* EXCEPT (lang, source)"), "thresholds")
    keyed = own.withColumn(key, F.struct("lang", "source"))
    if cuts.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(cuts.drop("own_rows")), key, "left").drop(key)
    return join_spread(keyed, cuts, key, "own_rows", own.count(), "left").drop(key)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept of every row."""
    own = docs.select("doc_id", "lang", "source", counts().alias("c")).select("doc_id", "lang", "source", "c.*")
    own = materialise(own.withColumn("base_failed", F.expr(BASE_FAILED.format(""))), "counts")
    both = with_cuts(own, own)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(verdict()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns.  Counts are
    written once beside the rows and read back for the verdict."""
    c = free_name(docs, "rule_counts")
    own = materialise(docs.withColumn(c, counts()), "rules")
    both = with_cuts(own, own.select("lang", "source", f"{c}.*"))
    good = verdict(f"{c}.").replace(f"{c}.base_failed", f"({BASE_FAILED.format(c + '.')})")
    return both.filter(good).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """DuckDB text of the same rules."""
    ratio = {k: v[0].replace(" div ", " // ").replace("1L", "1") for k, v in RULES.items()}

    def b(x: str) -> str:
        e = f"(length(bin({x})) - 6)"
        return f"CASE WHEN {x} < 64 THEN {x} ELSE 32 * {e} + ({x} >> {e}) END"

    def low(x: str) -> str:
        return f"CASE WHEN {x} < 64 THEN {x} ELSE ((32 + {x} % 32)::BIGINT << (({x} // 32) - 1)) END"

    def level(name: str, keys: str) -> str:
        ks = keys + "," if keys else ""
        part = f"PARTITION BY {ks} rule"
        return f"""{name} AS (
  SELECT {ks} rule, any_value(total) AS total, {low('min(CASE WHEN upto * 4 >= total THEN bucket END)')} AS lo, {low('min(CASE WHEN upto * 4 >= total * 3 THEN bucket END)')} AS hi
  FROM (SELECT {ks} rule, bucket, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total
        FROM (SELECT {ks} rule, bucket, sum(n) AS n FROM sketch GROUP BY {ks} rule, bucket))
  GROUP BY {ks} rule)"""

    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {r} AS x FROM counts" for k, r in ratio.items())
    slack = ", ".join(f"('{k}', {v[1]}, {'NULL' if v[2] is None else v[2]})" for k, v in RULES.items())
    ok = " AND ".join(f"{r} BETWEEN m.{k}_lo AND m.{k}_hi" for k, r in ratio.items())
    cols = ", ".join(f"max(CASE WHEN rule = '{k}' THEN lo END) AS {k}_lo, max(CASE WHEN rule = '{k}' THEN hi END) AS {k}_hi" for k in RULES)
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
wins AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM ws WHERE len(w) >= {WINDOW})),
hits AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1),
reps AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM hits GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT x.doc_id, x.lang, x.source, len(ws.w) AS n_words, coalesce(list_sum([length(y) FOR y IN ws.w]), 0)::BIGINT AS word_chars,
    length(x.t) - length(regexp_replace(x.t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words
  FROM texts x JOIN ws USING (r) LEFT JOIN lines l USING (r) LEFT JOIN reps USING (r)),
sketch AS (SELECT lang, source, rule, {b('x')} AS bucket, count(*) AS n FROM ({each}) GROUP BY ALL),
{level('own', 'lang, source')},
{level('mid', 'lang')},
{level('whole', '')},
slack(rule, above, below) AS (VALUES {slack}),
leaning AS (
  SELECT o.lang, o.source, rule, o.total, o.lo, o.hi,
    (m.total * m.lo + {PRIOR_ROWS} * w.lo) // (m.total + {PRIOR_ROWS}) AS mid_lo, (m.total * m.hi + {PRIOR_ROWS} * w.hi) // (m.total + {PRIOR_ROWS}) AS mid_hi
  FROM own o JOIN mid m USING (rule) JOIN whole w USING (rule) WHERE o.lang IS NOT DISTINCT FROM m.lang),
used AS (
  SELECT lang, source, rule, (total * lo + {PRIOR_ROWS} * mid_lo) // (total + {PRIOR_ROWS}) AS lo, (total * hi + {PRIOR_ROWS} * mid_hi) // (total + {PRIOR_ROWS}) AS hi FROM leaning),
cuts AS (SELECT lang, source, rule, CASE WHEN below IS NULL THEN -1 ELSE lo - {FENCE} * (hi - lo) - below END AS lo, hi + {FENCE} * (hi - lo) + above AS hi FROM used JOIN slack USING (rule)),
m AS (SELECT lang AS t_lang, source AS t_source, {cols} FROM cuts GROUP BY lang, source),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {ok.replace('m.', '')}) AS kept
FROM judged JOIN m ON lang IS NOT DISTINCT FROM t_lang AND source IS NOT DISTINCT FROM t_source
"""


SQL = _sql()
