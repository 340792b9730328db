"""Edge cases, brute-force and oracle comparisons of the llm operators."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from massflow import session
from massflow.llm import language, licenses, media, mixing, pieces, quality_model, quality_rules, simhash, token_counts, warc
from massflow.llm.queries import QUERIES, SQL
from massflow.operators import joins

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill. "
ROWS = [
    (1, LINE * 3, "en", "src0", 1), (2, LINE * 3, "en", "src0", 1), (2, LINE * 3, "en", "src0", 1), (3, None, "en", "src0", 0), (4, "", None, None, 0),
    (5, " \n\t ", "fr", "src1", 4), (None, "seul " * 30, "fr", "nowhere", 5), (None, None, None, None, None), (6, "é▁ﬁ　\x00 a  b\r\n" * 4, "fr", "src1", 9),
    (7, "x" * 3000, None, "src2", 3000), (8, "word " * 30000, "en", "src0", 5), (9, "12 34 --", "de", "src3", 8), (10, "one two", "de", "src3", 7), (11, "Licensed under the MIT License.\nelse", "en", "src9", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = spark.createDataFrame([(*r, 1, "k", True, 0.5) for r in ROWS], SCHEMA + ", n_words int, mix string, kept boolean, score double")
    return clash.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    against_sql(spark, name, SF)


def edf(blocks, weights):
    """Pfair by brute force, slot by slot: (source, block) of every slot.  Every
    source is less than one block from its share after every slot of a phase."""
    left, done, out = list(blocks), [0] * len(blocks), []
    while any(left):
        share = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        total, k, t, ended = sum(share), [0] * len(blocks), 0, False
        while not ended:
            open_ = [(-(-(k[s] + 1) * total // w), s) for s, w in enumerate(share) if w and k[s] * total // w <= t]
            due, s = min(open_)
            assert t < due
            out.append((s, done[s], len(out) - t + k[s] * total // share[s], len(out) - t + due))
            k[s], done[s], left[s], t, ended = k[s] + 1, done[s] + 1, left[s] - 1, t + 1, left[s] == 1
            for j, w in enumerate(share):
                assert abs(k[j] - w * t / total) < 1
    return out


def mixed(spark, rows_of, weights, other, block_rows):
    """(source, block, release, deadline) by slot, and the rows, of a made-up table."""
    names = [*weights, None]
    data = [(s * 100_000 + i, names[s]) for s, n in enumerate(rows_of) for i in range(n)]
    got = rows(mixing.mix(spark.createDataFrame(data, "doc_id long, source string").repartition(3), weights, other, block_rows, bucket_rows=50))
    assert len({r["doc_id"] for r in got}) == len({r["mix"]["position"] for r in got}) == len(data)
    assert all(r["mix"]["position"] // block_rows == r["mix"]["slot"] for r in got)
    by_slot = collections.defaultdict(set)
    for r in got:
        m = r["mix"]
        by_slot[m["slot"]].add((names.index(r["source"]), m["block"], m["release"], m["deadline"]))
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    return [next(iter(by_slot[t])) for t in range(len(by_slot))]


@pytest.mark.parametrize(
    ("rows_of", "weights", "other", "block_rows"),
    [
        ((2000, 1200, 800), {"a": 5, "b": 3}, 2, 10),  # rows in proportion to the weights
        ((30, 7, 963), {"a": 5, "b": 3}, 2, 2),  # and in none
        ((500,) * 8, {"a": 50, **{f"s{i}": 7 for i in range(6)}}, 17, 32),
        ((3000, *(170,) * 7), {"a": 50, **{f"s{i}": 7 for i in range(6)}}, 17, 32),
        ((40, 0, 0, 3), {"a": 1, "b": 9, "c": 4}, 6, 1),
        ((0, 0, 5), {"a": 5, "b": 3}, 2, 10),
    ],
)
def test_mixing_follows_the_weights(spark, rows_of, weights, other, block_rows):
    blocks = [-(-n // block_rows) for n in rows_of]
    assert mixed(spark, rows_of, weights, other, block_rows) == edf(blocks, [*weights.values(), other])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_of_the_tables_is_within_a_block_of_the_weights(spark, sf):
    got = rows(QUERIES["op1_source_mixing"](spark, f"/root/testdata/{sf}"))
    names, per = list(mixing.WEIGHTS), [*mixing.WEIGHTS.values(), mixing.OTHER]
    of = {n: i for i, n in enumerate(names)}
    have = collections.Counter(of.get(r["source"], len(names)) for r in got)
    want = edf([-(-have[s] // mixing.BLOCK_ROWS) for s in range(len(per))], per)
    assert {(r["slot"], of.get(r["source"], len(names)), r["block"], r["release"], r["deadline"]) for r in got} == {(t, *x) for t, x in enumerate(want)}
    first = [s for s, *_ in want[:40]]
    assert first.count(0) >= min(10, have[0] // mixing.BLOCK_ROWS)  # its share of 40 slots, 50 of 183, is 10.9


def test_mixing_edges(docs, empty):
    assert len(rows(mixing.mix(docs, {"src0": 3, "src1": 1}))) == len(ROWS)
    made = mixing.mixed_order(docs, {"src0": 3, "src1": 1}, 1, 2)
    assert made.columns == docs.columns and sorted(map(str, made.collect())) == sorted(map(str, docs.collect()))
    assert rows(mixing.mix(empty, {"a": 1})) == []


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(win)
    hit = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def test_quality_rules_edges(spark, docs, empty):
    got = rows(quality_rules.assess(docs))
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["word_chars"])
    want = [{"doc_id": r[0], **brute_counts(r[1])} for r in ROWS]
    assert sorted(map(key, got)) == sorted(map(key, want))
    by = {key(r): r for r in got}
    for w in want:
        assert {k: by[key(w)][k] for k in w} == w
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert rows(quality_rules.assess(empty)) == [] and rows(quality_rules.keep_good(empty)) == []
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def against_sql(spark, name, sf):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    cols = sorted(got)
    assert cols == sorted(want) and len(got) == len(want)
    text = lambda df: sorted(tuple("" if x is None or x != x else str(int(x) if isinstance(x, float) and x == int(x) else x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    assert text(got) == text(want)
    return got


def test_quality_rules_of_large_groups(spark, monkeypatch):
    """Groups of some rows to 3,000; verdicts that the base leaves to the bounds."""
    got = against_sql(spark, "op6_quality_rules", "/root/testdata/sf0.1")
    assert (~got.base_failed & ~got.kept).sum() > 100
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    again = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").toPandas()
    monkeypatch.undo()
    plain = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").toPandas()
    by = ["doc_id", "n_words", "word_chars"]
    assert again.sort_values(by).reset_index(drop=True).equals(plain.sort_values(by).reset_index(drop=True))


def test_bounds_by_brute_force(spark):
    """A large, a small and a null group of one language, and one of another."""
    ratio = {("en", "big"): [100 + i % 40 for i in range(700)], ("en", "few"): [900, 900, 950], ("en", None): [20] * 60, ("fr", "big"): [300 + i % 9 for i in range(90)]}
    data = [(*k, 100, 100 * v // 100, 0, 1, 0, 0) for k, vs in ratio.items() for v in vs]
    own = spark.createDataFrame(data, "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")

    def low(x):  # the least number of its bucket
        e = max(0, x.bit_length() - 6)
        return x >> e << e

    def quartiles(xs):
        xs = sorted(map(low, xs))
        return [xs[-(-len(xs) * q // 4) - 1] for q in (1, 3)]

    whole = quartiles([x for xs in ratio.values() for x in xs])
    lean = lambda n, q, far: [(n * a + quality_rules.PRIOR_ROWS * b) // (n + quality_rules.PRIOR_ROWS) for a, b in zip(q, far, strict=True)]
    got = {(r["lang"], r["source"]): r for r in rows(quality_rules.thresholds(quality_rules.sketches(own)))}
    assert set(got) == set(ratio)
    for (lang, source), xs in ratio.items():
        tongue = [x for k, v in ratio.items() if k[0] == lang for x in v]
        lo, hi = lean(len(xs), quartiles(xs), lean(len(tongue), quartiles(tongue), whole))
        r = got[lang, source]
        assert (r["word_length_lo"], r["word_length_hi"]) == (lo - quality_rules.FENCE * (hi - lo) - 200, hi + quality_rules.FENCE * (hi - lo) + 200)
        assert r["own_rows"] == len(xs)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_spread(spark, monkeypatch, how):
    data = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(3000)]
    left = spark.createDataFrame(data, "doc_id long, word string").selectExpr("doc_id", "struct(word) AS k").repartition(5)
    n = collections.Counter(w for _, w in data if w != "k5")
    right = spark.createDataFrame([(w, c, f"<{w}>") for w, c in n.items()], "word string, n long, v string").selectExpr("struct(word) AS k", "n", "v")
    want = sorted((i, f"<{w}>" if w in n else "") for i, w in data if how == "left" or w in n)
    for hot in (10, 10_000):
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        got = joins.join_spread(left, right, "k", "n", 3000, how)
        assert sorted((r["doc_id"], r["v"] or "") for r in got.collect()) == want


def test_temporary_tables(spark, tmp_path):
    df, path = session.written(spark.range(5), "probe")
    assert df.count() == 5 and path in session._made
    session.remove(spark, path)
    assert path not in session._made and not os.path.exists(path.removeprefix("file:"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n\t#\x0b", max_size=90), min_size=1, max_size=30))
def test_quality_counts_random(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", quality_rules.counts().alias("c"))
    for r in df.collect():
        want = brute_counts(texts[r["doc_id"]])
        assert {k: r["c"][k] for k in want} == want


def test_licenses(spark, docs, empty):
    got = rows(licenses.scan(docs))
    assert len(got) == len(ROWS) and [r["licenses"] for r in got if r["n_matches"]] == ["MIT"]
    long = licenses.TEMPLATES["MIT"][2]
    wrapped = "prose before\n\n" + re.sub(r"((?:\S+ ){9})", r"\1\n", long.replace("copies", "copy")) + "\n\nprose after"
    df = spark.createDataFrame([(1, wrapped), (2, LINE), (3, "license " * 500)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(licenses.scan(df))}
    assert found[1]["best_license"] == "MIT" and 0.8 <= found[1]["best_dice"] < 1 and found[2]["n_matches"] == found[3]["n_matches"] == 0
    assert rows(licenses.scan(empty)) == []
    share = licenses.THRESHOLD / (2 - licenses.THRESHOLD)
    words = set(licenses.anchors(licenses.TEMPLATES, licenses.THRESHOLD))
    for t in itertools.chain(*licenses.TEMPLATES.values()):
        grams = licenses.bigrams(t)
        assert sum(bool(words & set(g.split(" "))) for g in grams) > len(grams) * (1 - share)


def test_licenses_inside_lines_and_over_paragraphs(spark):
    mit, prose = licenses.TEMPLATES["MIT"][2], " ".join(f"river{i}" for i in range(130))
    cut = [mit.index("The above copyright"), mit.index("THE SOFTWARE IS")]
    mit3 = "\n\n".join((mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]))
    cases = {
        f"{prose}\n\n{mit3}\n\n{prose}": ("MIT", 1, 1.0),
        f"{prose} {mit.replace('copies', 'copy')} {prose}": ("MIT", 1, 0.9),
        "Copyright (c) 2021 Jane Doe. All rights reserved.": ("All-Rights-Reserved", 1, 1.0),
        "Licensed under the MIT License. See LICENSE in the project root.": ("MIT", 1, 1.0),
        f"{prose} It is licensed under CC BY 4.0. {prose} Licensed under the BSD 3-Clause License, too.": ("BSD-3-Clause,CC-BY-4.0", 2, 1.0),
        f"{prose} Licensed under the Apache License, Version 1.1, as {prose}": ("", 0, 0.0),
        f"{prose} Licensed under the GNU General Public License, version 2, as {prose}": ("", 0, 0.0),
        f"all {prose} rights {prose} reserved": ("", 0, 0.0),
        "All rights reserved.\nAll rights reserved by me and others": ("All-Rights-Reserved", 1, 1.0),
    }
    got = {r["doc_id"]: r for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")))}
    for i, (names, n, dice) in enumerate(cases.values()):
        assert (got[i]["licenses"], got[i]["n_matches"]) == (names, n) and dice <= got[i]["best_dice"] <= (dice if dice in (0, 1) else 1)


def brute_licences(text, templates, t=0.8):
    """(matches, best Dice of each name) by every segment and every window."""
    grams = lambda x: [f"{a} {b}" for a, b in itertools.pairwise(re.sub("[^a-z0-9]+", " ", x.lower()).strip().split(" "))]
    pairs = [(name, set(grams(x))) for name, xs in templates.items() for x in xs]
    found = []
    for seg in {text, *text.split("\n"), *re.split(r"\n[ \t\r]*\n", text)}:
        a = set(grams(seg))
        found += [(name, d) for name, b in pairs if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= t]
    shown, s, best = {n for n, _ in found}, grams(text), {}
    for name, b in pairs:
        at = [i for i, x in enumerate(s) if x in b]
        if name in shown or len(set(s) & b) / len(b) < t:
            continue
        for i in at:
            for j in at:
                x = set(s[i : j + 1])
                if j >= i and sum(y not in b for y in s[i : j + 1]) <= (2 / t - 2) * len(b):
                    d = 2 * len(x & b) / (max(len(x), len(b)) + len(b))
                    best[name] = max(best.get(name, 0), d)
    found += [(n, d) for n, d in best.items() if d >= t]
    return len(found), {n: max(d for m, d in found if m == n) for n, _ in found}


def test_licences_by_brute_force(spark):
    rng = np.random.default_rng(8)
    small = {k: tuple(x for x in v if len(x) < 200) for k, v in licenses.TEMPLATES.items()}
    small = {k: v for k, v in small.items() if v}
    texts, filler = [], "this work software river by license under the a of all rights 4 0 and version".split()
    for _ in range(300):
        out = []
        for _ in range(int(rng.integers(1, 4))):
            w = list(small.values())[rng.integers(len(small))]
            w = w[rng.integers(len(w))].split(" ")
            for _ in range(int(rng.integers(0, 3))):
                w.insert(int(rng.integers(len(w) + 1)), filler[rng.integers(len(filler))])
            if rng.random() < 0.3:
                w.pop(int(rng.integers(len(w))))
            out += [*(filler[rng.integers(len(filler))] for _ in range(int(rng.integers(0, 9)))), *w]
        for _ in range(int(rng.integers(0, 4))):
            out.insert(int(rng.integers(len(out) + 1)), ("\n", "\n\n", "\n# ", "* ")[rng.integers(4)])
        texts.append(" ".join(out))
    got = {r["doc_id"]: r for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small))}
    windows = 0
    for i, text in enumerate(texts):
        n, names = brute_licences(text, small)
        r = got[i]
        assert (r["n_matches"], r["licenses"]) == (n, ",".join(sorted(names))), text
        if n:
            assert r["best_dice"] == pytest.approx(max(names.values()), abs=1e-6)
        windows += n > 0
    assert windows > 100


def test_licence_recall(spark, tmp_path):
    """Every template as people paste it: wrapped, commented, indented, inside prose
    and with a word changed; Spark and SQL find it."""
    forms, want = [], []
    prose = " ".join(f"stone{i}" for i in range(60))
    for name, ts in licenses.TEMPLATES.items():
        for text in ts:
            words = text.split(" ")
            lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
            swapped = " ".join("thing" if len(words) > 30 and i == 9 else w for i, w in enumerate(words))
            for form in (text, "\n".join(lines), "\n".join(f"# {x}" for x in lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */", f"{prose} {text} {prose}", f"{prose}\n\n" + "\n".join(f"    {x}" for x in lines) + f"\n\n{prose}", f"{prose}\n{swapped.upper()} {prose}"):
                forms.append((len(forms), form))
                want.append(name)
    spark.createDataFrame(forms, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(licenses.query(spark, str(tmp_path)))}
    assert all(name in got[i]["licenses"].split(",") for i, name in enumerate(want))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_matches, licenses, best_license, best_dice FROM ({SQL['op5_license_scans']})").fetchall()}
    assert sql == {i: (r["n_matches"], r["licenses"], r["best_license"], r["best_dice"]) for i, r in got.items()}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    n = len(prints)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_simhash_fingerprints_and_edges(docs, empty):
    got = rows(simhash.near_duplicates(docs))
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{brute_fingerprint(r[1]):016x}" for r in ROWS)
    zero = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert rows(simhash.near_duplicates(empty)) == []
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in got if r["component_id"] is not None}) + sum(r["component_id"] is None for r in got)


def test_dedup_of_rows_that_differ_elsewhere(spark):
    data = [(7, LINE * 4, "en", f"src{i % 5}", i % 40) for i in range(400)] + [(None, LINE * 4, "en", "a", 1), (3, "other words here", None, "a", 1)]
    kept = set()
    for n in (1, 6):
        df = spark.createDataFrame(data[::-1] if n == 1 else data, SCHEMA).withColumn("m", F.create_map(F.lit("k"), "doc_id")).repartition(n)
        out = simhash.dedup(df)
        assert out.columns == df.columns
        kept.add(tuple(sorted(str(r) for r in out.drop("m").collect())))
    assert len(kept) == 1 and [x[11:12] for x in kept.pop()] == ["3", "7"]


def test_hot_fingerprints_are_spread(spark, monkeypatch):
    texts = ["", LINE, LINE + "end", "one two three"]
    df = spark.createDataFrame([(i, texts[0] if i < 900 else texts[i % 4]) for i in range(1500)], "doc_id long, text string").repartition(4)
    plain = sorted(map(str, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    assert sorted(map(str, simhash.near_duplicates(df).collect())) == plain


@pytest.mark.parametrize("tree_max", [2048, 8, 3])
def test_bk_shards_find_every_component(spark, tree_max):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = set(base)
    for b in base[:6]:  # chains and dense clusters
        for _ in range(40):
            b ^= 1 << int(rng.integers(64))
            prints.add(b)
    dense = base[7]
    prints |= {dense ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    root = {r["fp"] % 2**64: r["root"] for r in simhash.components(df, tree_max=tree_max).collect()}
    want = brute_components(prints)
    pairs = {(w, root[p]) for w, p in zip(want, prints, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_connect_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1010).selectExpr("id AS a", "1000L AS b"))
    got = collections.defaultdict(set)
    for r in simhash.connect(edges).collect():
        got[r["root"]].add(r["v"])
    assert sorted(map(len, got.values())) == [10, 301]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab the\n▁ é　ﬁ\t\r<s>½漢🙂\x00"), max_size=60))
def test_token_counts_equal_the_library(text):
    m = token_counts.load(token_counts.default_model())
    assert token_counts.Counts(token_counts.default_model()).totals([text]) == [len(m.encode(text))]


def test_token_counts_edges(docs, empty):
    m = token_counts.load(token_counts.default_model())
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.count_tokens(docs)))
    assert got == sorted((len((r[1] or "").encode()), n := len(m.encode(r[1] or "")), n > 4096) for r in ROWS)
    assert rows(token_counts.count_tokens(empty)) == []


def lattice(p, text):
    """All paths of a short marked text with their weights."""
    def go(i):
        if i == len(text):
            return [((), 1.0)]
        out = []
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in p.ids:
                out += [((p.ids[text[i:j]], *a), w * p.weight[p.ids[text[i:j]]]) for a, w in go(j)]
        return out

    return go(0)


@pytest.mark.parametrize("long", [48, 0])
def test_sampling_follows_the_lattice(monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    p = pieces.pieces_of(token_counts.default_model(), 1.0)
    n = 20000 if long else 3000
    got = pieces.sample(p, [b"hello"] * n, pieces.row_keys(list(range(n)), 1))
    freq = collections.Counter(tuple(x.tolist()) for x in got)
    paths = lattice(p, b"\xffhello")
    total = sum(w for _, w in paths)
    assert set(freq) <= {a for a, _ in paths}
    for path, w in paths:
        share = w / total
        assert abs(freq[path] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def test_long_pre_tokens_take_the_same_pieces(spark, monkeypatch):
    """Both arithmetics on the same texts: LONG is no switch of results."""
    p = pieces.pieces_of(token_counts.default_model(), 1.0)
    texts = [r[0].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect() if r[0]] + ["é漢🙂abc" * 5, "x" * 48, "internationalisation" * 4]
    texts = [t if isinstance(t, bytes) else t.encode() for t in texts]
    keys = pieces.row_keys(list(range(len(texts))), 3)
    plain = [x.tolist() for x in pieces.sample(p, texts, keys)]
    for long in (0, 7, 200):
        monkeypatch.setattr(pieces, "LONG", long)
        assert [x.tolist() for x in pieces.sample(p, texts, keys)] == plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text("ab the\n▁ é", max_size=200)), max_size=6), st.integers(0, 5))
def test_sampled_ids_decode_losslessly(texts, seed):
    p = pieces.pieces_of(token_counts.default_model(), 1.0)
    raw = [None if t is None else t.encode() for t in texts]
    keys = pieces.row_keys(list(range(len(texts))), seed)
    got = pieces.sample(p, raw, keys)
    for t, ids in zip(raw, got, strict=True):
        assert (ids is None) == (t is None)
        if t is not None:
            assert b"".join(p.text[i] for i in ids).replace(b"\xff", b" ")[1:] == t
    for i in range(len(texts)):  # a row's segmentation depends on the row alone
        alone = pieces.sample(p, [raw[i]], keys[i : i + 1])[0]
        assert (alone is None and got[i] is None) or alone.tolist() == got[i].tolist()


def test_pieces_edges(docs, empty):
    got = rows(pieces.round_trip(docs))
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)
    again = rows(pieces.round_trip(docs.repartition(5)))
    key = lambda r: (str(r["doc_id"]), r["n_bytes"], r["ids_hash"] or 0)
    assert sorted(map(key, got)) == sorted(map(key, again))
    m = token_counts.load(token_counts.default_model())
    for r in rows(pieces.encode(docs, ["doc_id", "text"])):
        if r["ids"] and "▁" not in r["text"]:
            assert m.decode(r["ids"]) == r["text"]
    assert rows(pieces.round_trip(empty)) == []


def test_language(spark, docs, empty):
    got = rows(language.predict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    edge = rows(language.predict(docs))
    assert len(edge) == len(ROWS)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in edge if r["doc_id"] in (3, 4, 5, 9))
    assert rows(language.predict(empty)) == []
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (3, 4, 5, 9)").count() == 0


def test_language_decoding_by_brute_force():
    rng = np.random.default_rng(3)
    for k in (2, 4, 7):
        code = language.codewords(k)
        bits = code.shape[1]
        model = language.Model([str(i) for i in range(k)], code, rng.normal(size=(6, bits)), rng.normal(size=bits), rng.random(bits) + 0.1)
        x = rng.normal(size=(40, 6))
        best, score, margin = model.decode(x)
        for i, row in enumerate(x):
            loss = []
            for word in code:
                total = 0.0
                for b in range(bits):
                    f = sum(row[j] * model.coef[j, b] for j in range(6)) + model.bias[b]
                    total += model.weight[b] * math.log1p(math.exp(-f * word[b]))
                loss.append(total)
            low, second = sorted(loss)[:2]
            assert loss[best[i]] == pytest.approx(low) and margin[i] == pytest.approx(second - low)
            assert score[i] == pytest.approx(math.exp(-low) / sum(math.exp(-v) for v in loss))


def test_language_vectors_by_brute_force(monkeypatch):
    for span in (language.SPAN, 7):
        monkeypatch.setattr(language, "SPAN", span)
        for text in (b"", b"a", b"Ab 9z\xc3\xa9 the end" * 5):
            raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalpha() else 32 for c in text) + b" "
            want = np.zeros(language.DIM)
            for i in range(len(raw) - 2):
                want[((raw[i] * 2654435761 + raw[i + 1] * 2246822519 + raw[i + 2] * 3266489917) % 2**32) >> 20] += 1
            assert np.allclose(language.vector(text), np.sqrt(want / max(1, len(raw) - 2)))


def test_every_language_is_learned(spark):
    """90 languages, one of them with most rows; fewer rows are learned of each."""
    names = [f"l{i:02d}" for i in range(90)]
    text = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i * 7 % 26)} " * 12
    data = [(i, text(i % 90), names[i % 90]) for i in range(90 * 8)] + [(i, text(0), names[0]) for i in range(1000, 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = language.train(df, 40, 90 * 5)
    assert model.languages == names
    truth = {r[0]: r[2] for r in data}
    got = rows(language.identify(df, model, ["doc_id"]))
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) > 0.9 * len(got)


def test_language_sample_is_by_least_hash(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', IF(id % 50 = 1, 'b', 'c')) AS lang", "shiftrightunsigned(xxhash64(id), 1) AS h")
    all_ = collections.defaultdict(list)
    for r in rows(df):
        all_[r["lang"]].append(r["h"])
    for each in (1, 20, 400):
        for b in rows(language.sample_bounds(df, each)):
            level = {h: lv for h, lv in df.select("h", language.level(F.col("h"))).collect()}
            inside = sorted(h for h in all_[b["pick_lang"]] if level[h] <= b["most"])
            assert inside == sorted(all_[b["pick_lang"]])[: len(inside)] and len(inside) >= min(each, len(all_[b["pick_lang"]]))
            assert len(inside) <= 1.3 * each + 8


@pytest.mark.parametrize("k", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(k):
    code = language.codewords(k)
    far = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
    assert code.shape[0] == k and far >= {2: 1, 3: 2, 4: 4, 5: 8}.get(k, 5)


def test_quality_model(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = rows(quality_model.score(d, labels))
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 1000 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    own = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (8, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    edge = rows(quality_model.score(docs, own))
    assert len(edge) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in edge)
    assert rows(quality_model.score(empty, own)) == [] and len(rows(quality_model.score(docs, own.limit(0)))) == len(ROWS)


def brute_statistics(text):
    """The statistics of STATS by plain counting."""
    raw = text or b""
    if not raw:
        return dict.fromkeys(quality_model.STATS, 0.0)
    n = len(raw)
    share = lambda ok: sum(map(ok, raw)) / n
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    return {
        "log_bytes": math.log(1 + n), "words": len(words), "word_bytes": sum(map(len, words)) / max(1, len(words)), "distinct_words": len(set(words)) / max(1, len(words)),
        "lines": len(lines), "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "words_per_line": len(words) / max(1, len(lines)),
        "symbols": share(lambda c: chr(c) in "#*$%&|<>"), "digits": share(lambda c: 48 <= c <= 57), "upper": share(lambda c: 65 <= c <= 90), "punctuation": share(lambda c: chr(c) in ".,;:!?'\"()-"),
        "non_ascii": share(lambda c: c > 127), "controls": share(lambda c: c < 32 and c not in (9, 10)), "entropy": -sum(raw.count(c) / n * math.log2(raw.count(c) / n) for c in set(raw)),
        "top_word": max(map(words.count, words), default=0) / max(1, len(words)),
    }


def test_statistics_by_brute_force():
    for text in (None, b"", b" \n\t", "Áé 12, the the\nthe the\n\nEND* <x>\x01\r\n".encode() * 3, b"x" * 999):
        # a text of blank lines only has no lines: its share of repeated ones is 0 here
        want, got = brute_statistics(text), dict(zip(quality_model.STATS, quality_model.statistics(text), strict=True))
        if not want["lines"]:
            want["dup_lines"], got["dup_lines"] = 0, 0
        assert got == pytest.approx(want)


def test_lasso_is_at_its_optimum():
    """Conditions of the optimum of the penalised loss, at the fitted weights."""
    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality_model.STATS)))
    y = (rng.random(500) < 1 / (1 + np.exp(-6 * (x[:, 3] - 0.5)))).astype(float)
    model = quality_model.fit(x, y)
    assert model.rules
    error = model.score(x) - y
    assert abs(error.mean()) < 1e-3
    for rule, w in zip(model.rules, model.weights, strict=True):
        r = quality_model.holds(rule, x).astype(float)
        slope = ((r - r.mean()) / max(r.std(), 0.02) * error).mean()
        assert slope == pytest.approx(-math.copysign(quality_model.LASSO, w), abs=3e-4)


def test_training_rows_of_equal_ids(spark):
    """Rows of one id with different texts give one model, however they are dealt."""
    data = [(i % 150, f"{'clean words here' if i % 2 else '### $$$ 123'} {i % 7}", "en" if i % 3 else "fr") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(150)], "doc_id long, quality int")
    got = set()
    for n in (1, 7):
        df = spark.createDataFrame(data if n == 1 else data[::-1], "doc_id long, text string, lang string").repartition(n)
        model = quality_model.train(df, labels)
        tongue = language.train(df)
        got.add((str(model), tuple(tongue.languages), tongue.coef.tobytes()))
    assert len(got) == 1


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality_model.STATS)))
    y = ((x[:, 7] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    model = quality_model.fit(x, y)
    assert model.rules and ((model.score(x) > 0.5) == y).mean() > 0.9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality_model.STATS))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x))


def filtered(samples, kinds):
    """A PNG with given row filters, by the definition of each filter."""
    rows_, width, bpp = samples.shape
    flat = samples.reshape(rows_, -1).astype(int)
    out = bytearray()
    for r in range(rows_):
        out.append(kinds[r])
        for i in range(width * bpp):
            a = flat[r, i - bpp] if i >= bpp else 0
            b = flat[r - 1, i] if r else 0
            c = flat[r - 1, i - bpp] if r and i >= bpp else 0
            pred = a + b - c
            paeth = min(((abs(pred - v), k, v) for k, v in enumerate((a, b, c))))[2]
            out.append((flat[r, i] - [0, a, b, (a + b) // 2, paeth][kinds[r]]) % 256)
    head = np.array([width, rows_], ">u4").tobytes() + bytes([8, 2 if bpp == 3 else 0, 0, 0, 0])
    data = zlib.compress(bytes(out))
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x\0y") + media._chunk(b"IDAT", data[:20]) + media._chunk(b"IDAT", data[20:]) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("bpp", [1, 3])
def test_png_filters(bpp):
    s = np.random.default_rng(2).integers(0, 256, (12, 9, bpp)).astype(np.uint8)
    assert (media.read_png(filtered(s, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4, 2])) == s).all()


def test_png_faults():
    good = media.png(media.pad(b"hello " * 200))
    assert media.read_png(good).tobytes() == media.pad(b"hello " * 200)
    for bad in (good[1:], good[:-4], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"", good[:33] + good[-12:]):
        assert media.describe(bad)[-1]
    assert media.describe(None)[-1] == "no media"


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    for filters in ("choose", "none"):
        assert media.read_png(media.png(media.pad(data), filters)).tobytes() == media.pad(data)


def test_media_edges(docs, empty):
    got = rows(media.decode(media.encode(docs), ["doc_id", "n_bytes"]))
    want = collections.Counter()
    for r in ROWS:
        t = media.pad((r[1] or "").encode())
        assert len(t) and len(t) % 192 == 0
        want[(r[0], len((r[1] or "").encode()), len(t), hashlib.sha256(t).hexdigest(), zlib.crc32(t[-16:]))] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(re.fullmatch("[0-9a-f]{16}", r["feature"]) and r["error"] is None for r in got)
    assert rows(media.decode(media.encode(empty), ["doc_id"])) == []


def test_cosine_hash_by_brute_force():
    rng = np.random.default_rng(9)
    for height, width, bpp in ((1, 64, 3), (40, 64, 3), (33, 50, 1), (7, 5, 1)):
        s = rng.integers(0, 256, (height, width, bpp)).astype(np.uint8)
        grey = [[sum(map(int, s[y, x])) / bpp for x in range(width)] for y in range(height)]

        def squeeze(line):
            edge = [i * len(line) // 32 for i in range(33)]
            if len(line) < 32:
                return [line[e] for e in edge[:32]]
            return [sum(line[a:b]) / (b - a) for a, b in itertools.pairwise(edge)]

        cols = [squeeze(c) for c in zip(*grey, strict=True)]  # over the rows of each column
        small = [squeeze(r) for r in zip(*cols, strict=True)]
        term = lambda u, v, g=small: sum(g[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32))
        terms = [round(term(u, v), 6) + 0.0 for u in range(8) for v in range(8)]
        middle = sorted(terms[1:])[31]
        want = "".join("1" if t > middle else "0" for t in terms)
        assert media.cosine_hash(s) == f"{int(want, 2):016x}"


def test_warc_of_a_hot_url_and_a_hot_payload(spark, monkeypatch):
    """One URL and one payload with most captures, through the spread join too."""
    data = [(i, "http://hot.example/" if i % 3 else f"http://h{i}.example/", "<p>same</p>" * 20 if i % 4 else f"<p>{i}</p>" * 20) for i in range(3000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    plain = sorted(map(str, warc.archive_round_trip(df).collect()))
    first = min(i for i, _, h in data if h == data[1][2])
    want = [{"page_id": i, "payload_bytes": len(h), "payload_digest": hashlib.sha256(h.encode()).hexdigest(), "record_type": "revisit" if i % 4 and i != first else "response", "refers_to": first if i % 4 and i != first else None} for i, _, h in data]
    assert plain == sorted(str(Row(**w)) for w in want)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    assert sorted(map(str, warc.archive_round_trip(df).collect())) == plain


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>\r\n\r\n"
    data = [(i, f"http://h{i % 3}.example.com/p?{i % 7}#f", big) for i in range(1500)] + [(9000, None, None), (None, "::bad", "é" * 60), (9001, "http://[x", "é" * 60), (9002, "http://a.b/", "short"), (9003, "http://a.b/", "short"), (9002, "http://a.b/", "short"), (9004, "https://a.b:8443/ü x", "\0" * 150)]
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, record_type int").repartition(4)
    captures = warc.write_archive(df)
    _, heads = warc.write_index(captures)
    found = warc.lookup(df.select("url"), heads)
    read = [r.asDict() for r in warc.read_records(found).collect()]
    assert len(read) == len(data)
    payload = {r["page_id"]: r["payload"] for r in read if r["payload"] is not None}
    for page, _, html in data:
        own = (html or "").encode()
        r = [x for x in read if x["page_id"] == page]
        assert all(x["digest"] == hashlib.sha256(own).hexdigest() and x["full_bytes"] == len(own) for x in r)
        for x in r:
            assert bytes(payload[page] if x["record_type"] == "response" else payload[x["refers_to"]]) == own
            assert x["record_type"] == ("response" if len(own) < 100 or page in (0, 9001, 9004) else "revisit")
    one = warc.lookup(spark.createDataFrame([("http://h1.example.com/p?1",), ("http://no.such/",)], "url string"), heads)
    assert one.count() == sum(i % 3 == 1 and i % 7 == 1 for i in range(1500))
    none = df.limit(0)
    assert warc.archive_round_trip(none).collect() == []


def test_pipeline_edges(spark, docs, empty):
    import corpus_pipeline

    for source in (docs, empty):  # docs has columns that clash with those of the stages
        now = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == source.columns
        assert all(r["lossless"] for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect())


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages but the trained one, by plain Python, on whole texts of a table."""
    import corpus_pipeline

    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    copies = src.filter("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)
    src.unionByName(copies).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op6_quality_rules']}) WHERE kept").fetchall()}
    kept = docs.filter(F.col("doc_id").isin(list(good)))
    tongue = {r["doc_id"] for r in rows(language.identify(kept, language.train(kept), ["doc_id"])) if r["lang_pred"] != "und" and not (r["ambiguous"] and r["score"] < 0.5)}
    ids = sorted(tongue)
    part = brute_components([brute_fingerprint(text[i]) for i in ids])
    least = {}
    for i, c in zip(ids, part, strict=True):
        least.setdefault(c, i)
    before = set(session._made)
    got = {r["doc_id"]: r for r in rows(corpus_pipeline.run(spark, str(tmp_path)))}
    assert len(set(session._made) - before) == 1  # the last stage's input
    assert sorted(got) == sorted(least.values()) and not any(i >= 100_000 for i in got if i - 100_000 in tongue)
    m = pieces.pieces_of(token_counts.default_model(), pieces.ALPHA)
    for i, r in got.items():
        own = pieces.sample(m, [text[i].encode()], pieces.row_keys([i], pieces.SEED))[0]
        assert r["lossless"] and r["n_pieces"] == len(own) and r["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()


def test_pipeline_rows_follow_the_mix(spark, tmp_path):
    import corpus_pipeline

    names = "CASE WHEN doc_id % 10 < 5 THEN 'src0' WHEN doc_id % 10 < 7 THEN 'src1' WHEN doc_id % 10 < 9 THEN 'pooled' END AS source"
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", names, "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(rows(corpus_pipeline.run(spark, str(tmp_path))), key=lambda r: r["mix_position"])
    assert len({r["mix_position"] for r in got}) == len(got) > 500
    weights = {"src0": mixing.WEIGHTS["src0"], "src1": mixing.WEIGHTS["src1"], "pooled": mixing.OTHER}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["mix_position"] // mixing.BLOCK_ROWS].append(r["source"] if r["source"] in weights else "pooled")
    assert sorted(slots) == list(range(len(slots))) and all(len(set(v)) == 1 for v in slots.values())
    docs = spark.createDataFrame([(r["doc_id"], r["source"]) for r in got], "doc_id long, source string")
    want = sorted((r["mix"]["position"], r["doc_id"]) for r in rows(mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER)))
    assert [(r["mix_position"], r["doc_id"]) for r in got] == want
