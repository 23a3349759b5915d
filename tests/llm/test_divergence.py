"""Source divergence against every kept term of every group written out, with exact integers."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plainly(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]  # text, lang, source
    found, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in found}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = sorted((s for g, s in found if g == lang), key=str.encode)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(found[lang, s]) for s in groups}
        q = shares(sum((found[lang, s] for s in groups), collections.Counter()))
        for s in groups:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])]
    return sorted(out)


def corpus(seed, n=260, sources=7):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{'aeiou'[k % 5]}{chr(98 + k % 20)}{'é语ß'[k % 3] if k % 4 == 0 else 'q'}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(120)]
    rows = []
    for k in range(n):
        source = int(rng.integers(0, sources)) if k % 3 else 0  # a third in one source
        words = [vocabulary[min(int(rng.zipf(1.4)) * (1 + source % 3), 119)] for _ in range(int(rng.integers(0, 60)))]
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + ("\x7f1[x]`" if k % 5 == 0 else "")
        rows.append((k, text, ("en", "de")[k % 2], f"s{source}"))
    rows += [(900, None, "en", "s0"), (901, "", "en", "empty"), (902, "12 34", None, None), (903, "solo " * 5, "xx", "one"), (904, "other", "xx", "two"), (905, "Z" * 5000, "en", "s1")]
    rows += [(None, "tie tie", "tt", f"t{k % 4}") for k in range(16)] + [(7, "alike words", "tt", None)] * 3
    return rows


@pytest.mark.parametrize("seed,block,unit", [(1, 64, 512), (2, 2, 7), (3, 3, 1000)])
def test_audit_against_plain_reading(spark, monkeypatch, seed, block, unit):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "p", "item", "unit")})
    audit = divergence.Audit(docs.repartition(5))
    want = plainly(rows)
    got = [("pair", *r) for r in audit.pairs(block, unit).collect()] + [("term", *r) for r in audit.top_terms().select("lang", "source", "item", "value", "rank").collect()]
    assert sorted((lang, source, part, item, value, rank) for part, lang, source, item, value, rank in got) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[:2] == ("xx", "one") and r[4] == 0 for r in want)


def test_fewer_and_more_terms_than_asked_for(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for least, top in ((1, 3), (40, 50)):
        got = sorted(tuple(r) for r in divergence.audit_sources(docs, least, top).collect())
        assert got == plainly(rows, least, top)


def test_slices_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string, lang string, source string")
    whole = sorted(map(tuple, divergence.audit_sources(docs).collect()))
    kept = common.slices
    monkeypatch.setattr(divergence, "slices", lambda batches, column="text", limit=0: kept(batches, column, 200))
    assert sorted(map(tuple, divergence.audit_sources(docs).collect())) == whole
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_bounds_hold_and_leave_terms_unseen(spark):
    """No term's value is over its bucket's bound; shares stay exact where longs would overflow."""
    audit = divergence.Audit(spark.createDataFrame(corpus(6), "doc_id long, text string, lang string, source string"), 2)
    rows = audit.terms.where("p > q").withColumn("bucket", divergence._bucket(F.col("n")))
    bounds = rows.groupBy("lang", "source", "bucket").agg(divergence._f(F.max("p"), F.min("q")).alias("bound"), F.max(divergence._f(F.col("p"), F.col("q"))).alias("best"))
    assert bounds.count() > 20 and bounds.where("best > bound").count() == 0
    big = spark.range(1).select(divergence._share(F.lit(10**14).cast("long"), F.lit(3 * 10**15).cast("long"), F.lit(10**6).cast("long")).alias("p")).first()["p"]
    assert big == 1 + 10**9 * (10**14 + 2) // (3 * 10**15 + 2 * 10**6)
