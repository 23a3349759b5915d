"""Source mixing: targets by plain resharing, samples by a greedy walk over the keys, odd rows."""

import collections
import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing


def targets(sizes, turns=(1, 2, 3), most=3):
    """Reshares by weight, exactly, until no source is above most times its size. sizes by source, in order."""
    left, full = Fraction(sum(sizes)), set()
    weight = [turns[k % len(turns)] for k in range(len(sizes))]
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        level = (left - sum(most * sizes[k] for k in full)) / sum(weight[k] for k in open_) if open_ else 0
        above = {k for k in open_ if level * weight[k] > most * sizes[k]}
        if not above:
            return [most * sizes[k] if k in full else level * weight[k] for k in range(len(sizes))]
        full |= above


def plainly(rows):
    """Rows (doc_id, source, text): Counter of (doc_id, source, size, taken)."""
    def weight(text):
        words = text.split()
        ink = sum(map(len, words))
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        lines = [x for x in text.split("\n") if x.split()]
        return max((ink - symbols) / max(ink, 1) * (len(set(lines)) / max(len(lines), 1)), 0.05)

    by = collections.defaultdict(list)
    for doc_id, source, text in rows:
        text = text or ""
        digest = hashlib.md5(text.encode()).hexdigest()
        u = (int(hashlib.md5(f"{'null' if doc_id is None else doc_id}/{digest}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by[source].append((-math.log(u) / weight(text), -1 if doc_id is None else doc_id, digest, len(text.split()), doc_id))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r[3] for r in by[s]) for s in names]
    out = collections.Counter()
    for s, size, target in zip(names, sizes, targets(sizes)):
        epochs = min(int(target // size), 3) if size else 0
        room = math.floor(target - epochs * size)
        for *_, words, doc_id in sorted(by[s]):
            fits = 0 < words <= room
            room -= words * fits
            out[doc_id, s, words, (epochs + fits) * words] += 1
    return out


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{x}" + "#" * int(rng.random() < 0.2) for x in rng.integers(0, 50, int(rng.integers(0, 60)))]
        text = "\n".join(" ".join(words[j : j + 7]) for j in range(0, len(words), 7))
        rows.append((k, f"s{int(rng.integers(0, 9))}" if k % 3 else "hot", text))
    rows += [(1000, "big", " ".join(["x"] * 3000)), (1001, None, "a b c"), (None, None, "d e"), (None, "s1", None), (1002, "void", ""), (1003, "void", None), (1004, "é", "x y z"), (1005, "Z", "* * *")]
    return rows + [(7, "twins", "the same words here")] * 40 + [(7, "twins", "other words")] * 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_against_a_greedy_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(common, "COPIES", 16)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("size", "sid", "pos", "copy", "key", "weight")})
    got = mixing.mix_sources(docs.repartition(6)).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == plainly(rows)
    taken, facts = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        facts[r["source"]] = (r["target"], r["source_size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(0 <= facts[s][0] - taken[s] < 60 or s == "big" for s in facts)
    assert sum(t for t, _ in facts.values()) == pytest.approx(sum(z for _, z in facts.values()))


def test_targets_reshare_until_none_is_above(spark):
    for sizes in ([5, 1000, 10, 400], [1, 1, 1, 10**6], [0, 0], [7], [10, 0, 10, 0, 1000, 3, 2, 5000]):
        names = [chr(97 + k) for k in range(len(sizes))]
        table = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table.repartition(3)).collect()}
        assert [got[x] for x in names] == pytest.approx([float(x) for x in targets(sizes)])


def test_many_rows_alike_and_many_partitions(spark, monkeypatch):
    """One row a third of all times; the budget ends inside its copies; partitions change nothing."""
    monkeypatch.setattr(common, "COPIES", 16)
    rows = [(1, "a", "one two three")] * 300 + [(k, "b", "w " * (k % 30)) for k in range(2, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = plainly(rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = mixing.mix_sources(docs.repartition(n)).collect()
        assert collections.Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == want
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_better_documents_are_drawn_more_often(spark):
    """Of like documents in the sampled part, those of weight 0.5 are drawn about as often as the law says."""
    good, poor = "alpha beta", "alpha###"  # weights 1 and 5/8
    rows = [(k, "a", f"{good if k % 2 else poor} {'x' if k % 2 else 'xy'}") for k in range(4000)] + [(5000, "b", "w " * 4200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("source = 'a' and epochs = 0")
    share = {r["weight"]: (r["chosen"], r["n"]) for r in got.groupBy("weight").agg(F.sum((F.col("taken") > 0).cast("long")).alias("chosen"), F.count("*").alias("n")).collect()}
    low, high = share[min(share)], share[max(share)]
    # the sample ends at one key for both: shares 1 - exp(-w * key)
    ratio = math.log(1 - low[0] / low[1]) / math.log(1 - high[0] / high[1])
    assert ratio == pytest.approx(min(share) / max(share), rel=0.15)
