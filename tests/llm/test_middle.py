"""Fill-in-middle: the DFA against a plain reading of the text, odd rows, and the round trip."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, fill_in_middle as fim


def plainly(doc_id, text, seed=7, rate=100, spm=50):
    """The contract said in Python over strings."""
    text = text or ""
    units, rest = [], text
    while rest:
        cut = rest.find("\n") + 1 or len(rest)
        units, rest = [*units, rest[:cut]], rest[cut:]
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}", text
    return doc_id, len(units), "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}", text


def odd_texts():
    dice = random.Random(5)
    pieces = ["<", "P", "S", "M", ">", "<P", "<S", "\n", "\n\n", "é", "语", "😀", " a", "b ", "\r", "\x00", "<<", "word", " "]
    texts = ["".join(dice.choice(pieces) for _ in range(dice.randint(0, 40))) for _ in range(400)]
    texts += [x.replace("<P>", "").replace("<S>", "").replace("<M>", "") for x in texts]
    return texts + [None, "", "\n", "a", "<P>", "x<S>y\n", "<<M>", "<P<S", "<P\n>", "line\n" * 50_000, "😀" * 70_000 + "\n" + "é<" * 999]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_cuts_against_plain_reading(spark, rate, spm):
    rows = [(k % 397 if k % 11 else None, x) for k, x in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("n", F.lit(2))
    got = fim.restore_middle(fim.fill_in_middle(docs.repartition(3), 7, rate, spm)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plainly(k, x, 7, rate, spm)) for k, x in rows)


def test_lanes_agree_with_one_scan():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("<>PSM\na") + ["é", "语", "😀"], 4000)).encode()
    kinds = np.concatenate([fim.CLASS[np.frombuffer(text, np.uint8)], [fim.STOP], rng.integers(0, 12, 3000).astype(np.uint8)])[: len(text) + 1]
    state, one = 0, []
    for k in kinds:
        one.append(fim.EMIT[state, k])
        state = fim.NEXT[state, k]
    for lanes in (1, 2, 7, 100, 4096):
        assert (fim.scan(kinds, lanes) == one).all()
    assert len(fim.scan(kinds[:0])) == 0


def test_texts_over_a_slice_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    whole = sorted(map(repr, fim.middle_digests(docs).collect()))
    kept = common.slices
    monkeypatch.setattr(fim, "slices", lambda batches, column="text", limit=0: kept(batches, column, 300))
    assert sorted(map(repr, fim.middle_digests(docs).collect())) == whole
    assert fim.middle_digests(docs.limit(0)).count() == 0


def test_spoilt_outputs_restore_to_null(spark):
    rows = [("psm", "<P>a<S>c<M>b", "abc"), ("spm", "<S>c<P>a<M>b", "abc"), ("psm", "<S>c<P>a<M>b", None), ("psm", "x<P>a<S>c<M>b", None), ("spm", "<S><P>", None), ("plain", "<P>", "<P>"), ("psm", "<P><S><M>", ""), ("psm", None, None), ("plain", None, "")]
    made = spark.createDataFrame([(f, o) for f, o, _ in rows], "form string, output string")
    assert [r["restored"] for r in fim.restore_middle(made.coalesce(1)).collect()] == [w for *_, w in rows]
