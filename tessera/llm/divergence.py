"""Source divergence audit: how far each source's use of words lies from the other sources of its language, and which terms do it.

Counting. Tasks count terms of slices of texts exactly (dictionary codes, no hashes); Spark adds them up to one row for
each language, source and term. A language keeps the terms of ``least_docs`` documents or more. A group's smoothed
share of a term is p, the language's is q, in parts of a milliard; f(p, q) = floor((p - q)^2 / (p + q)).

Terms by upper bounds. Terms of a group are put into buckets by their count. f grows with p and falls with q where
p > q, so f(greatest p, least q) of a bucket bounds all its terms. Buckets are evaluated best bound first, one more at
first, then twice as many each round; a group is done when the bounds of its unseen buckets are strictly below the k-th
value found.

Pairs by postings. The postings of a language's terms (source, count) are cut by term and by block of sources. A task
lays the postings of a unit side by side and adds up f over its terms for each pair of one block with another; what it
emits is one row a pair, not one a term and pair. Terms that neither source of a pair has add one closed figure.

Defined cases: null text, lang and source are ''; a group without terms and one of a language that keeps none take part,
the values of its pairs are 0; a language of one source has no pairs; equal values rank by item (UTF-8); repeated rows
count as often as they stand there; a very long text is a slice of its own, a term may be as long as its text; an empty
table gives no rows; other columns are not read. Sums are decimals of 38 digits or longs that cannot overflow below 10^18.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, default_partitions, discard, in_worker, materialize, ragged, slices, text_bytes

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Counts below this have a bucket of their own; above, buckets grow by an eighth.
EXACT_COUNTS = 64
#: Sources of a block, and terms that one unit of postings has, about.
BLOCK_SOURCES, UNIT_TERMS = 64, 512
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs of each slice; a row without a term (n 0) stands for each group, docs with it."""
    for batch in slices(batches):
        raw, offsets = text_bytes(batch.column("text"))
        n = batch.num_rows
        names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        keys = [(r["lang"], r["source"]) for r in names.to_pylist()]
        code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        group = np.fromiter((code[k] for k in keys), np.int64, n)
        inside = _TERM[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = inside[heads]
        start = np.flatnonzero(first)
        ink = _LOWER[raw[inside]]
        # terms stand one after another in ink
        at = np.append(np.concatenate([[0], np.cumsum(inside)])[start], len(ink)).astype(np.int64)
        kind = pa.string() if len(ink) < 1 << 31 else pa.large_string()
        width = np.int32 if kind == pa.string() else np.int64
        terms = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(at.astype(width)), pa.py_buffer(np.ascontiguousarray(ink))]).dictionary_encode()
        which, words = terms.indices.to_numpy().astype(np.int64), terms.dictionary.cast(pa.string())
        doc = np.searchsorted(offsets, start, side="right") - 1
        size = max(len(words), 1)
        in_doc, times = np.unique(doc * size + which, return_counts=True)
        cell, back = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
        total, docs = np.bincount(back, weights=times, minlength=len(cell)).astype(np.int64), np.bincount(back, minlength=len(cell))
        every = list(code)
        owner = np.concatenate([cell // size, np.arange(len(every))])
        lang, source = (pa.array([k[i] for k in every], pa.string()).take(pa.array(owner)) for i in (0, 1))
        none = pa.nulls(len(every), pa.string())
        term = pa.concat_arrays([words.take(pa.array(cell % size)), none])
        yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([total, np.zeros(len(every), np.int64)])), pa.array(np.concatenate([docs, np.bincount(group, minlength=len(every))]).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it); the rows with a null term have the groups and their documents."""
    none = F.lit("")
    keyed = docs.select(*(F.coalesce(F.col(c).cast("string"), none).alias(c) for c in ("lang", "source", "text")))
    parts = keyed.mapInArrow(in_worker(_count), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals so that no product overflows."""
    exact = lambda c: c.cast("decimal(19,0)")
    return F.expr("0L") + 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * exact(count + 2), exact(total + 2 * terms))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs; both are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bucket(count: Column) -> Column:
    return F.when(count < EXACT_COUNTS, count).otherwise(EXACT_COUNTS + F.floor(8 * F.log2(count / EXACT_COUNTS))).cast("long")


class Audit:
    """Counts of kept terms, written: terms (gid, term, n, q), groups (gid, lang, source, total, kept: number of kept terms), both by lang."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        counts = materialize(term_counts(docs), "term-counts")
        by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        kept = materialize(by_term.select("lang", "term", "lang_n"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        of_groups = counts.where("term is not null").join(kept, ["lang", "term"])
        totals = of_groups.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(broadcast_if_small(materialize(langs, "languages-of-terms")), "lang", "left")
        zero = F.lit(0).cast("long")
        # sources of a language are numbered, so that they can be cut into blocks
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = materialize(groups.select("lang", "source", number.alias("number"), *(F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total"))), "groups")
        small = broadcast_if_small(self.groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "number", "total", "kept", "lang_total"))
        joined = of_groups.join(small, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
        p, q = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        self.terms = materialize(joined.select("lang", "source", "number", "term", "n", p.alias("p"), q.alias("q")), "terms-of-groups")
        discard(counts, kept)

    def top_terms(self, k: int = TOP) -> DataFrame:
        """lang, source, item, value and rank of the k terms of each group that it has, with p > q, of greatest f(p, q)."""
        rows = self.terms.where("p > q").withColumn("bucket", _bucket(F.col("n")))
        bound = _f(F.max("p"), F.min("q"))
        best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
        buckets = materialize(rows.groupBy("lang", "source", "bucket").agg(bound.alias("bound")).withColumn("place", F.row_number().over(best_first)), "term-buckets")
        by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        valued = rows.select("lang", "source", "bucket", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
        take, best = buckets.where("place = 1"), None
        seen = 1
        while True:
            # what is new in this round, with the best of the rounds before
            new = valued.join(broadcast_if_small(take.select("lang", "source", "bucket")), ["lang", "source", "bucket"]).select("lang", "source", "item", "value")
            some = new if best is None else best.select("lang", "source", "item", "value").unionByName(new)
            best = materialize(some.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= k), "best-terms")
            kth = best.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            left = buckets.where(F.col("place") > seen).join(kth, ["lang", "source"], "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
            take = materialize(left.where(F.col("place") <= 3 * seen), "next-buckets")
            if take.isEmpty():
                return best
            seen *= 3

    def pairs(self, block: int = BLOCK_SOURCES, unit_terms: int = UNIT_TERMS) -> DataFrame:
        """lang, source, item (another source of the language), value (the sum of f over all kept terms) and rank."""
        blocks = self.groups.select("lang", F.floor(F.col("number") / block).cast("int").alias("block")).distinct()
        most = self.groups.agg(F.max("kept")).first()[0] or 0
        units = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-most // unit_terms)))).cast("int")
        other = blocks.select(F.col("lang").alias("_lang"), F.col("block").alias("_block"))
        placed = self.terms.select("lang", "number", F.floor(F.col("number") / block).cast("int").alias("block"), units.alias("unit"), F.xxhash64("term").alias("t"), "term", "p")
        met = placed.join(broadcast_if_small(other), F.col("lang") == F.col("_lang"))
        i, j = F.least("block", "_block").alias("i"), F.greatest("block", "_block").alias("j")
        posted = met.select("lang", "number", i, j, "unit", "term", "p")
        background = materialize(self.groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).select("lang", "number", "source", "kept", "p0"), "background")
        # each unit learns the share of a term that is not there from its own rows: sent along with the postings
        alike = background.select("lang", "number", F.floor(F.col("number") / block).cast("int").alias("block"), "p0").join(broadcast_if_small(other), F.col("lang") == F.col("_lang"))
        empty = alike.select("lang", "number", i, j, F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-most // unit_terms) - 1)))).alias("unit"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
        sums = posted.unionByName(empty).groupBy("lang", "i", "j", "unit").applyInArrow(_unit_sums(block), "lang string, a int, b int, value long, terms long")
        total = sums.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("terms").alias("terms"))
        known = broadcast_if_small(background)
        one, two = (known.select(F.col("lang").alias(f"l{x}"), F.col("number").alias(x), F.col("source").alias(f"s{x}"), F.col("kept").alias(f"k{x}"), F.col("p0").alias(f"p{x}")) for x in "ab")
        named = total.join(one, (F.col("lang") == F.col("la")) & (total["a"] == one["a"])).join(two, (F.col("lang") == F.col("lb")) & (total["b"] == two["b"]))
        rest = _f(F.col("pa"), F.col("pb")).cast("decimal(19,0)") * (F.col("ka") - F.col("terms")).cast("decimal(18,0)")
        value = F.when(F.col("ka") > 0, F.col("value") + rest).otherwise(0).cast("long").alias("value")
        half = named.select("lang", "sa", "sb", value)
        both = half.select("lang", F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))).alias("x"), "value")
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return both.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(ranked))


def _unit_sums(block: int):
    """For each pair of sources of blocks i and j: the sum of f over the unit's terms, and the number of these."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, i, j, _ = (x.as_py() for x in key)
        number, p = table.column("number").to_numpy(), table.column("p").to_numpy()
        term = table.column("term").combine_chunks()
        none = term.is_null().to_numpy(zero_copy_only=False)
        numbers, code = np.unique(number, return_inverse=True)
        back = np.zeros(len(numbers), np.int64)
        back[code[none]] = p[none]
        coded = term.dictionary_encode()
        which = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(which, kind="stable")[int(none.sum()) :]
        terms, rows = len(coded.dictionary), which[order]
        mine, yours = np.flatnonzero(numbers // block == i), np.flatnonzero(numbers // block == j)
        value = np.zeros((len(mine), len(yours)), np.int64)
        chunk = 512
        for at in range(0, terms, chunk):
            lo, hi = np.searchsorted(rows, (at, at + chunk))
            shares = np.repeat(back[:, None], min(chunk, terms - at), axis=1)
            shares[code[order[lo:hi]], rows[lo:hi] - at] = p[order[lo:hi]]
            for k, a in enumerate(mine):
                d = shares[yours] - shares[a]
                value[k] += (d * d // (shares[yours] + shares[a])).sum(axis=1)
        a, b = np.repeat(numbers[mine], len(yours)), np.tile(numbers[yours], len(mine))
        once = a < b
        n = int(once.sum())
        return pa.table([pa.array([lang] * n, pa.string()), pa.array(a[once].astype(np.int32)), pa.array(b[once].astype(np.int32)), pa.array(value.ravel()[once]), pa.array(np.full(n, terms, np.int64))], ["lang", "a", "b", "value", "terms"])

    return run


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: every other source of the language, and the ``top`` terms."""
    audit = Audit(docs, least_docs)
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", audit.pairs()), ("term", audit.top_terms(top)))]
    return parts[0].unionByName(parts[1])
