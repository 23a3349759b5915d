"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams. Texts with one and the same set are one class; only its representative is compared.
Bands of MinHash values make buckets. In a bucket MinHash values are compared a few at a time: a pair is dropped as soon
as the posterior probability that its similarity reaches the threshold falls below the tolerance (uniform prior, so the
posterior is a Beta distribution), and only pairs still alive are compared further. First all members of a bucket are
held against its head; members that stay beside it are joined to it already, so only the others are compared with the
rest, in units of bounded size. What comes out are edges that hold components together, never all pairs.

Components of these edges are groups of texts that may well be similar, so chains of a few shared phrases build none.
They are cut into blocks of bounded size; each pair of blocks is one unit of work in one task, where MinHash values drop
pairs in the same way and pairs that stay are verified exactly. A unit gives each text's number of links and its local
root, so a group of n near copies moves O(n) rows between stages.

Defined cases: a text of fewer words than the n-gram is one n-gram, of all its words; a text without words (null too)
is linked to nothing and is its own class; a null doc_id has a null class and no links; rows that repeat a doc_id have
the class and links of their own texts, and stay or go together; a pair of exactly the threshold is linked; an empty table gives no rows; other columns
are not read, and keep_one_of_each keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hasher, binary_array, broadcast_if_small, default_partitions, distinct_by_doc, free_name, in_worker, materialize, mix, shingles, slices, text_bytes, words
from tessera.llm.components import connected_components

#: Bands of MinHash values and values in a band: at similarity 0.8 all bands miss a pair with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared before the posterior is looked at again.
STEP = 8
#: Texts of a block, and bytes of their n-gram sets.
BLOCK_TEXTS, BLOCK_BYTES = 768, 6 << 20
#: Members of a bucket that one unit compares with as many others.
BUCKET_TEXTS = 1024
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tail(successes: int, trials: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many equal values of so many: the upper tail of Beta(s + 1, t - s + 1)."""
    # for whole numbers the tail is a binomial sum: P(Bin(trials + 1, threshold) <= successes)
    n = trials + 1
    if threshold >= 1:
        return 1.0 if successes >= trials else 0.0
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(threshold) + (n - k) * np.log1p(-threshold) for k in range(successes + 1)]
    return float(np.exp(logs).sum())


def least_agreements(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared: the fewest equal ones with which a pair stays."""
    return {n: next(s for s in range(n + 1) if tail(s, n, threshold) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def _sets(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, their texts, and where each text's begin (n + 1 values)."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    start, end, doc = words(raw, offsets)
    value, owner = distinct_by_doc(*shingles(Hasher(raw)(start, end), doc, n, size))
    return value, owner, np.searchsorted(owner, np.arange(n + 1))


def _set_names(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit numbers that name each set: sums of two hashes of its n-grams."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(f, dtype=np.uint64)]) for f in (value, mix(value ^ np.uint64(0xABCDEF)))]
    return [x[at[1:]] - x[at[:-1]] for x in sums]


def _signature(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of each set, 32 bits each; empty sets have zeros."""
    n = len(at) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        for k in range(HASHES):
            x = value * _SEEDS[k]
            out[full, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, k1 and k2 (128 bits that name the set; null without words), n_grams and sig of every row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, owner, at = _sets(batch.column("text"), size)
            n = batch.num_rows
            count = np.diff(at)
            keys = [pa.array(x.view(np.int64), mask=count == 0) for x in _set_names(value, at)]
            sig = _signature(value, at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *keys, pa.array(count), binary_array(sig, np.arange(n + 1) * (4 * HASHES))], ["doc_id", "k1", "k2", "n_grams", "sig"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(in_worker(run), "doc_id long, k1 long, k2 long, n_grams long, sig binary")


def _alive(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Matrix of the pairs of two lists of MinHash values that no step of the posterior drops; after the first step only pairs still alive are compared."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for j in range(STEP):
        equal += a[:, None, j] == b[None, :, j]
    out = equal >= least[STEP]
    x, y = np.nonzero(out)
    n = equal[x, y]
    for k in range(STEP, HASHES, STEP):
        if not len(x):
            break
        for at in range(0, len(x), 1 << 18):
            part = slice(at, at + (1 << 18))
            n[part] += (a[x[part], k : k + STEP] == b[y[part], k : k + STEP]).sum(1, dtype=np.int16)
        stay = n >= least[k + STEP]
        x, y, n = x[stay], y[stay], n[stay]
    out[:] = False
    out[x, y] = True
    return out


def _links(a: dict, b: dict, threshold: float, least: dict[int, int]) -> np.ndarray:
    """Matrix of the pairs of two blocks whose similarity reaches the threshold."""
    alive = _alive(a["sig"], b["sig"], least)
    if not alive.any():
        return alive
    rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    both = np.zeros((len(rows), len(columns)), np.float32)
    va, vb = np.concatenate([a["grams"][i] for i in rows]), np.concatenate([b["grams"][j] for j in columns])
    oa, ob = (np.repeat(np.arange(len(x)), [len(s["grams"][i]) for i in x]) for s, x in ((a, rows), (b, columns)))
    common = np.intersect1d(va, vb)  # n-grams that only one side has are in no intersection
    width = max(256, (16 << 20) // (4 * max(len(rows), len(columns))))
    for lo in range(0, len(common), width):
        part = common[lo : lo + width]
        mats = []
        for v, o, n in ((va, oa, len(rows)), (vb, ob, len(columns))):
            place = np.searchsorted(part, v)
            hit = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == v)
            m = np.zeros((n, len(part)), np.float32)
            m[o[hit], place[hit]] = 1
            mats.append(m)
        both += mats[0] @ mats[1].T
    sa, sb = (np.array([len(s["grams"][i]) for i in x], np.float64) for s, x in ((a, rows), (b, columns)))
    total = sa[:, None] + sb[None, :] - both
    out = np.zeros_like(alive)
    out[np.ix_(rows, columns)] = both >= threshold * total - 1e-9
    return out & alive


def _local_roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each node's component in a symmetric matrix."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(link, label[None, :], big).min(1))
        if (new == label).all():
            return label
        label = new


def _unit(rows: list[tuple], within: bool, threshold: float, least: dict[int, int]) -> pa.RecordBatch:
    """Links of one unit: rows are (rep, side, weight, sig, grams); within a block side 0 against itself, else side 0 against side 1.

    Blocks come from a hash, so either side of a unit of two blocks may be empty; it has no links then.
    """
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    sides = [[r for r in rows if r[1] == k] for k in (0, 1)]
    blocks = [{"sig": np.frombuffer(b"".join(r[3] for r in s), np.uint32).reshape(len(s), HASHES), "grams": [np.frombuffer(r[4], np.uint64) for r in s]} for s in sides]
    ids, weight = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    n, m = len(sides[0]), len(sides[1])
    link = np.zeros((n + m, n + m), bool)
    if within:
        link[:] = _links(blocks[0], blocks[0], threshold, least)
        np.fill_diagonal(link, False)
    elif n and m:
        link[:n, n:] = _links(blocks[0], blocks[1], threshold, least)
        link[n:, :n] = link[:n, n:].T
    some = np.flatnonzero(link.any(1))
    root = _local_roots(link[np.ix_(some, some)], ids[some]) if len(some) else ids[:0]
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(link[some].sum(1).astype(np.int64)), pa.array((link[some] @ weight).astype(np.int64)), pa.array(root)], ["node", "n_texts", "n_rows", "root"])


def _candidate_edges(reps: DataFrame, least: dict[int, int]) -> DataFrame:
    """Edges (a, b) whose components hold together all pairs that share a band and that the posterior keeps."""
    spark = reps.sparkSession
    bands = reps.select("node", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {4 * ROWS} + 1, {4 * ROWS})))")).alias("band"))
    heads = materialize(bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    # the same head stands in many bands of one text: each pair of a member and a head is compared once
    members = materialize(bands.join(broadcast_if_small(heads.select("band", "head")), "band").where("node <> head"), "members")
    print_ = reps.select("node", "sig")
    of_head = print_.select(F.col("node").alias("head"), F.col("sig").alias("head_sig"))
    pairs = members.select("node", "head").distinct().join(print_, "node").join(of_head, "head")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, HASHES) for k in ("sig", "head_sig"))
            same = np.add.reduceat(x == y, np.arange(0, HASHES, STEP), axis=1, dtype=np.int64).cumsum(1)
            alive = (same >= np.array([least[k] for k in range(STEP, HASHES + 1, STEP)])).all(1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("head"), pa.array(alive)], ["node", "head", "alive"])

    judged = materialize(pairs.mapInArrow(in_worker(beside), "node long, head long, alive boolean"), "beside-heads")
    apart = judged.where("not alive").select("node", "head")
    # buckets with members that don't stay beside the head: these against all others, in units
    rest = materialize(members.join(broadcast_if_small(materialize(apart, "apart-from-heads")), ["node", "head"], "left_semi").select("node", "band"), "rest")
    sizes = rest.groupBy("band").agg(F.count("*").alias("n_rest")).join(heads, "band")
    blocks = lambda n: F.ceil(F.col(n) / BUCKET_TEXTS).cast("int")
    sizes = materialize(sizes.select("band", "head", blocks("n_rest").alias("across"), blocks("n").alias("down")), "open-buckets")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    few = broadcast_if_small(sizes)
    side0 = rest.join(few, "band").select("band", place("across", 11).alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), F.lit(0).alias("side"), "node")
    side1 = members.join(few.drop("head"), "band").select("band", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), place("down", 13).alias("j"), F.lit(1).alias("side"), "node")
    units = side0.unionByName(side1).join(print_, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_unit(batches, ("band", "i", "j"), ("side", "node", "sig"), "sig"):
            sides = [{r[1]: r[2] for r in rows if r[0] == k} for k in (0, 1)]
            if not all(sides):
                continue
            ids = [np.array(sorted(x), np.int64) for x in sides]
            sigs = [np.frombuffer(b"".join(x[k] for k in sorted(x)), np.uint32).reshape(len(x), HASHES) for x in sides]
            alive = _alive(*sigs, least) & (ids[0][:, None] != ids[1][None, :])
            # edges of a forest: each row to its least partner's root, each column to its least row
            root = _two_sided_roots(alive, *ids)
            a = np.concatenate([ids[0][alive.any(1)], ids[1][alive.any(0)]])
            b = np.concatenate([root[0][alive.any(1)], root[1][alive.any(0)]])
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    found = units.repartition(default_partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(in_worker(compare), "a long, b long")
    return judged.where("alive").select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(found)


def _two_sided_roots(alive: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each row's and each column's component in a matrix of links between two lists of ids."""
    big = np.iinfo(np.int64).max
    left, right = left.copy(), right.copy()
    while True:
        a = np.minimum(left, np.where(alive, right[None, :], big).min(1, initial=big))
        b = np.minimum(right, np.where(alive, a[:, None], big).min(0, initial=big))
        if (a == left).all() and (b == right).all():
            return left, right
        left, right = a, b


def _by_unit(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...], heavy: str) -> Iterator[list[tuple]]:
    """Rows of each unit of work; batches are sorted by keys, and a unit is bounded by its blocks."""
    now, held = None, []
    for batch in slices(batches, heavy):
        for row in zip(*(batch.column(k).to_pylist() for k in (*keys, *columns))):
            if row[: len(keys)] != now:
                if held:
                    yield held
                now, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if held:
        yield held


def jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (least doc_id of its connected group), n_links and n_text_links.

    n_links counts the other rows whose similarity reaches the threshold, copies among them; n_text_links counts the
    linked classes of equal n-gram sets, each once.
    """
    spark = docs.sparkSession
    least = least_agreements(threshold, tolerance)
    sigs = materialize(signatures(docs, size), "signatures")
    full = sigs.where("k1 is not null")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n_grams").alias("n_grams"), F.first("sig").alias("sig"))
    reps = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "representatives")
    groups = connected_components(_candidate_edges(reps, least))
    placed = materialize(groups.join(reps, "node"), "members-of-components")
    sizes = placed.groupBy("label").agg(F.count("*").alias("_n"), F.sum("n_grams").alias("_g"))
    sizes = sizes.select("label", F.greatest(F.ceil(F.col("_n") / BLOCK_TEXTS), F.ceil(F.col("_g") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = placed.join(broadcast_if_small(materialize(sizes, "components")), "label").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    # n-gram sets of the members alone, from their whole texts; a doc_id may stand for several texts: the set's own number tells them apart
    wanted = broadcast_if_small(placed.select(F.col("rep").alias("_rep")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, F.col("rep") == F.col("_rep"), "left_semi").join(members, "rep")
    names = ["node", "label", "blocks", "block", "weight", "sig"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, _, at = _sets(batch.column("text"), size)
            same = np.ones(batch.num_rows, bool)
            for key, own in zip(("k1", "k2"), _set_names(value, at)):
                same &= batch.column(key).to_numpy() == own.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), binary_array(value, at * 8)], [*names, "grams"]).filter(pa.array(same))

    sets = texts.mapInArrow(in_worker(grams), "node long, label long, blocks int, block int, weight long, sig binary, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_j")
    units = sets.select("node", "label", "block", "weight", "sig", "grams", other).select("label", F.least("block", "_j").alias("i"), F.greatest("block", "_j").alias("j"), (F.col("block") > F.col("_j")).cast("int").alias("side"), "node", "weight", "sig", "grams")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_unit(batches, ("label", "i", "j"), ("i", "j", "side", "node", "weight", "sig", "grams"), "grams"):
            held = {r[3]: (r[3], r[2], *r[4:]) for r in rows}
            if len(held) > 1:
                yield _unit(list(held.values()), rows[0][0] == rows[0][1], threshold, least)

    found = units.repartition(default_partitions(spark), "label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(in_worker(link), "node long, n_texts long, n_rows long, root long")
    found = materialize(found, "links")
    counts = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_rows").alias("n_rows"))
    joined = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    least_id = joined.join(reps.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    by_set = reps.select("k1", "k2", "node", "rep", "weight").join(counts, "node", "left").join(joined, "node", "left").join(least_id, "label", "left")
    by_set = by_set.select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"), (F.col("weight") - 1 + F.coalesce("n_rows", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links"))
    listed = sigs.select("doc_id", "k1", "k2")
    linked = listed.where("k1 is not null").join(by_set, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "n_text_links")
    zero = F.lit(0).cast("long")
    alone = listed.where("k1 is null").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"))
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"))
    return linked.unionByName(alone).unionByName(nameless)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group, and those without a doc_id; the columns of docs."""
    name = free_name(docs, "later")
    later = materialize(jaccard_join(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct(), "later-near-copies")
    return docs.join(broadcast_if_small(later), docs["doc_id"] == F.col(name), "left_anti")
