"""Suffix-array dedup: bytes under a string of ``length`` bytes that also starts elsewhere, by distributed prefix doubling.

A suffix array of every byte would move the corpus through each round of sorting many times over. This one is sparse:
it holds the positions that are least among ``window`` neighbours by the hash of the bytes there (ties: the leftmost),
so equal strings hold equal positions, and every start of a string belongs to one of them: the least of the first
``window`` bytes.

Doubling. A position's first key is its phrase, the bytes up to the next held position. Spark sorts (key, text, place)
over range partitions; a position's rank is the number of smaller keys, counted in each partition and added up over
partitions; positions with a key of their own are dropped. Each round pairs a position's rank with the rank as many
positions on as the ranks span, and sorts the pairs again, at offsets 1, 2, 4, 8 ... phrases, until every rank is unique or
its run reaches what every string of ``length`` bytes at that position must share (``reach`` bytes: the threshold).

Deciding bytes. What is left shares a long run with another position, but which of its starts repeat depends on the
bytes around the run. The starts of a position are judged in cells: if the string that covers all strings of a cell is
found twice, all repeat; if the string that they all share is found once, none does; otherwise the cell is cut, down to
single starts. Each question is the same range sort. Text and place break ties, so a key that a third of all rows have
is spread over as many partitions as it fills.

Defined cases: a null or empty text has no bytes and its own digest; texts under ``length`` bytes lose nothing; equal
texts (repeated rows too) of ``length`` bytes or more lose everything, also those that share a doc_id with other texts;
a text longer than a slice is a slice of its own; an empty table gives no rows; other columns of docs are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hasher, broadcast_if_small, default_partitions, discard, free_name, in_worker, materialize, mix, slices, text_bytes, words

#: Bytes whose hash decides which positions are held.
GRAM = 16
#: Bits of a distance in a packed cell.
BITS = 10
#: Into how many cells a position's starts are cut if they don't all repeat or all not; the last level has single starts.
CELLS = 8


def window_of(length: int) -> int:
    window = (length - GRAM) // 3
    if not 8 <= window < 1 << BITS:
        raise ValueError(f"length must be {3 * 8 + GRAM} to {3 * (1 << BITS) + GRAM - 1}")
    return window


def reach_of(length: int, window: int) -> int:
    """Every string of ``length`` bytes holds the run from its first sure position to the first one at least so many bytes on."""
    return length - GRAM - 2 * window + 2


def _keys(raw: np.ndarray) -> np.ndarray:
    """For each position with GRAM bytes after it: a hash of these in the upper half, the position in the lower.

    Equal bytes have equal hashes in every slice, and of equal hashes the leftmost is least, wherever the text stands.
    """
    n = len(raw) - GRAM + 1
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
        word[k::8] = part[: len(word[k::8])]
    key = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key += word[8:]
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0x94D049BB133111EB)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(n, dtype=np.uint64)
    return key


def held_positions(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are the leftmost least of some ``window`` neighbours inside one text, and the first and last start of theirs.

    The starts of a position are those whose next ``window`` positions have their least there.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < window + GRAM - 1:
        return none, none, none
    least, width = _keys(raw), 1
    while width < window:  # the least of 2, 4, 8 ... neighbours, at last of window
        step = min(width, window - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    tops = len(least)
    changes = np.flatnonzero(least[1:] != least[:-1]) + 1
    # starts of a text: those whose neighbours end inside it
    first, stop = offsets[:-1], np.minimum(offsets[1:] - window - GRAM + 2, tops)
    some = first < stop
    first, stop = first[some], stop[some]
    cuts = np.union1d(changes, np.concatenate([first, stop]))
    cuts = cuts[cuts < tops]
    text = np.searchsorted(first, cuts, side="right") - 1
    inside = (text >= 0) & (cuts < stop[np.maximum(text, 0)]) if len(first) else np.zeros(len(cuts), bool)
    low, high = cuts[inside], np.append(cuts[1:], tops)[inside] - 1
    high = np.minimum(high, stop[text[inside]] - 1)
    place = (least[low] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a cut at the start of a text may part no positions: each text's are apart anyway
    return place, low, high


def _phrases(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    """Held positions that open a phrase: tid, place (number in the text, position), name of the phrase, m (phrases up to the
    threshold, or to the end of the text), kind (and from bit 4 on the bytes to the next position) and cell (position, least
    and greatest distance back to its starts; null: no start).

    A text that says one thing over and over holds a position at each turn. Where all phrases up to the threshold are alike
    the run is no question for sorting: kind EVEN passes to the cells. Of these only such stay in the rounds (kind BOTH)
    as the run of another position goes through. Cells that meet here are settled here: kind SPAN is repeated, and one of
    each stays as a cell that is known.
    """
    reach = reach_of(length, window)
    for batch in slices(batches):
        raw, offsets = text_bytes(batch.column("text"))
        at, low, high = held_positions(raw, offsets, window)
        if len(at) < 2:
            continue
        hasher = Hasher(raw)
        number = np.arange(len(at))
        doc = np.searchsorted(offsets, at, side="right") - 1
        last = np.searchsorted(doc, doc, side="right") - 1
        m = np.clip(np.searchsorted(at, at + reach), number, last) - number
        high = np.minimum(high, offsets[doc + 1] - length)  # a start needs length bytes before the end of its text
        starts = low <= high
        name = hasher(at, np.append(at[1:], at[-1]) + GRAM)
        other = np.flatnonzero(np.concatenate([name[1:] != name[:-1], [True]]))
        even = (m >= 2) & (other[np.searchsorted(other, number)] >= number + m - 1)
        through = np.zeros(len(at) + 1, np.int64)
        np.add.at(through, number[~even], 1)
        np.add.at(through, (number + m + 1)[~even].clip(max=len(at)), -1)
        inside = np.cumsum(through[:-1]) > 0
        open_ = (last > number) & starts & even
        kind = np.where(open_, np.where(inside, BOTH, EVEN), np.where((last > number) & inside, RUN, -1))
        cell = _packed(at - offsets[doc], 0, np.where(starts, at - high, 0), np.where(starts, at - low, 0))
        which = np.flatnonzero(open_)
        if len(which):
            f1, f2, _ = _names(hasher, at[which], at[which] - high[which], at[which] - low[which], length)
            more, again = _meeting(f1, f2)
            cell[which[again]] |= KNOWN
            # the others of a known cell: repeated, and no cell of their own
            kind[which[more]] = np.where(kind[which[more]] == BOTH, SPAN_RUN, SPAN)
        keep = np.flatnonzero(kind >= 0)
        kind = kind[keep] | np.diff(np.append(at, at[-1]))[keep] << 4
        tid = batch.column("tid").to_numpy()
        place = (number - np.searchsorted(doc, doc)) << 32 | (at - offsets[doc])
        yield pa.RecordBatch.from_arrays(
            [pa.array(tid[doc[keep]]), pa.array(place[keep]), pa.array(m[keep].astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(cell[keep], mask=~starts[keep]), pa.array(name[keep].view(np.int64))],
            ["tid", "place", "m", "kind", "cell", "name"],
        )


#: Kinds of positions: in the rounds, in the cells, in both, repeated, repeated and in the rounds; and a text's longest shared run.
RUN, EVEN, BOTH, SPAN, SPAN_RUN, LONGEST = range(6)
#: The bit of a cell that another with the same bytes has been found for.
KNOWN = 1 << 62


def _packed(at: np.ndarray, d: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """A cell as one number: position, first distance back of the cell, least and greatest distance back of the position's starts in it."""
    return np.asarray(at, np.int64) << 3 * BITS | np.asarray(d, np.int64) << 2 * BITS | np.asarray(d1, np.int64) << BITS | d2


def _names(hasher: Hasher, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits that name the bytes which the strings at distances low to high back from at cover, and the first of these bytes."""
    lo, hi = at - high, at + length - low
    middle = lo + length // 2
    f1 = mix(hasher(lo, middle) + (low * 65_537 + high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return f1, hasher(middle, hi), lo


def _meeting(f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names have an equal one before them, and which one at all; of equal ones one has none before it."""
    order = np.lexsort((f2, f1))
    same = (f1[order][1:] == f1[order][:-1]) & (f2[order][1:] == f2[order][:-1])
    more, again = np.zeros(len(f1), bool), np.zeros(len(f1), bool)
    more[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return more, again


_OFFSETS = pa.schema([("_p", pa.int32()), ("_off", pa.int64()), ("_joins", pa.bool_()), ("_goes_on", pa.bool_())])


def rank_by_sorting(rows: DataFrame, keys: list[str], ties: list[str], name: str, drop_unique: bool = True, unless_first: str | None = None) -> DataFrame:
    """rows sorted by keys and ties over range partitions, written, with rank (number of smaller keys), twice and head.

    twice: another row has these keys; head: no row before it has. Without twice rows go if drop_unique. unless_first
    names a boolean column, also the first of ties: rows go if it is true in the first row of their keys.
    Only the first and last keys of each partition go to the driver, to add up counts and join what partitions part.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    order = [*keys, *ties]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, prev, gone, held, any_ = TaskContext.get().partitionId(), -1, None, False, None, False

        def out(table: pa.RecordBatch, follows: bool | None) -> pa.RecordBatch:
            """All rows of table are complete; follows: whether the row after it has the keys of its last (None: there is no such row)."""
            nonlocal run, prev, gone, any_
            n = table.num_rows
            values = [table.column(k).to_numpy() for k in keys]
            new = np.ones(n, bool)
            new[1:] = functools.reduce(np.logical_or, (v[1:] != v[:-1] for v in values))
            new[0] = prev is None or any(v[0] != p for v, p in zip(values, prev))
            runs = run + np.cumsum(new)
            after = np.append(~new[1:], bool(follows))
            edge = np.zeros(n, np.int8)
            edge[0] += not any_
            edge[-1] += 2 * (follows is None)
            head = new
            stay = np.ones(n, bool)
            if drop_unique:
                stay = ~new | after | (edge > 0)
            if unless_first:
                flag = table.column(unless_first).to_numpy(zero_copy_only=False)
                first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                bad = np.where(first >= 0, flag[np.maximum(first, 0)], gone)
                # the first run of a partition may have begun in the one before
                if part:
                    bad &= runs > 0
                gone = bool(bad[-1])
                stay &= ~bad | (edge > 0)
            run, any_, prev = int(runs[-1]), True, [v[-1] for v in values]
            marks = [pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(~new | after), pa.array(head), pa.array(edge)]
            ends = [pa.array(v, mask=edge == 0) for v in values]
            got = pa.RecordBatch.from_arrays([*(table.column(c) for c in columns), *marks, *ends], names)
            return got.filter(pa.array(stay))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            body, held = batch.slice(0, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
            if body.num_rows:
                yield out(body, all(body.column(k)[-1].as_py() == held.column(k)[0].as_py() for k in keys))
        if held is not None:
            yield out(held, None)

    names = [*columns, "_part", "_run", "_twice", "_head", "_edge", *(f"_e{k}" for k in range(len(keys)))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "_part int, _run long, _twice boolean, _head boolean, _edge byte", *(f"_e{k} long" for k in range(len(keys)))])
    sorted_ = rows.repartitionByRange(default_partitions(spark), *order).sortWithinPartitions(*order)
    numbered = materialize(sorted_.mapInArrow(in_worker(number), schema), name)
    ends: dict[int, dict] = {}
    for r in numbered.where("_edge > 0").select("_part", "_run", "_edge", *(f"_e{k}" for k in range(len(keys)))).collect():  # two rows a partition at most
        at = ends.setdefault(r["_part"], {})
        if r["_edge"] & 1:
            at["first"] = tuple(r)[3:]
        if r["_edge"] & 2:
            at["last"], at["n"] = tuple(r)[3:], r["_run"] + 1
    offsets, total, before = [], 0, None
    for part in sorted(ends):
        joined = before is not None and ends[before]["last"] == ends[part]["first"]
        if joined:
            offsets[-1][3] = True
        offsets.append([part, total - joined, joined, False])
        total += ends[part]["n"] - joined
        before = part
    # from Arrow: rows of Python would start workers of another kind on the executors
    at = spark.createDataFrame(pa.Table.from_pylist([dict(zip(_OFFSETS.names, row)) for row in offsets], _OFFSETS))
    first, last = F.col("_edge").bitwiseAND(F.lit(1)) > 0, F.col("_edge").bitwiseAND(F.lit(2)) > 0
    twice = F.col("_twice") | (first & F.col("_joins")) | (last & F.col("_goes_on"))
    out = numbered.join(F.broadcast(at), F.col("_part") == F.col("_p")).select(*columns, (F.col("_run") + F.col("_off")).alias("rank"), twice.alias("twice"), (F.col("_head") & ~(first & F.col("_joins"))).alias("head"))
    out = out.where("twice") if drop_unique else out
    out._scratch = numbered._scratch
    return out


def _cells(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """For each cell of width distances back from a position: f1 and f2, which name the bytes that its strings cover, and c, which names those that all strings of a whole cell share; new: found twice here, and more: another row stands for it."""
    mask = (1 << BITS) - 1
    for batch in slices(batches):
        raw, offsets = text_bytes(batch.column("text"))
        hasher = Hasher(raw)
        cells = batch.column("cells")
        n = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1])
        cell = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        known = cell >= KNOWN
        at, d, d1, d2 = (cell & ~KNOWN) >> 3 * BITS, cell >> 2 * BITS & mask, cell >> BITS & mask, cell & mask
        doc = np.repeat(np.arange(len(n)), n)
        at = at + offsets[doc]
        f1, f2, _ = _names(hasher, at, d1, d2, length)
        c = mix(hasher(at - d, at + length - (d + width - 1)) + d.astype(np.uint64))
        more, again = _meeting(f1, f2)
        ready = known | again
        tid = batch.column("tid").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(tid[doc]), pa.array(np.where(ready, cell | KNOWN, cell)), pa.array(ready & ~known), pa.array(more), *(pa.array(x.view(np.int64)) for x in (f1, f2, c))],
            ["tid", "cell", "new", "more", "f1", "f2", "c"],
        )


def _pair(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Ranks of runs of span phrases, in order of tid and place, with the rank some positions on: the span, or what is left up to the threshold.

    In the first round also a row of kind LONGEST for each text: in place, the bytes of its longest run of phrases that are each found twice.
    """
    columns = ["tid", "place", "m", "kind", "cell"]

    def longest(rows: pa.RecordBatch) -> pa.RecordBatch:
        tid, place, kind = (rows.column(k).to_numpy() for k in ("tid", "place", "kind"))
        number, at = place >> 32, place & 0xFFFFFFFF
        opens = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (number[1:] != number[:-1] + 1)]))
        ends = np.append(opens[1:], len(tid)) - 1
        size = at[ends] + (kind[ends] >> 4) + GRAM - at[opens]
        first = np.flatnonzero(np.concatenate([[True], tid[opens][1:] != tid[opens][:-1]]))
        zero, n = np.zeros(len(first), np.int64), len(first)
        return pa.RecordBatch.from_arrays([pa.array(tid[opens][first]), pa.array(np.maximum.reduceat(size, first)), pa.array(zero.astype(np.int32)), pa.array(np.full(n, LONGEST, np.int32)), pa.nulls(n, pa.int64()), pa.array(zero), pa.array(zero)], [*columns, "k", "next"])

    def whole_texts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pairs(rows)
        if span == 1:
            yield longest(rows)

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        tid, m, rank = (rows.column(k).to_numpy() for k in ("tid", "m", "rank"))
        number = np.cumsum(np.concatenate([[0], tid[1:] != tid[:-1]])).astype(np.int64) << 32 | rows.column("place").to_numpy() >> 32
        step = np.minimum(span, m - span).astype(np.int64)
        to = np.searchsorted(number, number + step)
        there = (step > 0) & (to < len(number))
        to = np.minimum(to, len(number) - 1)
        there &= number[to] == number + step
        # runs of another step are other runs
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in columns), pa.array(rank), pa.array(rank[to] << BITS + 1 | step)], [*columns, "k", "next"]).filter(pa.array(there))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and batch.column("tid")[0] != held[-1].column("tid")[-1]:
            yield from whole_texts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        tid = batch.column("tid").to_numpy()
        cut = int(np.searchsorted(tid, tid[-1]))  # the last text may go on
        if cut:
            yield from whole_texts(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from whole_texts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def repeated_runs(texts: DataFrame, length: int, window: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """By prefix doubling over texts (tid, text): cells (tid, cell) of the positions whose run of phrases up to the threshold is found twice, cells that are repeated as they are, tid and n_shared (bytes of the longest run of phrases that are each found twice), and the tables that hold the cells."""
    columns, kind = "tid long, place long, m int, kind int, cell long", F.col("kind").bitwiseAND(F.lit(15))
    phrases = materialize(texts.select("tid", "text").mapInArrow(in_worker(lambda it: _phrases(it, length, window)), f"{columns}, name long"), "phrases")
    ranks = rank_by_sorting(phrases.where(kind.isin(RUN, BOTH, SPAN_RUN)), ["name"], ["tid", "place"], "ranks-1")
    even = materialize(phrases.where(kind.isin(EVEN, BOTH, SPAN, SPAN_RUN)).select("tid", "cell", kind.alias("kind")), "runs-of-one-phrase")
    discard(phrases)
    held, span = [even], 1
    done = even.where(F.col("kind").isin(EVEN, BOTH)).select("tid", "cell")
    ready = even.where(F.col("kind").isin(SPAN, SPAN_RUN) | (F.col("cell") >= F.lit(KNOWN))).select("tid", "cell")
    while True:
        # up to the threshold there are span phrases or fewer: the run that every string at this position shares is ranked
        done = done.unionByName(ranks.where((F.col("m") <= span) & (kind == RUN) & F.col("cell").isNotNull()).select("tid", "cell"))
        held.append(ranks)
        if span > 1 and ranks.where(F.col("m") > span).isEmpty():
            return done, ready, longest, held
        # a position with fewer phrases to go is in no longer run that starts before it
        by_text = ranks.where(F.col("m") >= span).select("tid", "place", "m", "kind", "cell", "rank").repartition(default_partitions(texts.sparkSession), "tid").sortWithinPartitions("tid", "place")
        pairs = materialize(by_text.mapInArrow(in_worker(lambda it, span=span: _pair(it, span)), f"{columns}, k long, next long"), f"pairs-{2 * span}")
        if span == 1:
            longest = materialize(pairs.where(kind == LONGEST).select("tid", F.col("place").alias("n_shared")), "longest-shared-runs")
        ranks = rank_by_sorting(pairs.where(kind != LONGEST), ["k", "next"], ["tid", "place"], f"ranks-{2 * span}")
        discard(pairs)
        span *= 2


def _unique_texts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests (doc_id, sha, n_bytes) of all rows, copied (sha of texts of length bytes or more that two rows or more have), and texts (tid, sha, text): one row of each text of length bytes or more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"), "text")
    digests = materialize(keyed.drop("text"), "digests")
    copied = materialize(digests.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "copied")
    long_ = keyed.where(F.col("n_bytes") >= length)
    alone = long_.join(broadcast_if_small(copied.select("sha")), "sha", "left_anti").select("sha", "text")
    # of copied texts the rows of the least doc_id, and of these one: doc_id may be null or repeat
    first = broadcast_if_small(copied.select(F.col("sha").alias("_sha"), "first"))
    one = long_.join(first, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").groupBy("sha").agg(F.first("text").alias("text"))
    texts = materialize(alone.unionByName(one).select(F.monotonically_increasing_id().alias("tid"), "sha", "text"), "unique-texts")
    return digests, copied, texts


def _field(shift: int) -> Column:
    return F.shiftright("cell", shift * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _span(cells: DataFrame, length: int) -> DataFrame:
    """tid and span (first byte and end of the bytes that a cell's strings cover, in one number)."""
    at = F.shiftright(F.col("cell").bitwiseAND(F.lit(KNOWN - 1)), 3 * BITS)
    return cells.select("tid", F.shiftleft(at - _field(0), 32).bitwiseOR(at + length - _field(1)).alias("span"))


def repeated_spans(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """tid, text and spans (first byte << 32 | end; they may overlap) of each of texts (tid, text; no two alike) that holds a string of length bytes that also starts elsewhere; and tid and n_shared (see repeated_runs)."""
    window = window_of(length)
    parent, ready, longest, spent = repeated_runs(texts, length, window)
    # a text may have all its cells settled in its slice: it is in ready alone
    wanted = materialize(parent.select(F.col("tid").alias("_tid")).unionByName(ready.select(F.col("tid").alias("_tid"))).distinct(), "texts-with-repeats")
    kept = texts.select("tid", "text").join(broadcast_if_small(wanted), F.col("tid") == F.col("_tid"), "left_semi")
    spans, widths = [materialize(_span(ready, length), "spans-of-one-phrase")], (window, -(-window // CELLS), 1)
    schema = "tid long, cell long, new boolean, more boolean, f1 long, f2 long, c long"
    for level, width in enumerate(widths):
        listed = parent.groupBy("tid").agg(F.collect_list("cell").alias("cells"))  # as many as the text has positions
        rows = materialize(kept.join(listed, "tid").mapInArrow(in_worker(lambda it, width=width: _cells(it, length, width)), schema), f"cells-{level}")
        discard(*spent)
        spans.append(materialize(_span(rows.where("new"), length), f"spans-{level}-here"))
        ranked = rank_by_sorting(rows.where("not more").select("tid", "cell", "c", "f1", "f2"), ["f1", "f2"], ["tid", "cell"], f"judged-{level}", drop_unique=False)
        discard(rows)
        known = F.col("cell") >= F.lit(KNOWN)
        spans.append(materialize(_span(ranked.where(F.col("twice") & ~known), length), f"spans-{level}"))
        if width == 1:
            discard(ranked)
            break
        # of sure cells with the same bytes one goes on, so that open ones find their like; a shared part that only sure cells or one cell have is settled
        open_ = ranked.withColumn("sure", F.col("twice") | known).where("not sure or head").select("tid", "cell", "sure", "c")
        shared = rank_by_sorting(open_, ["c"], ["sure", "tid", "cell"], f"open-{level}", unless_first="sure")
        step = widths[level + 1]
        fields = shared.select("tid", "sure", F.shiftright(F.col("cell").bitwiseAND(F.lit(KNOWN - 1)), 3 * BITS).alias("at"), _field(1).alias("d1"), _field(0).alias("d2"))
        finer = fields.select("*", F.expr(f"explode(sequence(cast(d1 div {step} * {step} as int), d2, {step}))").alias("d"))
        packed = F.shiftleft(F.col("at"), 3 * BITS).bitwiseOR(F.shiftleft(F.col("d").cast("long"), 2 * BITS)).bitwiseOR(F.shiftleft(F.greatest("d1", "d").cast("long"), BITS)).bitwiseOR(F.least(F.col("d2"), F.col("d") + (step - 1)).cast("long"))
        parent = finer.select("tid", F.when(F.col("sure"), packed.bitwiseOR(F.lit(KNOWN))).otherwise(packed).alias("cell"))
        spent = [ranked, shared]
    every = functools.reduce(DataFrame.unionByName, spans).groupBy("tid").agg(F.collect_list("span").alias("spans"))
    return kept.join(every, "tid"), longest


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    opens = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]]))
    return lo[opens], top[np.append(opens[1:], len(lo)) - 1]


def _cut(batches: Iterator[pa.RecordBatch], least_words: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """sha, n_removed, n_spans, kept_sha256 (and the text left) of texts whose runs of least_words whole words or more go."""
    for batch in slices(batches):
        raw, offsets = text_bytes(batch.column("text"))
        cells = batch.column("spans")
        n = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1])
        span = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.repeat(offsets[:-1] + np.arange(len(n)), n)  # one byte between texts: runs of two texts never touch
        lo, hi = (span >> 32) + begin, (span & 0xFFFFFFFF) + begin
        lo, hi = _merge(lo, hi)
        doc = np.searchsorted(offsets[:-1] + np.arange(len(n)), lo, side="right") - 1
        lo, hi = lo - doc, hi - doc
        if least_words:
            start, end, _ = words(raw, offsets)
            enough = np.searchsorted(end, hi, side="right") - np.searchsorted(start, lo) >= least_words
            lo, hi, doc = lo[enough], hi[enough], doc[enough]
        gone = np.zeros(len(raw) + 1, np.int32)
        np.add.at(gone, lo, 1)
        np.add.at(gone, hi, -1)
        stays = np.cumsum(gone[:-1]) == 0
        left = raw[stays].tobytes()
        ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
        whole = raw.tobytes()
        removed, runs = np.diff(offsets) - np.diff(ends), np.bincount(doc, minlength=len(n))
        some = np.flatnonzero(runs)
        shas = [hashlib.sha256(whole[offsets[k] : offsets[k + 1]]).hexdigest() for k in some]
        kept = [left[ends[k] : ends[k + 1]] for k in some]
        columns = [pa.array(shas, pa.string()), pa.array(removed[some].astype(np.int64)), pa.array(runs[some].astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        more = [pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())] if with_text else []
        yield pa.RecordBatch.from_arrays([*columns, *more], ["sha", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 4 + with_text])


def _changed(docs: DataFrame, length: int, least_words: int, with_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows; what became of each text that lost something: sha, n_removed, n_spans, kept_sha256 (and the text left); sha and n_shared."""
    digests, copied, texts = _unique_texts(docs, length)
    schema = "sha string, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    found, longest = repeated_spans(texts, length)
    parts = found.select("text", "spans").mapInArrow(in_worker(lambda it: _cut(it, least_words, with_text)), schema)
    parts = parts.join(copied.select("sha"), "sha", "left_anti")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = digests.join(copied.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.max("n_bytes").alias("n_removed")).select("sha", "n_removed", F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256"), *([F.lit("").alias("kept_text")] if with_text else []))
    return digests, parts.unionByName(whole), texts.select("tid", "sha").join(longest, "tid").select("sha", "n_shared")


def dedup_substrings(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared of every row of docs (doc_id, text).

    n_shared tells of passages that are too short to be removed: the bytes of the longest run of phrases that are each
    found twice in the texts of length bytes or more, copies counted once. A passage that stands in two texts has a whole
    phrase at the least if it is longer than 2 * window + GRAM bytes; chance repeats are short.
    """
    digests, changed, shared = _changed(docs, length, 0, False)
    none = F.lit(0).cast("long")
    joined = digests.join(changed, "sha", "left").join(shared, "sha", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_shared", none).alias("n_shared"))


def remove_repeats(docs: DataFrame, length: int = 400, least_words: int = 0) -> DataFrame:
    """The rows of docs without their repeated bytes (pieces of characters at the cuts go too); rows left without a word go.

    Of repeated runs only those of least_words whole words or more go. Columns of docs, whatever their names; n_chars,
    where there is one, follows the new text. Texts that two rows or more have go whole, however few words they have.
    """
    _, changed, _ = _changed(docs, length, least_words, True)
    key, digest, left, few_key = (free_name(docs, x) for x in ("sha_of_row", "sha", "kept_text", "short_sha"))
    changed = materialize(changed, "changed-texts").select(F.col("sha").alias(digest), F.col("kept_text").alias(left))
    few = broadcast_if_small(materialize(changed.select(F.xxhash64(digest).alias(few_key)), "changed-keys"))
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    same = keyed.join(few, F.xxhash64(key) == F.col(few_key), "left_anti").select(*docs.columns)
    new = keyed.join(few, F.xxhash64(key) == F.col(few_key), "left_semi").join(changed, F.col(key) == F.col(digest), "left")
    new = new.where(F.col(digest).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce(left, "text")  # a text whose digest shares 64 bits with a changed one stays as it is
    columns = [text.alias(c) if c == "text" else F.when(F.col(digest).isNull(), F.col(c)).otherwise(F.char_length(left).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return same.unionByName(new.select(*columns))
