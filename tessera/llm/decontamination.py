"""Benchmark decontamination by SimHash, in DataFrame functions alone.

A benchmark item of n word shingles is compared with the windows of n shingles of a document. A window gets a 64-bit
SimHash; it is cut into BLOCKS blocks, so that of two fingerprints within the radius one block differs in at most
radius // BLOCKS bits (multi-index; the radius is wider for items of few or unequal shingles). The items' fingerprints are listed under every such neighbour of each of their
blocks, and a window looks its own blocks up among items of its size: that, and a Hamming distance within the radius,
makes a candidate. Candidates are verified by exact weighted similarity (weighted Jaccard of shingle multisets; a
shingle weighs the number of its characters).

Fingerprints are made of all windows that hold a shingle of the benchmark, whichever item it is from, wherever in the
window it stands. A window without one shares nothing with any item, so its similarity is 0.

Defined cases: items under five words have no shingle and match nothing, as do null and empty texts; a text of fewer
shingles than an item has no window of its size; rows without a doc_id aren't searched; equal rows count once; of windows
with one similarity the first is reported; an item_id that repeats is one item, of all its rows' shingles; an empty
benchmark gives no matches; other columns are not read, and drop_contaminated keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, free_name, materialize

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 20
#: Blocks of a fingerprint: with radius 20 one of 7 differs in 2 bits at most, so an item is listed under 46 or 56 values a block.
BLOCKS = 7
#: An item whose weight lies on few shingles flips more bits: where heavy shingles cancel, a light one decides, so up to a
#: quarter of the 64 bits change at similarity 0.8 (16 on average, over 28 once in some 3,000), against 0.15 of them else.
#: Items of fewer shingles than EVEN_SHINGLES, heavy ones counting for more (square of the sum over sum of squares), have a radius of WIDE.
EVEN_SHINGLES, WIDE = 32, 28


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hash of each run of size words; an empty array if there are fewer words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _weight(words: Column, i: Column, size: int) -> Column:
    return sum((F.char_length(F.get(words, i + k)) for k in range(1, size)), F.char_length(F.get(words, i))).cast("long")


def weighted_shingles(words: Column, size: int = SHINGLE) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h"), _weight(words, i, size).alias("w")))


def _sums() -> list[Column]:
    """Weights of the set bits, two bits a sum (32 bits each), and the weight of all."""
    pairs = [F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << b)) != 0, F.col("w")).otherwise(F.lit(0)) + F.when(F.col("h").bitwiseAND(F.lit(1 << (b + 32) if b < 31 else -(1 << 63))) != 0, F.shiftleft("w", 32)).otherwise(F.lit(0))).alias(f"_s{b}") for b in range(32)]
    return [*pairs, F.sum("w").alias("_total")]


def _fingerprint() -> Column:
    """The bits whose set weight is more than half of all, as one long."""
    out = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"_s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(F.col(f"_s{b}"), 32)
        out = out.bitwiseOR(F.when(2 * low > F.col("_total"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(2 * high > F.col("_total"), F.lit(1 << (b + 32) if b < 31 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return out


def hamming_blocks(fingerprint: Column, n: int = BLOCKS) -> Column:
    """n blocks of near equal width: (number of the block, its bits)."""
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fingerprint, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)).alias("bits")) for k in range(n)])


def hamming_neighbours(fingerprint: Column, radius: int, n: int = BLOCKS) -> Column:
    """For each block all values within radius // n bits: what any fingerprint within the radius has in one block at least."""
    cuts = [64 * k // n for k in range(n + 1)]
    lists = []
    for k in range(n):
        width = cuts[k + 1] - cuts[k]
        bits = F.shiftrightunsigned(fingerprint, cuts[k]).bitwiseAND(F.lit((1 << width) - 1))
        near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long")), lambda x: F.bit_count(x.bitwiseXOR(bits)) <= radius // n)
        lists.append(F.transform(near, lambda x: F.struct(F.lit(k).alias("k"), x.alias("bits"))))
    return F.flatten(F.array(*lists))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, start (word where the best window opens), similarity and distance of each pair that matches."""
    # words are a column of their own: inside the lambdas the text would else be split anew for every shingle
    words = F.col("words")
    each = benchmark.where("item_id is not null").select("item_id", word_array(F.col("text")).alias("words")).select("item_id", F.posexplode(F.when(F.size(words) >= size, weighted_shingles(words, size))).alias("at", "s"))
    each = each.select("item_id", "at", "s.h", "s.w").distinct()
    items = materialize(each.groupBy("item_id", "h").agg(F.count("*").alias("n_item"), F.max("w").alias("w")), "item-shingles")
    totals = materialize(items.select("item_id", "h", (F.col("w") * F.col("n_item")).alias("w"), "n_item").groupBy("item_id").agg(*_sums(), F.sum("n_item").cast("int").alias("n"), F.sum(F.col("w").cast("double") * F.col("w")).alias("_squares")).select("item_id", "n", F.col("_total").alias("item_weight"), _fingerprint().alias("item_print"), F.when(F.pow(F.col("_total").cast("double"), 2) < EVEN_SHINGLES * F.col("_squares"), F.lit(max(radius, WIDE))).otherwise(F.lit(radius)).alias("radius")), "item-prints")
    # each shingle of the benchmark, once, with the sizes of the items that have it
    known = broadcast_if_small(materialize(items.join(totals, "item_id").groupBy("h").agg(F.collect_set("n").alias("sizes")), "known-shingles"))

    # windows that hold a shingle of the benchmark: for each document their sizes and starts
    row = F.xxhash64("text")
    shingled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    hashed = shingled.where(F.col("doc_id").isNotNull() & (F.size("words") >= size)).select("doc_id", "row", (F.size("words") - size + 1).alias("top"), F.posexplode(shingle_hashes(F.col("words"), size)).alias("at", "h"))
    hits = hashed.join(known, "h").select("doc_id", "row", "top", "at", F.explode("sizes").alias("n")).where("n <= top")
    # hits that lie close together have one range of starts, so that no start is listed twice
    spots = hits.groupBy("doc_id", "row", "top", "n").agg(F.array_sort(F.collect_set("at")).alias("spots"))
    windows = F.expr("flatten(transform(spots, (at, j) -> case when greatest(0, at - n + 1, if(j > 0, spots[j - 1] + 1, 0)) <= least(at, top - n) then sequence(greatest(0, at - n + 1, if(j > 0, spots[j - 1] + 1, 0)), least(at, top - n)) else array() end))")
    starts = spots.select("doc_id", "row", "n", windows.alias("starts")).where("size(starts) > 0").groupBy("doc_id", "row").agg(F.collect_list(F.struct("n", "starts")).alias("windows"))  # as many as the text has words, for each size
    starts = materialize(starts, "windows")
    wanted = broadcast_if_small(materialize(starts.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")), "documents-with-windows"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row")).join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left_semi").dropDuplicates(["doc_id", "row"])
    shingles = materialize(texts.select("doc_id", "row", word_array(F.col("text")).alias("words")).select("doc_id", "row", weighted_shingles(words, size).alias("shingles")), "shingles-of-documents")

    window = ["doc_id", "row", "n", "start"]
    # a window's shingles are cut from the list of its document and summed in the same task; only sums are shuffled
    per_size = shingles.join(starts, ["doc_id", "row"]).select("doc_id", "row", "shingles", F.explode("windows").alias("w"))
    cut = F.transform("w.starts", lambda x: F.struct(x.alias("start"), F.slice("shingles", x + 1, F.col("w.n")).alias("inside")))
    opened = per_size.select("doc_id", "row", "w.n", F.explode(cut).alias("o"))
    content = opened.select("doc_id", "row", "n", "o.start", F.explode("o.inside").alias("s")).select(*window, "s.h", "s.w")
    # written before use: the plan would else repeat the 64-bit expression for every block
    prints = materialize(content.groupBy(*window).agg(*_sums()).select(*window, F.col("_total").alias("window_weight"), _fingerprint().alias("print")), "window-prints")
    left = prints.select(*window, "window_weight", "print", F.explode(hamming_blocks(F.col("print"))).alias("b")).select(*window, "window_weight", "print", "b.k", "b.bits")
    listed = F.when(F.col("radius") == radius, hamming_neighbours(F.col("item_print"), radius)).otherwise(hamming_neighbours(F.col("item_print"), max(radius, WIDE)))
    right = totals.select("item_id", "n", "item_print", "item_weight", "radius", F.explode(listed).alias("b")).select("item_id", "n", "item_print", "item_weight", "radius", "b.k", "b.bits")
    close = left.join(broadcast_if_small(materialize(right, "item-blocks")), ["n", "k", "bits"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    candidates = materialize(close.where(F.col("distance") <= F.col("radius")).select(*window, "item_id", "window_weight", "item_weight", "distance").distinct(), "candidates")

    # exact similarity of the candidates
    chosen = candidates.groupBy("doc_id", "row").agg(F.collect_set(F.struct("n", "start")).alias("windows"))
    cut = F.transform("windows", lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), F.slice("shingles", x["start"] + 1, x["n"]).alias("inside")))
    again = shingles.join(chosen, ["doc_id", "row"]).select("doc_id", "row", F.explode(cut).alias("o")).select("doc_id", "row", "o.n", "o.start", F.explode("o.inside").alias("s"))
    counted = again.groupBy(*window, F.col("s.h").alias("h")).agg(F.count("*").alias("n_window"), F.max("s.w").alias("w1"))
    per_item = broadcast_if_small(items.select("item_id", "h", "n_item"))
    shared = counted.join(per_item, "h").groupBy(*window, "item_id").agg(F.sum(F.col("w1") * F.least("n_window", "n_item")).alias("both"))
    verified = candidates.join(shared, [*window, "item_id"]).withColumn("similarity", F.col("both") / (F.col("window_weight") + F.col("item_weight") - F.col("both"))).where(F.col("similarity") >= threshold - 1e-12)
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("_s"), (-F.col("distance")).alias("_d"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b._s")).cast("int").alias("start"), F.round("b.similarity", 9).alias("similarity"), (-F.col("b._d")).cast("int").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that match no item; the columns of docs."""
    name = free_name(docs, "contaminated")
    found = materialize(benchmark_matches(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(found), docs["doc_id"] == F.col(name), "left_anti")
