"""Token ids in binary files: frequency-ranked ids, one to four bytes each, with the lengths in separate control bytes.

A file holds documents in ascending order of doc_id: a header, the index (doc_id, whether it is null, number of ids),
all control bytes (two bits an id, four ids a byte, each document starts a byte) and all data bytes. ranks.bin beside
the files maps ranks to ids. numpy decodes by looking each control byte up in a table of four lengths.

Ids are those of the library's plain call: text that spells one of the vocabulary's added tokens becomes that token.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; rows that repeat a doc_id stand
one after another, in any order; if a third of all rows have one doc_id (or none) they fill several files, each written
by its own task; a text longer than a slice is a slice of its own; an empty table writes no files;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import binary_array, default_partitions, delete_path, materialize, ragged, scratch_path, slices, text_bytes
from tessera.llm.vocabularies import byte_bpe, byte_bpe_chunks, vocabulary_path

MAGIC = b"TSRTOK1\0"
#: Ids that one file should hold.
FILE_IDS = 12_000_000
#: Bytes that one task holds before it writes a file and goes on with the next; a single document may have more.
FILE_BYTES = 64 << 20
#: Text bytes that are cut into chunks together: of more text, fewer chunks are new to it.
TEXT_BYTES = 2 << 20
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int8)


def encode_ids(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of consecutive documents of counts[i] ranks, and the sizes of both for each document."""
    size = np.ones(len(ranks), np.int64)
    for k in range(1, 4):
        more = ranks >= 1 << 8 * k
        if not more.any():
            break
        size += more
    data_end = np.cumsum(size)
    start = data_end - size
    data = np.zeros(int(data_end[-1]) if len(size) else 0, np.uint8)
    data[start] = ranks & 0xFF
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[start[more] + k] = (ranks[more] >> (8 * k)) & 0xFF
    controls = -(-counts // 4)
    first = np.concatenate([[0], np.cumsum(controls)])
    place = np.arange(len(ranks)) + np.repeat(4 * first[:-1] - (np.cumsum(counts) - counts), counts)
    two = np.zeros(4 * int(first[-1]), np.uint8)
    two[place] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    ends = np.concatenate([[0], np.cumsum(counts)])
    return control.astype(np.uint8), data, controls, np.concatenate([[0], data_end])[ends[1:]] - np.concatenate([[0], data_end])[ends[:-1]]


def decode_ids(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of consecutive documents, by table lookup."""
    controls = -(-counts // 4)
    size = LENGTHS[control].reshape(-1)[ragged(4 * (np.cumsum(controls) - controls), counts)]
    start = np.cumsum(size) - size
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_bytes(path: str, parts: list[bytes]) -> None:
    """Writes aside, then renames, so that a task that is run again leaves one whole file."""
    import os

    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    aside = f"{where}.{os.getpid()}.{np.random.default_rng().integers(1 << 60):x}.tmp"
    with store.open_output_stream(aside) as f:
        for x in parts:
            f.write(x)
    store.move(aside, where)


def read_bytes(path: str) -> bytes:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_stream(where) as f:
        return f.read()


@dataclass
class TokenStore:
    """Files of one corpus. ``files`` has one entry a file: name, documents, ids; in ascending order of doc_id."""

    path: str
    files: list[tuple[str, int, int]]

    def read(self, spark: SparkSession) -> DataFrame:
        """doc_id, start (ids of all documents before it) and ids of each document, read back from the files."""
        return self._scan(spark, "doc_id long, start long, ids array<int>", False)

    def digests(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""
        return self._scan(spark, "doc_id long, start long, n_tokens long, ids_crc32 long", True)

    def _scan(self, spark: SparkSession, schema: str, digest: bool) -> DataFrame:
        path, rows, start = self.path, [], 0
        for name, _, n_ids in self.files:
            rows.append((name, start))
            start += n_ids
        listing = spark.createDataFrame(pa.table({"name": pa.array([r[0] for r in rows], pa.string()), "start": pa.array([r[1] for r in rows], pa.int64())})).repartition(max(1, min(len(rows), 4 * default_partitions(spark))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranked = None
            for batch in batches:
                for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if ranked is None:
                        ranked = np.frombuffer(read_bytes(f"{path}/ranks.bin"), np.uint32)
                    yield from _decode_file(read_bytes(f"{path}/{name}"), ranked, begin, digest)

        return listing.mapInArrow(scan, schema)


def _decode_file(blob: bytes, ranked: np.ndarray, begin: int, digest: bool) -> Iterator[pa.RecordBatch]:
    assert blob[:8] == MAGIC
    n, n_control, _ = np.frombuffer(blob, np.int64, 3, 8)
    at = 32
    doc_id = np.frombuffer(blob, np.int64, n, at)
    null = np.frombuffer(blob, np.uint8, n, at + 8 * n).astype(bool)
    counts = np.frombuffer(blob, np.int64, n, at + 9 * n)
    sizes = np.frombuffer(blob, np.int64, n, at + 17 * n)
    control = np.frombuffer(blob, np.uint8, n_control, at + 25 * n)
    data = np.frombuffer(blob, np.uint8, offset=at + 25 * n + n_control)
    c_end, d_end, i_end = np.cumsum(-(-counts // 4)), np.cumsum(sizes), np.cumsum(counts)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(i_end, (i_end[lo - 1] if lo else 0) + 1_000_000, side="right")))
        c0, d0, i0 = (x[lo - 1] if lo else 0 for x in (c_end, d_end, i_end))
        ids = ranked[decode_ids(control[c0 : c_end[hi - 1]], data[d0 : d_end[hi - 1]], counts[lo:hi])]
        ends = i_end[lo:hi] - i0
        keys = pa.array(doc_id[lo:hi], mask=null[lo:hi])
        starts = pa.array(begin + i_end[lo:hi] - counts[lo:hi])
        if digest:
            view = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([keys, starts, pa.array(counts[lo:hi]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        else:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, starts, lists], ["doc_id", "start", "ids"])
        lo = hi


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> TokenStore:
    """Encodes docs (doc_id, text) and writes them under path; the driver sees one row a file and one count an id."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    wide = byte_bpe(vocabulary).get_vocab_size() > 1 << 16
    kind = np.uint32 if wide else np.uint16

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe_chunks(vocabulary)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, counts = encoder.column(batch.column("text"))
            ends = np.cumsum(counts + 1)
            out = np.insert(ids.astype(kind), np.cumsum(counts), end_id)
            offsets = np.concatenate([[0], ends]) * out.itemsize
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), binary_array(out, offsets)], ["doc_id", "ids"])

    staged = materialize(docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, ids binary"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (8 * np.dtype(kind).itemsize) if not wide else 1 << 20, np.int64)
        rows = 0
        for batch in slices(batches, "ids"):
            got = np.bincount(text_bytes(batch.column("ids"))[0].view(kind))
            total[: len(got)] += got
            rows += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    counts = staged.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()  # one row an id of the vocabulary at most
    ranked = np.array([r["id"] for r in counts], np.uint32)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    total = sum(r["n"] for r in counts)
    write_dir(path)
    write_bytes(f"{path}/ranks.bin", [ranked.tobytes()])
    n_files = max(default_partitions(spark), -(-total // file_ids))
    lowest = np.iinfo(np.int64).min
    place = F.coalesce("doc_id", F.lit(int(lowest)))
    bounds = staged.select(F.percentile_approx(place, [k / n_files for k in range(1, n_files)], 10 * n_files).alias("b")).first()["b"] if n_files > 1 and total else []
    bounds = np.array(bounds or [], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            raw, offsets = text_bytes(batch.column("ids"))
            n = np.diff(offsets) // np.dtype(kind).itemsize
            control, data, controls, sizes = encode_ids(rank_of[raw.view(kind)], n)
            cuts = [[0, *np.cumsum(x).tolist()] for x in (controls, sizes)]
            control, data = memoryview(control), memoryview(data)
            blob = b"".join(x for k in range(len(n)) for x in (control[cuts[0][k] : cuts[0][k + 1]], data[cuts[1][k] : cuts[1][k + 1]]))
            ends = np.cumsum(controls + sizes)
            keys = batch.column("doc_id")
            # a doc_id that several bounds name has as many rows as several files hold: they are dealt out among these
            whole = keys.fill_null(int(lowest)).to_numpy()
            first, last = (np.searchsorted(bounds, whole, side=side) for side in ("left", "right"))
            bucket = last.astype(np.int32)
            for k in np.flatnonzero(last - first > 1):
                bucket[k] = first[k] + 1 + k % (last[k] - first[k])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), keys, pa.array(n), pa.array(controls), binary_array(blob, np.concatenate([[0], ends]))], ["bucket", "doc_id", "n", "controls", "blob"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, size, cut = None, 0, 0

        def flush():
            keys, n, controls, blobs = (list(x) for x in zip(*held))
            counts, c = np.array(n, np.int64), np.array(controls, np.int64)
            sizes = np.array([len(b) for b in blobs], np.int64) - c
            name = f"part-{now:08d}-{cut:06d}.tok"
            head = MAGIC + np.array([len(keys), int(c.sum()), int(counts.sum())], np.int64).tobytes()
            index = [np.array([k or 0 for k in keys], np.int64).tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(), counts.tobytes(), sizes.tobytes()]
            write_bytes(f"{path}/{name}", [head, *index, b"".join(b[:k] for b, k in zip(blobs, controls)), b"".join(b[k:] for b, k in zip(blobs, controls))])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["name", "docs", "ids"])

        for batch in slices(batches, "blob"):
            for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and (bucket != now or size + len(row[-1]) > FILE_BYTES):
                    yield flush()
                    held, size, cut = [], 0, cut + 1 if bucket == now else 0
                now, size = bucket, size + len(row[-1])
                held.append(tuple(row))
        if held:
            yield flush()

    packed = staged.mapInArrow(pack, "bucket int, doc_id long, n long, controls long, blob binary")
    written = packed.repartition(n_files, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "n", "blob").mapInArrow(save, "name string, docs long, ids long")
    files = sorted((r["name"], r["docs"], r["ids"]) for r in written.collect())  # one row a file
    delete_path(spark, staged.inputFiles()[0].rpartition("/")[0] if files else f"{path}/none")
    return TokenStore(path, files)


def write_dir(path: str) -> None:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where, recursive=True)


def tokens_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to a store in the shared folder and returns the digests of what the files give back."""
    spark = docs.sparkSession
    return write_tokens(docs, scratch_path(spark, "token-store"), **options).digests(spark)
