"""Fill-in-middle transformation: texts are cut at line ends into prefix, middle and suffix and put in another order.

One table drives one scan over the bytes of many texts: a DFA whose transitions are counted by what they emit (a code
point begins, a unit ends, a sentinel is complete). The counts give each text's number of units and whether it may be
cut; a second pass over the emitted transitions finds the byte at which a counted unit ends. The same scan finds the
sentinels when texts are restored. What state follows a byte depends on no more than the three bytes up to it, so the
scan runs in many lanes side by side, each begun three bytes before its own.

Defined cases: a null text is an empty one; an empty text, a text that holds a sentinel, and one that the draw leaves
out are plain; a null doc_id draws as ``null``; rows alike are cut alike; code points are bytes that continue none, so
bytes that are no UTF-8 pass unchanged; a text longer than a slice is a slice of its own; an output that is not of its
form restores to null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_worker, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: What a transition may emit: a code point begins; a unit ends; one of the sentinels is complete.
POINT, UNIT, P, S, M = 1, 2, 4, 8, 16
#: Classes of bytes; STOP stands after each text.
_OTHER, _LINE, _OPEN, _P, _S, _M, _SHUT, _CONT, _LEAD2, _LEAD3, _LEAD4, STOP = range(12)
#: States: no byte of a unit yet, inside one, after "<", after "<" and a letter, and so many bytes of a character to come.
_NEW, _IN, _LT, _LTP, _LTS, _LTM, _MORE1, _MORE2, _MORE3 = range(9)
#: Bytes on which a state depends.
_MEMORY = 3


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for byte, kind in ((b"\n", _LINE), (b"<", _OPEN), (b"P", _P), (b"S", _S), (b"M", _M), (b">", _SHUT)):
        out[byte[0]] = kind
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:0xF8] = _CONT, _LEAD2, _LEAD3, _LEAD4
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission of each state and class."""
    to, emit = np.full((9, 12), _IN, np.intp), np.full((9, 12), POINT, np.uint8)
    to[:, _LINE], emit[:, _LINE] = _NEW, POINT | UNIT
    to[:, _OPEN] = _LT
    to[:, _LEAD2], to[:, _LEAD3], to[:, _LEAD4] = _MORE1, _MORE2, _MORE3
    emit[:, _CONT] = 0
    to[_MORE2, _CONT], to[_MORE3, _CONT] = _MORE1, _MORE2
    for letter, state, sentinel in ((_P, _LTP, P), (_S, _LTS, S), (_M, _LTM, M)):
        to[_LT, letter] = state
        emit[state, _SHUT] |= sentinel
    to[:, STOP], emit[:, STOP], emit[_NEW, STOP] = _NEW, UNIT, 0  # the text's end closes a unit that has no line end
    return to, emit


CLASS, (NEXT, EMIT) = _classes(), _tables()


def scan(kinds: np.ndarray, most_lanes: int = 4096) -> np.ndarray:
    """Emission of every transition over kinds (classes of bytes), in lanes of equal width."""
    n = len(kinds)
    lanes = max(1, min(most_lanes, n // 32))
    width = -(-n // lanes) if n else 0
    padded = np.full(lanes * width + _MEMORY, STOP, np.uint8)
    padded[_MEMORY : _MEMORY + n] = kinds
    to, emit = (NEXT * NEXT.shape[1]).ravel(), EMIT.ravel()
    state, out = np.zeros(lanes, np.intp), np.empty((width, lanes), np.uint8)
    for k in range(width + _MEMORY if n else 0):
        at = state + padded[k::width][:lanes]
        if k >= _MEMORY:
            out[k - _MEMORY] = emit[at]
        state = to[at]
    return out.T.reshape(-1)[:n]


class Scanned:
    """The emissions over a slice of texts. Places count a text's bytes and its STOP; text k begins at place start[k]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.n = n = len(offsets) - 1
        self.start = offsets + np.arange(n + 1)
        kinds = np.full(len(raw) + n, STOP, np.uint8)
        kinds[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = CLASS[raw]
        self.kinds, self.emitted = kinds, scan(kinds)

    def count(self, flag: int) -> np.ndarray:
        """Transitions of each text that emit flag."""
        total = np.concatenate([[0], np.cumsum((self.emitted & flag) != 0)])
        return total[self.start[1:]] - total[self.start[:-1]]

    def unit_ends(self, units: np.ndarray) -> np.ndarray:
        """The place in each text at which so many units end, counted from its start."""
        ends = np.flatnonzero(self.emitted & UNIT)
        before = np.searchsorted(ends, self.start[:-1])
        if not len(ends):
            return np.zeros(self.n, np.int64)
        last = ends[np.clip(before + units - 1, 0, len(ends) - 1)]
        return np.where(units > 0, last + (self.kinds[last] != STOP) - self.start[:-1], 0)

    def points(self) -> np.ndarray:
        """Code points before each place."""
        return np.concatenate([[0], np.cumsum(self.emitted & POINT, dtype=np.int64)])


def _strings(pieces: list[bytes], null: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(pieces), [valid, pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces))])


def _cut(batches: Iterator[pa.RecordBatch], rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, offsets = text_bytes(batch.column("text"))
        seen, whole = Scanned(raw, offsets), raw.tobytes()
        units = seen.count(UNIT)
        h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
        low, high = np.minimum(h1 % (units + 1), h2 % (units + 1)), np.maximum(h1 % (units + 1), h2 % (units + 1))
        a, b, size = seen.unit_ends(low), seen.unit_ends(high), np.diff(offsets)
        plain = (size == 0) | (seen.count(P | S | M) > 0) | (h3 % 100 >= rate)
        tail_first = h4 % 100 < spm
        points = seen.points()
        at = seen.start[:-1]
        ahead, inside = points[at + a] - points[at], points[at + b] - points[at + a]
        out = []
        for k in range(len(size)):
            text = whole[offsets[k] : offsets[k + 1]]
            head, mid, tail = text[: a[k]], text[a[k] : b[k]], text[b[k] :]
            out.append(text if plain[k] else b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, mid) if tail_first[k] else (PREFIX, head, SUFFIX, tail, MIDDLE, mid)))
        form = np.where(plain, "plain", np.where(tail_first, "spm", "psm"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(units.astype(np.int64)), pa.array(form.tolist(), pa.string()), pa.array(ahead, mask=plain), pa.array(inside, mask=plain), _strings(out)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null in plain texts) and output of every row of docs (doc_id, text).

    Of texts that can be cut ``rate`` of 100 are, of these ``spm`` of 100 with the suffix first. All draws come from the
    sha256 of seed and doc_id: any engine repeats them.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return keyed.mapInArrow(in_worker(lambda it: _cut(it, rate, spm)), schema)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(PREFIX)
    for batch in slices(batches, "output"):
        raw, offsets = text_bytes(batch.column("output"))
        seen, whole = Scanned(raw, offsets), raw.tobytes()
        hits = np.flatnonzero(seen.emitted & (P | S | M))
        first, count = np.searchsorted(hits, seen.start[:-1]), seen.count(P | S | M)
        back, bad = [], np.zeros(batch.num_rows, bool)
        for k, form in enumerate(batch.column("form").to_pylist()):
            text = whole[offsets[k] : offsets[k + 1]]
            if form == "plain":
                back.append(text)
                continue
            mine = hits[first[k] : first[k] + count[k]]
            one, two, three = (mine - seen.start[k] + 1).tolist() if count[k] == 3 else (0, 0, 0)  # where each sentinel ends
            if one != width or seen.emitted[mine].tolist() != [POINT | x for x in ((P, S, M) if form == "psm" else (S, P, M))]:
                bad[k] = True
                back.append(b"")
                continue
            ahead, behind, mid = text[one : two - width], text[two : three - width], text[three:]
            back.append(ahead + mid + behind if form == "psm" else behind + mid + ahead)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), _strings(back, bad)], [*batch.schema.names, "restored"])


def restore_middle(made: DataFrame) -> DataFrame:
    """Rows of made (form, output and any other columns but restored) with the text that each output was made of."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(in_worker(_join), f"{schema}, restored string")


def middle_digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """fill_in_middle with sha256 digests of each output and of the text restored from it."""
    back = restore_middle(fill_in_middle(docs, seed, rate, spm))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
