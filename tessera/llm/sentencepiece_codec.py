"""SentencePiece encoding and decoding by suffix-array matching.

The chunks of a batch that are new (cut at single spaces, each once) are laid end to end and indexed by a suffix array;
every piece of the model is looked up in it by binary search; the occurrences are the edges of a lattice, which are
sorted by the position where they end and relaxed in that order. The model merges pairs (BPE): a piece that ends a
prefix is the last piece of the prefix's encoding exactly if it and the piece before it stand when encoded together, so
relaxing keeps one piece for each prefix and gives what merging gives. Characters that no piece has become byte pieces.

Defined cases: null and empty texts have no pieces; texts with runs of spaces, or with the sign for a space, are matched
whole; decoding gives the text back, with the sign read as a space; repeated rows are encoded alike; a text longer than
a slice is a slice of its own, cut at spaces; an empty table gives no rows; other columns are not read. A model that isn't
BPE, or has pieces of more bytes than suffixes are sorted by, is an error: its encoding would come out otherwise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.chunks import SMALL_CACHE_CHUNKS, ChunkEncoder
from tessera.llm.common import in_worker, ragged, remembered, slices, strings
from tessera.llm.vocabularies import vocabulary_path

SIGN = "▁"
DEPTH = 4  # words of eight bytes to which suffixes are sorted; longer pieces are compared no further
#: Bytes of strings (one at least) that one suffix array indexes; its lattice takes a few hundred times this.
MATCH_BYTES = 64 << 10
_MEMO = 1 << 20


class PieceModel:
    """Pieces by rank: single characters first, then merges in the order in which the model prefers them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [(sp.id_to_piece(i), sp.get_score(i), i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
        chars = sorted((p for p in pieces if len(p[0]) == 1), key=lambda p: p[2])
        merges = sorted((p for p in pieces if len(p[0]) > 1), key=lambda p: (-p[1], p[2]))
        # merges of a BPE model are scored by their rank, in whole numbers; those of a unigram model by a log probability
        if any(p[1] != round(p[1]) for p in merges):
            raise ValueError("not a BPE model: the scores of its pieces are no ranks")
        self.unknown = len(chars)  # the rank of a character without a piece
        ranked = [p[0] for p in chars] + [None] + [p[0] for p in merges]
        self.id = np.array([p[2] for p in chars] + [-1] + [p[2] for p in merges], np.int32)
        rank = {p: k for k, p in enumerate(ranked) if p is not None}
        v = self.size = len(ranked)
        self.left, self.right = np.arange(v), np.arange(v)
        stands = np.ones(v, bool)
        for k in range(self.unknown + 1, v):
            two = self._last_merge(ranked[k], rank)
            if two is None:
                stands[k] = False
            else:
                self.left[k], self.right[k] = two
        pair = {}
        for k in range(self.unknown + 1, v):
            p = ranked[k]
            for cut in range(1, len(p)):
                a, b = rank.get(p[:cut]), rank.get(p[cut:])
                if a is not None and b is not None:
                    pair[a * v + b] = k
        self.pair_key = np.array(sorted(pair), np.int64)
        self.pair_rank = np.array([pair[k] for k in self.pair_key.tolist()], np.int64)
        self.bytes = [(p or "").replace(SIGN, " ").encode() for p in ranked]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        long = [ranked[k] for k in range(v) if k != self.unknown and stands[k] and len(self.bytes[k]) > 8 * DEPTH]
        if long:
            raise ValueError(f"the model has {len(long)} pieces of more than {8 * DEPTH} bytes, such as {long[0]!r}")
        usable = np.array([k for k in range(v) if k != self.unknown and stands[k]], np.int64)
        self.usable = usable
        self.low, self.high = (np.zeros((len(usable), DEPTH), np.uint64) for _ in range(2))
        for row, k in enumerate(usable):
            self.low[row] = np.frombuffer(self.bytes[k].ljust(8 * DEPTH, b"\0"), ">u8")
            self.high[row] = np.frombuffer(self.bytes[k].ljust(8 * DEPTH, b"\xff"), ">u8")
        self.char_key = np.sort(np.array([int.from_bytes(b, "big") for b in self.bytes[: self.unknown]], np.int64))
        self.memo_key, self.memo_ok = np.full(_MEMO, -1, np.int64), np.zeros(_MEMO, bool)
        decoded = {int(self.id[k]): self.bytes[k] for k in range(v) if k != self.unknown}
        self.decoded = [decoded.get(i, b"") for i in range(n)]
        for b, i in enumerate(self.byte_id):
            self.decoded[i] = bytes([b])

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that merge last when the piece's own characters are merged; None if it doesn't come out whole."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 40), i))
            if parts[best] + parts[best + 1] not in rank:
                return None
            if len(parts) == 2:
                return (rank[parts[0]], rank[parts[1]]) if parts[0] in rank and parts[1] in rank else None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return None

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], 1 << 40)

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay two pieces when merged together: no merge across their border comes before those inside."""
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        a, b = a.copy(), b.copy()
        while len(live):
            go = self._merged(a, b) >= limit
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            # undo the later of the two: the piece that was made last is opened at the border
            first = a > b
            opened_a, opened_b = self.right[a], self.left[b]
            stuck_a, stuck_b = opened_a == a, opened_b == b
            do_a = (first & ~stuck_a) | (~first & stuck_b & ~stuck_a)
            do_b = (~first & ~stuck_b) | (first & stuck_a & ~stuck_b)
            done = ~do_a & ~do_b
            out[live[done]] = True
            limit = np.where(do_a, a, np.where(do_b, b + 1, limit))
            a, b = np.where(do_a, opened_a, a), np.where(do_b, opened_b, b)
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return out

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO.bit_length() + 1)).astype(np.int64)
        out = self.memo_ok[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            ok = self._stand(new // self.size, new % self.size)
            out[miss] = ok[back]
            self.memo_key[slot[miss]], self.memo_ok[slot[miss]] = key[miss], ok[back]
            # two keys of one call may share a slot: what was written last must be of one key
            wrong = miss[self.memo_key[slot[miss]] != key[miss]]
            self.memo_key[slot[wrong]] = -1
        return out


def suffix_array(raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by the first 8 * DEPTH bytes from there on, and those bytes as DEPTH numbers for each position."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8 * DEPTH + 8, np.uint8)])
    word = np.zeros(n + 8 * DEPTH, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    words = [word[8 * k : 8 * k + n] for k in range(DEPTH)]
    order = np.argsort(words[0])
    first = words[0][order]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(tied):
        at = order[tied]
        order[tied] = at[np.lexsort([words[k][at] for k in range(DEPTH - 1, -1, -1)])]
    return order, words


def _bounds(order: np.ndarray, words: list[np.ndarray], keys: np.ndarray, side: str) -> np.ndarray:
    """Binary search of many keys: the first place whose suffix is not below the key (left), or above it (right)."""
    first = words[0][order]
    lo, hi = np.searchsorted(first, keys[:, 0], "left"), np.searchsorted(first, keys[:, 0], "right")
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        at = order[mid]
        below = np.zeros(len(live), bool)
        tie = np.ones(len(live), bool)
        for k in range(1, len(words)):
            w, key = words[k][at], keys[live, k]
            below |= tie & (w < key)
            tie &= w == key
        go = below | tie if side == "right" else below
        lo[live] = np.where(go, mid + 1, lo[live])
        hi[live] = np.where(go, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def match_pieces(model: PieceModel, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of strings that are laid end to end (spaces for the sign), and how many each has."""
    n = len(offsets) - 1
    order, words = suffix_array(raw)
    lo = _bounds(order, words, model.low, "left")
    # a piece shorter than the key's width: the range ends where its bytes followed by the highest do
    hi = _bounds(order, words, model.high, "right")
    count = hi - lo
    start = order[ragged(lo, count)]
    piece = np.repeat(model.usable, count)
    string_end = np.repeat(offsets[1:], np.diff(offsets))
    inside = start + model.length[piece] <= string_end[start]
    start, piece = start[inside], piece[inside]
    size = model.length[piece]
    # characters that no piece has
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    width = np.diff(np.append(lead, len(raw)))
    code = np.zeros(len(lead), np.int64)
    for k in range(4):
        has = width > k
        code[has] = code[has] << 8 | raw[lead[has] + k]
    strange = ~np.isin(code, model.char_key)
    start = np.concatenate([start, lead[strange]])
    piece = np.concatenate([piece, np.full(int(strange.sum()), model.unknown)])
    size = np.concatenate([size, width[strange]])

    begin = np.repeat(offsets[:-1], np.diff(offsets))[start]
    level = start + size - begin
    by_end = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 65536 else level, kind="stable")
    start, piece, size, begin, level = start[by_end], piece[by_end], size[by_end], begin[by_end], level[by_end]
    last, back = np.full(len(raw) + 1, -1, np.int64), np.zeros(len(raw) + 1, np.int64)
    cuts = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        s, p = start[a:b], piece[a:b]
        opens = s == begin[a:b]
        before = last[s]
        ok = opens | (before >= 0)
        check = np.flatnonzero(ok & ~opens)
        ok[check] = model.stand(before[check], p[check])
        e = s[ok] + size[a:b][ok]
        last[e], back[e] = p[ok], size[a:b][ok]
    # back from the end of every string; the end of one is the start of the next, whose own states lie further on
    taken_at, taken, owner = [], [], []
    live = np.flatnonzero(offsets[1:] > offsets[:-1])
    at = offsets[1:][live]
    while len(live):
        taken.append(last[at])
        step = back[at]
        at = at - step
        taken_at.append(at)
        owner.append(live)
        more = at > offsets[live]
        live, at = live[more], at[more]
    if not taken:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    p, s, o = np.concatenate(taken), np.concatenate(taken_at), np.concatenate(owner)
    in_order = np.argsort(s, kind="stable")
    p, s, o = p[in_order], s[in_order], o[in_order]
    strange = p == model.unknown
    reps = np.where(strange, np.append(s[1:], len(raw)) - s, 1)
    ids = np.repeat(model.id[p], reps)
    where = ragged(s, reps)
    wild = np.repeat(strange, reps)
    ids[wild] = model.byte_id[raw[where[wild]]]
    return ids, np.bincount(o, weights=reps, minlength=n).astype(np.int64)


class PieceChunks(ChunkEncoder):
    """Chunks after a space and chunks that open a text alike start with the model's sign."""

    opening = False

    def __init__(self, model: PieceModel):
        self.model = model
        super().__init__(self._chunks, self._text, SMALL_CACHE_CHUNKS)

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [(" " + t.replace(SIGN, " ")).encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
        ids, counts, at = [], [], 0
        while at < len(encoded):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MATCH_BYTES, side="right")) - 1)
            part = match_pieces(self.model, np.frombuffer(b"".join(encoded[at:end]), np.uint8), offsets[at : end + 1] - offsets[at])
            ids.append(part[0])
            counts.append(part[1])
            at = end
        return np.concatenate(ids), np.concatenate(counts)

    def _chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._run(new) if new else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _text(self, text: str) -> np.ndarray:
        return self._run([text])[0]

    def is_safe(self, chunk: str) -> bool:
        return bool(chunk) and SIGN not in chunk


@remembered
def piece_chunks(path: str) -> PieceChunks:
    return PieceChunks(PieceModel(path))


def encode_texts(texts: list[str], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each."""
    return piece_chunks(path or vocabulary_path("piece_bpe_32k.model"))(texts)


def decode_ids(ids: np.ndarray, path: str | None = None) -> str:
    """The text of one document's ids, without the space that encoding puts first."""
    table = piece_chunks(path or vocabulary_path("piece_bpe_32k.model")).model.decoded
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row of docs (doc_id, text)."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, counts = piece_chunks(path)(strings(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(in_worker(run, "piece_chunks"), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of encoded (doc_id, ids)."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x or [], path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(in_worker(run, "piece_chunks"), "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (ids as little-endian 32-bit integers), text_crc32 of the decoded text and exact (decoding gives the text back) of every row."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chunks = piece_chunks(path)
            texts = strings(batch.column("text"))
            ids, counts = chunks(texts)
            ends = np.cumsum(counts)
            is_byte = np.zeros(len(chunks.model.decoded), bool)
            is_byte[chunks.model.byte_id] = True
            wild = np.concatenate([[0], np.cumsum(is_byte[ids])])
            view = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
            table = chunks.model.decoded
            parts = [table[i] for i in ids.tolist()]
            crc, text_crc, exact = [], [], []
            for a, b, text in zip((ends - counts).tolist(), ends.tolist(), texts):
                back = b"".join(parts[a:b])[1:]
                crc.append(zlib.crc32(view[4 * a : 4 * b]))
                text_crc.append(zlib.crc32(back))
                exact.append(back == text.replace(SIGN, " ").encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(wild[ends] - wild[ends - counts]), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(exact, pa.bool_())],
                ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "text_crc32", "exact"],
            )

    return docs.select("doc_id", "text").mapInArrow(in_worker(run, "piece_chunks"), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, text_crc32 long, exact boolean")
