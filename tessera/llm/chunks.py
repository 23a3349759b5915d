"""Token ids of whole texts through a bounded cache of space-separated chunks.

A vocabulary whose pieces never run on across a space that follows ink encodes each chunk on its own. A text for
which that does not hold (runs of spaces, a chunk that ends in white space) goes through the whole-text encoder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import ragged

#: Chunks that one worker remembers before it starts anew; about 150 bytes each.
CACHE_CHUNKS = 700_000
#: The same where encoding is quick; workers live on from one stage to the next and keep what they remember.
SMALL_CACHE_CHUNKS = 100_000


class _Index(dict):
    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class ChunkEncoder:
    """encode_chunks(list of chunks, each to be read after one space) gives (ids, lengths); encode_text takes a whole text.

    encode_first takes chunks that open a text.
    """

    #: Whether a chunk that opens a text is encoded otherwise than one after a space.
    opening = True

    def __init__(self, encode_chunks: Callable, encode_text: Callable, limit: int = CACHE_CHUNKS):
        self.encode_chunks, self.encode_text, self.limit = encode_chunks, encode_text, limit
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.safe = np.zeros(1 << 14, bool)
        self.n_ids = 0

    def is_safe(self, chunk: str) -> bool:
        """Whether the chunk is encoded alike whatever stands around it."""
        return bool(chunk) and not chunk[-1].isspace() and "\x00" not in chunk

    def are_safe(self, chunks: list[str]) -> list[bool]:
        """is_safe of each chunk."""
        return [self.is_safe(c) for c in chunks]

    def _room(self, more: int) -> None:
        while self.n_ids + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def _learn(self, later: list[int] | tuple = ()) -> None:
        """Encodes new chunks, but not those at ``later`` among them."""
        new = self.index.new
        if not new:
            return
        at = len(self.index) - len(new)
        safe = np.array(self.are_safe(new), bool)
        now = safe.copy()
        now[list(later)] = False
        ids, length = self.encode_chunks([c for c, ok in zip(new, now) if ok])
        full = np.zeros(len(new), np.int32)
        full[now] = length
        while len(self.index) > len(self.start):
            self.start, self.length, self.safe = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.safe))
        self._room(len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[at : at + len(new)] = self.n_ids + np.cumsum(full) - full
        self.length[at : at + len(new)] = full
        self.safe[at : at + len(new)] = safe
        self.n_ids += len(ids)
        self.index.new = []

    def _learn_with_heads(self) -> None:
        """Also the chunks that open a text."""
        heads = [c for c in self.index.new if self.opening and c.startswith("\x00 ")]
        if heads:
            opening = {c: self.encode_text(c[2:]) for c in heads if self.is_safe(c[2:])}
            self._learn()
            for c in heads:
                k = self.index[c]
                if c in opening:
                    ids = np.asarray(opening[c], np.int32)
                    self._room(len(ids))
                    self.ids[self.n_ids : self.n_ids + len(ids)] = ids
                    self.start[k], self.length[k], self.safe[k] = self.n_ids, len(ids), True
                    self.n_ids += len(ids)
        else:
            self._learn()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        if len(self.index) > self.limit:
            self.clear()
        look, found = self.index.__getitem__, []
        for text in texts:
            # the opening chunk has no space before it: it is kept under a name that no other chunk has
            cut = text.split(" ")
            if self.opening:
                cut[0] = "\x00 " + cut[0]
            found.append(np.fromiter(map(look, cut), np.int64, len(cut)))
        self._learn_with_heads()
        out, counts = [], np.zeros(len(texts), np.int64)
        for i, (text, at) in enumerate(zip(texts, found)):
            if not text:
                continue
            if self.safe[at].all():
                length = self.length[at]
                ids = self.ids[ragged(self.start[at], length)]
            else:
                ids = np.asarray(self.encode_text(text), np.int32)
            counts[i] = len(ids)
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for a column of strings (null: empty), whose chunks are told apart in Arrow, so that each is looked up once a column."""
        if len(self.index) > self.limit:
            self.clear()
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        first = cut.offsets.to_numpy()[:-1]  # every text has a chunk
        coded = cut.flatten().dictionary_encode()
        chunks, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        look = self.index.__getitem__
        at = np.fromiter(map(look, chunks), np.int64, len(chunks))[code]
        if self.opening:
            at[first] = [look("\x00 " + chunks[k]) for k in code[first]]
        self._learn_with_heads()
        length = self.length[at]
        odd = np.flatnonzero(~np.logical_and.reduceat(self.safe[at], first))
        for k in odd:
            length[first[k] : first[k + 1] if k + 1 < len(first) else None] = 0
        counts = np.add.reduceat(length, first, dtype=np.int64)
        ids = self.ids[ragged(self.start[at], length)]
        if len(odd):
            whole = [np.asarray(self.encode_text(texts[k].as_py() or ""), np.int32) for k in odd.tolist()]
            ids = np.concatenate([x for pair in zip(np.split(ids, np.cumsum(counts)[odd]), [*whole, ids[:0]]) for x in pair])
            counts[odd] = [len(x) for x in whole]
        return ids, counts
