"""Public vocabularies, opened once in a worker; their paths are parameters."""

from __future__ import annotations

import base64
import os
import string

import numpy as np

from tessera.llm.chunks import SMALL_CACHE_CHUNKS, ChunkEncoder
from tessera.llm.common import ragged, remembered


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@remembered
def byte_bpe(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Chunks that a worker of the token store remembers, about 160 bytes each. 54 MB of check_l bring 868,116 new ones, the next 54 MB 510,876.
STORE_CACHE_CHUNKS = 1_500_000


#: Letters that every version of Unicode has as such; between one of these and punctuation a byte-level vocabulary cuts.
LETTERS = frozenset(c for a, b in (("A", "Z"), ("a", "z"), ("\u00c0", "\u024f"), ("\u0400", "\u0481")) for c in map(chr, range(ord(a), ord(b) + 1)) if c.isalpha())


class MarkedChunks(ChunkEncoder):
    """Chunks of a vocabulary with added tokens: a text that holds one (or a part of one that has spaces) is encoded whole.

    With ``cuts_tails`` the vocabulary has a cut between letters and punctuation: 'word,' has the ids of 'word' and those of ','.
    """

    def __init__(self, encode_chunks, encode_text, added: list[str], cuts_tails: bool = False):
        self.marks = sorted({max(x.split(" "), key=len) for x in added if x.strip()})
        self.cuts_tails = cuts_tails
        super().__init__(encode_chunks, encode_text, STORE_CACHE_CHUNKS)

    def _learn(self) -> None:
        if not self.cuts_tails:
            return super()._learn()
        new, at = self.index.new, len(self.index) - len(self.index.new)
        stems = [c.rstrip(string.punctuation) for c in new]
        joint = [k for k, (c, stem) in enumerate(zip(new, stems)) if len(stem) < len(c) and stem[-1:] in LETTERS and c[0] != "\x00"]
        stem = np.array([self.index[stems[k]] for k in joint], np.int64)  # adds those that are new
        super()._learn(joint)
        chunk = at + np.array(joint, np.int64)
        safe = self.safe[chunk]
        chunk, stem = chunk[safe], stem[safe]
        tails: dict[str, int] = {}
        kind = np.array([tails.setdefault(new[k][len(stems[k]) :], len(tails)) for k, ok in zip(joint, safe) if ok], np.int64)
        each = [np.asarray(self.encode_text(x), np.int32) for x in tails]
        if not each:
            return
        sizes = np.array([len(x) for x in each])
        n, m = self.length[stem].astype(np.int64), sizes[kind]
        begin = self.n_ids + np.cumsum(n + m) - (n + m)
        self._room(int((n + m).sum()))
        self.ids[ragged(begin, n)] = self.ids[ragged(self.start[stem], n)]
        self.ids[ragged(begin + n, m)] = np.concatenate(each)[ragged((np.cumsum(sizes) - sizes)[kind], m)]
        self.start[chunk], self.length[chunk] = begin, n + m
        self.n_ids += int((n + m).sum())

    def is_safe(self, chunk: str) -> bool:
        return super().is_safe(chunk) and not any(m in chunk for m in self.marks)

    def are_safe(self, chunks: list[str]) -> list[bool]:
        whole = " ".join(chunks)  # marks have no spaces
        if any(m in whole for m in self.marks):
            return super().are_safe(chunks)
        return [c != "" and not c[-1].isspace() and "\x00" not in c for c in chunks]


@remembered
def byte_bpe_chunks(path: str) -> ChunkEncoder:
    """The tokenizers library over distinct chunks: one call for all new ones, cut apart at the ids that open with a space."""
    tokenizer = byte_bpe(path)
    from tokenizers.pre_tokenizers import ByteLevel

    opens = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, k in tokenizer.get_vocab().items():
        opens[k] = token.startswith("Ġ")

    def text(x: str) -> list[int]:
        return tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids

    def chunks(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, length = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            got = np.array(text(" " + " ".join(part)), np.int32)
            begin = np.flatnonzero(opens[got])
            if len(begin) != len(part):  # a vocabulary with another use of the space: one by one
                each = [x.ids for x in tokenizer.encode_batch_fast([" " + x for x in part], add_special_tokens=False)]
                got, sizes = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])
            else:
                sizes = np.diff(np.append(begin, len(got)))
            ids.append(got)
            length.append(sizes)
        return np.concatenate(ids), np.concatenate(length)

    cut = tokenizer.pre_tokenizer
    cuts_tails = isinstance(cut, ByteLevel) and cut.use_regex and tokenizer.normalizer is None
    return MarkedChunks(chunks, text, [x.content for x in tokenizer.get_added_tokens_decoder().values()], cuts_tails)


@remembered
def ranked_bpe(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@remembered
def ranked_bpe_chunks(path: str) -> tuple[ChunkEncoder, np.ndarray]:
    """A chunk encoder of tiktoken, and for each id whether its bytes are a piece of a character (byte fallback)."""
    encoding, ranks = ranked_bpe(path)
    opens, part = np.zeros(max(ranks.values()) + 1, bool), np.zeros(max(ranks.values()) + 1, bool)
    for token, k in ranks.items():
        opens[k] = token[:1] == b" "
        try:
            token.decode()
        except UnicodeDecodeError:
            part[k] = True

    def chunks(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, length = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            got = np.array(encoding.encode_ordinary(" " + " ".join(some)), np.int32)
            begin = np.flatnonzero(opens[got])
            if len(begin) != len(some):
                each = [encoding.encode_ordinary(" " + x) for x in some]
                got, sizes = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])
            else:
                sizes = np.diff(np.append(begin, len(got)))
            ids.append(got)
            length.append(sizes)
        return np.concatenate(ids), np.concatenate(length)

    return ChunkEncoder(chunks, encoding.encode_ordinary, SMALL_CACHE_CHUNKS), part
