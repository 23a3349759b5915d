"""Exact per-document statistics of whole texts, vectorised over a slice of an Arrow batch."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import Hasher, text_bytes, words

SYMBOLS = "#*$%&|<>"
_FLAG = {name: np.zeros(256, bool) for name in ("symbol", "upper", "digit", "mark", "letter")}
_FLAG["symbol"][[ord(c) for c in SYMBOLS]] = True
_FLAG["upper"][65:91] = True
_FLAG["digit"][48:58] = True
_FLAG["mark"][[ord(c) for c in ".,;:!?"]] = True
_FLAG["letter"][65:91] = True
_FLAG["letter"][97:123] = True
_FLAG["letter"][128:] = True


def per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its owner has an equal one before it, and whether it has an equal one at all."""
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    later, any_ = np.zeros(len(v), bool), np.zeros(len(v), bool)
    later[order[1:][same]] = True  # lexsort is stable: the first of equal ones comes first
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def base_statistics(column) -> dict[str, np.ndarray]:
    """Counts of each text of an Arrow string column; null and empty texts have zeros.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (those equal to an
    earlier one), n_repeat_words (words in three-word windows that the text has twice or more), n_distinct_words,
    n_chars, n_upper, n_digits, n_marks, n_letters, n_single (one-byte words).
    """
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    start, end, doc = words(raw, offsets)
    hasher = Hasher(raw)
    value = hasher(start, end)
    count = np.bincount(doc, minlength=n)
    lead = (raw & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    out = {"n_words": count, "word_chars": np.bincount(doc, weights=points[end] - points[start], minlength=n).astype(np.int64), "n_symbols": per_doc(_FLAG["symbol"][raw], offsets)}

    # lines: cut at each \n and at the ends of texts; those without a word don't count
    breaks = np.flatnonzero(raw == 10)
    full = offsets[:-1] < offsets[1:]
    begin = np.union1d(breaks + 1, offsets[:-1][full])
    begin = begin[begin < len(raw)]
    stop = np.append(begin[1:], len(raw))[: len(begin)]
    cut = stop - ((stop > begin) & (raw[stop - 1] == 10)) if len(stop) else stop
    inked = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(raw) + 1)[: len(raw)])]) if len(raw) else np.zeros(1)
    with_word = inked[cut] > inked[begin] if len(begin) else np.zeros(0, bool)
    begin, cut = begin[with_word], cut[with_word]
    line_doc = np.searchsorted(offsets, begin, side="right") - 1
    later, _ = repeated(hasher(begin, cut), line_doc)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc, weights=later, minlength=n).astype(np.int64)

    in_window = np.zeros(len(value), bool)
    if len(value) > 2:
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        triple = value[:-2] * np.uint64(0x9E3779B97F4A7C15) + value[1:-1]
        triple = triple * np.uint64(0xD6E8FEB86659FD93) + value[2:]
        _, again = repeated(triple[whole], doc[whole])
        for k in range(3):
            in_window[whole[again] + k] = True
    out["n_repeat_words"] = np.bincount(doc, weights=in_window, minlength=n).astype(np.int64)
    out["raw"], out["offsets"], out["points"] = raw, offsets, points
    out["words"] = (start, end, doc, value)
    return out


def quality_statistics(column) -> dict[str, np.ndarray]:
    """base_statistics and the counts that the quality classifier uses besides."""
    out = base_statistics(column)
    raw, offsets, points = out.pop("raw"), out.pop("offsets"), out.pop("points")
    start, end, doc, value = out.pop("words")
    n = len(offsets) - 1
    later, _ = repeated(value, doc)
    out["n_distinct_words"] = np.bincount(doc, weights=~later, minlength=n).astype(np.int64)
    out["n_chars"] = points[offsets[1:]] - points[offsets[:-1]]
    for name, flag in (("n_upper", "upper"), ("n_digits", "digit"), ("n_marks", "mark"), ("n_letters", "letter")):
        out[name] = per_doc(_FLAG[flag][raw], offsets)
    out["n_single"] = np.bincount(doc, weights=(end - start) == 1, minlength=n).astype(np.int64)
    return out
