"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte bigrams and trigrams of its letters; every language has several
centroids (spherical k-means); the language of the centroid with the greatest cosine wins. A text further from it than
nearly all its training texts were is marked rejected.

Defined cases: a null text, or one without a letter, is "und" with score 0 and rejected; so is every text when nothing
was learned; ties go to the first language in alphabetical order; repeated rows are predicted alike; a text longer than a
slice is a slice of its own; an empty table gives no rows; other columns are not read. More than MOST_LANGUAGES different
values of lang are an error: they name no languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices, strings, text_bytes

DIM = 4096
#: Training texts of each language whose vectors the centroids come from, about; document frequencies count all of them.
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
#: Languages at most; the driver holds a sample of SAMPLE_PER_LANGUAGE vectors of each.
MOST_LANGUAGES = 1_000
_BLOCK = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:65] = _LOWER[91:97] = _LOWER[123:128] = 0x20


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of n-gram counts of a block of texts."""
    n = len(offsets) - 1
    low = _LOWER[raw].astype(np.uint32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * DIM, np.int64)
    for k in (2, 3):
        if len(low) < k:
            continue
        code = np.full(len(low) - k + 1, k, np.uint32)
        for j in range(k):
            code = (code << np.uint32(8)) | low[j : len(low) - k + 1 + j]
        whole = owner[: len(code)] == owner[k - 1 :]
        blank = np.uint32(k << 8 * k | sum(0x20 << 8 * j for j in range(k)))
        whole &= code != blank
        code = code * np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        bucket = (code >> np.uint32(20)).astype(np.int64) + owner[: len(code)] * DIM
        out += np.bincount(bucket[whole], minlength=n * DIM)
    return out.reshape(n, DIM)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    raw, offsets = text_bytes(batch.column("text"))
    for a in range(0, batch.num_rows, _BLOCK):
        b = min(batch.num_rows, a + _BLOCK)
        yield a, b, _counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


@dataclass
class Centroids:
    languages: list[str]
    vectors: np.ndarray  # normalised, one row a centroid
    owner: np.ndarray  # index of its language
    idf: np.ndarray
    least: np.ndarray  # of each language: texts with a lower cosine are rejected

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(counts.astype(np.float32)) * self.idf)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of at most k clusters of normalised rows; starts at rows far from each other."""
    centre = _normal(x.mean(0, keepdims=True))
    picks = [int(np.argmax(x @ centre[0]))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        who = np.argmax(x @ c.T, 1)
        c = np.stack([x[who == j].mean(0) if (who == j).any() else c[j] for j in range(len(c))])
        c = _normal(c)
    return _normal(np.concatenate([c, centre]))


def fit_languages(docs: DataFrame, learn: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Centroids:
    """Learns from text and lang of the rows where learn holds and lang isn't null: document frequencies of all, centroids of a sample."""
    rows = docs.select("text", "lang", F.xxhash64("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_h"), (F.lit(True) if learn is None else learn).alias("_learn")).where("_learn and lang is not null and text is not null").drop("_learn")
    totals = {r["lang"]: r["n"] for r in docs.select("lang", (F.lit(True) if learn is None else learn).alias("_learn")).where("_learn and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rate = {k: min(1.0, per_language / n) for k, n in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in slices(batches):
            lang = batch.column("lang").to_pylist()
            place = (batch.column("_h").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
            for a, b, counts in _blocks(batch):
                df += (counts > 0).sum(0)
                n += b - a
                for i in range(a, b):
                    if place[i] < rate.get(lang[i], 0) and (some := np.flatnonzero(counts[i - a])).size:
                        yield _row(lang[i], 1, some, counts[i - a][some])
        yield _row(None, n, np.arange(DIM), df)

    def _row(lang, n, index, value):
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([index.astype(np.int32)], pa.list_(pa.int32())), pa.array([value.astype(np.int64)], pa.list_(pa.int64()))], ["lang", "n", "index", "value"])

    got = materialize(rows.mapInArrow(run, "lang string, n long, index array<int>, value array<long>"), "language-vectors")
    partial = got.where("lang is null")
    n = partial.agg(F.sum("n")).first()[0] or 0
    df = np.zeros(DIM)
    for r in partial.select(F.posexplode("value").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():  # DIM rows
        df[r["k"]] = r["v"]
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    sample = got.where("lang is not null").orderBy("lang", "index", "value").collect()  # about per_language rows a language
    languages = sorted({r["lang"] for r in sample})
    vectors, owner, least = [np.zeros((0, DIM), np.float32)], [], []
    for k, language in enumerate(languages):
        own = [r for r in sample if r["lang"] == language]
        x = np.zeros((len(own), DIM), np.float32)
        for i, r in enumerate(own):
            x[i, r["index"]] = r["value"]
        x = _normal(np.log1p(x) * idf)
        c = spherical_kmeans(x, CENTROIDS).astype(np.float32)
        vectors.append(c)
        owner += [k] * len(c)
        least.append(0.7 * float(np.quantile((x @ c.T).max(1), 0.01)))
    return Centroids(languages, np.concatenate(vectors), np.array(owner, np.int64), idf, np.array(least))


def predict_languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CENTROIDS + 1 vectors of DIM floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            lang, score, rejected = [], [], []
            ok = [has_letter(t) for t in strings(batch.column("text"))]
            for a, b, counts in _blocks(batch):
                if not m.languages:
                    lang, score, rejected = lang + ["und"] * (b - a), score + [0.0] * (b - a), rejected + [True] * (b - a)
                    continue
                cosine = m.weigh(counts) @ m.vectors.T
                best = cosine.argmax(1)
                who = m.owner[best]
                s = np.clip(cosine[np.arange(b - a), best], 0, 1)
                lang += [m.languages[w] if ok[a + i] else "und" for i, w in enumerate(who)]
                score += [float(v) if ok[a + i] else 0.0 for i, v in enumerate(s)]
                rejected += [not ok[a + i] or bool(v < m.least[w]) for i, (v, w) in enumerate(zip(s, who))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


__all__ = ["Centroids", "fit_languages", "has_letter", "predict_languages", "spherical_kmeans"]
