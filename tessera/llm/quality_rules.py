"""Quality rules by tokeniser fertility.

Public vocabularies encode every whole text; characters per token, the share of byte-fallback tokens and the entropy
of the tokens are held against bands of the text's language, or of its script where the language has none.

Defined cases: a null, empty or blank text has zero counts, fails the base rules and is rejected; a text in a language
without a band is held to the band of its script; a figure on the edge of a band passes; repeated rows are judged alike; a
text longer than a slice is a slice of its own; an empty table gives no rows; other columns are ignored, and keep_good
keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_worker, slices, strings
from tessera.llm.text_statistics import base_statistics
from tessera.llm.vocabularies import ranked_bpe_chunks, vocabulary_path


@dataclass(frozen=True)
class Band:
    """A text passes with low <= characters per token <= high, byte share <= most_bytes and evenness >= least_even.

    Evenness is the entropy of a text's tokens over the greatest that its number of tokens allows (at most 2^even_bits kinds).
    Short texts vary more than low and high allow. Where the spread of good text is known, a text of n tokens outside them
    passes as well if it lies within RADIUS deviations of good text of its length, both figures together: characters per
    token deviate from mean by SPREAD / sqrt(n), evenness from even - slope * min(log2(n) - EVEN_BITS, 0) by even_spread.
    """

    low: float
    high: float
    most_bytes: float
    least_even: float
    mean: float = np.nan
    even: float = np.nan
    slope: float = np.nan
    even_spread: float = np.nan


#: Bands of the default vocabulary and the spread of labelled good text of each language: what fit_bands gives on sf0.1, with ends moved by hand (see README).
BANDS: Mapping[str, Band] = {
    "en": Band(2.30, 3.20, 0.05, 0.705, 2.664, 0.737, 0.055, 0.0125),
    "fr": Band(1.95, 2.70, 0.25, 0.675, 2.201, 0.706, 0.062, 0.015),
    "de": Band(2.15, 2.85, 0.15, 0.695, 2.387, 0.717, 0.060, 0.014),
    "es": Band(1.90, 2.70, 0.25, 0.665, 2.092, 0.7045, 0.057, 0.020),
}
SCRIPT_BANDS: Mapping[str, Band] = {"latin": Band(1.5, 6.0, 0.3, 0.6), "other": Band(0.2, 4.0, 1.0, 0.4)}
EVEN_BITS = 9
#: Deviation of characters per token times the root of the number of tokens (alike in all four languages), and how many deviations pass.
SPREAD, RADIUS = 1.2, 4.6
_OPEN = ("ranked_bpe", "ranked_bpe_chunks")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, evenness double, band string"


def _measure(batches: Iterator[pa.RecordBatch], vocabularies, bands, script_bands) -> Iterator[pa.RecordBatch]:
    table = {k: v for k, v in [*bands.items(), *script_bands.items()]}
    for batch in slices(batches):
        text = batch.column("text")
        base = base_statistics(text)
        n, offsets, raw, points = batch.num_rows, base["offsets"], base["raw"], base["points"]
        n_chars = points[offsets[1:]] - points[offsets[:-1]]
        texts = strings(text)
        tokens = np.zeros(n)
        fallback, entropy, most = np.zeros(n), np.zeros(n), np.zeros(n)
        for path in vocabularies:  # several vocabularies count as the mean of what each measures
            encoder, part = ranked_bpe_chunks(path)
            ids, count = encoder(texts)
            owner = np.repeat(np.arange(n), count)
            tokens += count / len(vocabularies)
            fallback += np.bincount(owner, weights=part[ids], minlength=n) / np.maximum(count, 1) / len(vocabularies)
            key = np.sort(owner * np.int64(len(part)) + ids)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(key)))
            who = key[head] // len(part)
            total = np.maximum(count, 1)
            entropy += (np.log2(total) - np.bincount(who, weights=times * np.log2(np.maximum(times, 1)), minlength=n) / total) / len(vocabularies)
            most += np.minimum(np.log2(total), EVEN_BITS) / len(vocabularies)
        per_token = n_chars / np.maximum(tokens, 1e-9) * (tokens > 0)
        even = np.where(most > 0, entropy / np.maximum(most, 1e-9), 1.0)
        wide = np.bincount(np.searchsorted(offsets, np.flatnonzero(raw >= 0xD0), side="right") - 1, minlength=n)[:n]
        script = np.where(2 * wide > n_chars, "other", "latin")
        lang = [x if x in bands else s for x, s in zip(batch.column("lang").to_pylist(), script)]
        low, high, bytes_, least, mean, usual, slope, spread = (np.array([getattr(table[x], k) for x in lang]) for k in ("low", "high", "most_bytes", "least_even", "mean", "even", "slope", "even_spread"))
        size = np.maximum(tokens, 1)
        off = (per_token - mean) * np.sqrt(size) / SPREAD
        uneven = np.minimum(even - usual + slope * np.minimum(np.log2(size) - EVEN_BITS, 0), 0) / spread
        near = off**2 + uneven**2 <= RADIUS**2  # false where a band has no spread
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        passed = (((low <= per_token) & (per_token <= high)) | near) & (fallback <= bytes_) & (even >= least)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & passed), pa.array(np.round(tokens).astype(np.int64)), pa.array(per_token), pa.array(fallback), pa.array(entropy), pa.array(even), pa.array(lang, pa.string())],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )


def quality_rules(docs: DataFrame, vocabularies: list[str] | None = None, bands: Mapping[str, Band] = BANDS, script_bands: Mapping[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): its counts, base_failed, kept and what the vocabularies measure."""
    paths = tuple(vocabularies or [vocabulary_path("byte_bpe_50k.tiktoken")])
    bands, script_bands = dict(bands), dict(script_bands)
    return docs.select("doc_id", "text", "lang").mapInArrow(in_worker(lambda it: _measure(it, paths, bands, script_bands), *_OPEN), SCHEMA)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; texts are read once and no row is shuffled."""
    columns, schema = docs.columns, docs.schema
    paths = tuple(options.get("vocabularies") or [vocabulary_path("byte_bpe_50k.tiktoken")])
    bands, script_bands = dict(options.get("bands", BANDS)), dict(options.get("script_bands", SCRIPT_BANDS))

    def keep(batches):
        for batch in slices(batches):
            for verdict in _measure(iter([batch.select(["doc_id", "text", "lang"])]), paths, bands, script_bands):
                yield batch.filter(verdict.column("kept"))

    return docs.select(*columns).mapInArrow(in_worker(keep, *_OPEN), schema)


def fit_bands(docs: DataFrame, labels: DataFrame, least_rows: int = 50, margin: float = 0.1, vocabularies: list[str] | None = None) -> dict[str, Band]:
    """Bands of each language from the good texts (labels: doc_id, quality) that pass the base rules; a language of fewer than least_rows has none.

    Ends are the least and greatest figures seen, with a share margin of their distance from the mean on top; the spread
    of short texts is the line of evenness over the logarithm of their tokens, and the deviation around it. One aggregate.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rows = quality_rules(docs, vocabularies).where("not base_failed and n_tokens > 0").join(good, "doc_id", "left_semi").join(docs.select("doc_id", F.col("lang").alias("_lang")).distinct(), "doc_id").where("_lang is not null")
    short = F.least(F.log2("n_tokens") - EVEN_BITS, F.lit(0.0))
    line = rows.withColumn("_x", short).groupBy("_lang").agg(
        F.count("*").alias("n"), F.avg("chars_per_token").alias("mean"), F.min("chars_per_token").alias("low"), F.max("chars_per_token").alias("high"), F.max("byte_share").alias("bytes"), F.min("evenness").alias("least"),
        F.coalesce(F.regr_slope("evenness", "_x"), F.lit(0.0)).alias("slope"), F.avg("evenness").alias("even"), F.avg("_x").alias("x"), F.sqrt(F.greatest(F.regr_syy("evenness", "_x") / F.count("*") * (1 - F.coalesce(F.regr_r2("evenness", "_x"), F.lit(0.0))), F.lit(0.0))).alias("spread"),
    )
    out = {}
    for r in line.where(F.col("n") >= least_rows).collect():  # one row a language
        out[r["_lang"]] = Band(r["low"] - margin * (r["mean"] - r["low"]), r["high"] + margin * (r["high"] - r["mean"]), r["bytes"] * (1 + margin), r["least"] - margin * (r["even"] - r["least"]), r["mean"], r["even"] - r["slope"] * r["x"], -r["slope"], max(r["spread"], 1e-3))
    return out


def rejection_report(verdicts: DataFrame) -> DataFrame:
    """Rows and rejections of each band."""
    return verdicts.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_base_failed"), F.sum((~F.col("kept")).cast("long")).alias("n_rejected"))
