"""Odd rows through every operator and pipeline stage: clashing names, nulls, empty tables, ties, repeats, texts over a slice."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontamination, language_id, license_scan, ngram_join, quality_rules, rule_ensemble, sentencepiece_codec, sharding, suffix_dedup, token_store

#: Names that operators use inside; a table of documents may have them, too.
CLASHING = ["_hit", "_drop", "kept_text", "_later", "_contaminated", "_sha_of_row", "_sha", "_kept_text", "_short_sha", "sha", "tid", "words", "row", "_rep", "label", "n", "start", "_doc", "_row", "score", "shard", "_bucket", "cells", "spans", "node", "path_"]


def prose(n, seed, size=5000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})


ROWS = [(1, prose(80, 1), "en", "s", 1), (1, prose(80, 1), "en", "s", 1), (2, None, None, None, None), (3, "", "en", "", 0), (None, prose(60, 2), None, None, None), (None, None, None, None, None), (4, prose(80, 3) + " tail", "de", "s", 3), (4, "another text under the same id", "de", "s", 3)]


def test_operators_survive_clashing_names_and_nulls(spark):
    docs = table(spark, ROWS)
    items = spark.createDataFrame([(1, prose(80, 3)), (None, "x y z a b c"), (2, None)], "item_id long, text string").withColumn("h", F.lit(1)).withColumn("words", F.lit(2))
    n = len(ROWS)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_matches(docs, items).collect()} == {(4, 1)}
    for made in (sentencepiece_codec.encoding_digests(docs), quality_rules.quality_rules(docs), token_store.tokens_round_trip(docs), sharding.shard_records(docs), suffix_dedup.dedup_substrings(docs), ngram_join.jaccard_join(docs), language_id.predict_languages(docs, language_id.fit_languages(docs)), rule_ensemble.score_quality(docs, rule_ensemble.fit_quality(docs, spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")))):
        got = collections.Counter(r["doc_id"] for r in made.collect())
        assert got == collections.Counter(r[0] for r in ROWS), made.columns
    files = docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).withColumn("_of", F.lit(1)).withColumn("_folder", F.lit(2))
    assert license_scan.inherit_licenses(license_scan.scan_licenses(files)).count() == n


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_and_empty_tables(spark, tmp_path, stage):
    name, run = corpus_pipeline.STAGES[stage]
    spark.createDataFrame([(1, prose(80, 3))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, ROWS)
    got = run(spark, docs, str(tmp_path))
    if stage < 4:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        rows = got.collect()
        assert all(r[c] == k for r in rows for k, c in enumerate(CLASHING))
        ids = collections.Counter(r["doc_id"] for r in rows)
        if name in ("near duplicates", "benchmark leaks"):
            assert ids[None] == 2 and ids[2] == ids[3] == 1
    else:
        assert got.count() == len(ROWS)
    none = run(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and (stage == 4 or none.columns == docs.columns)


def test_empty_tables_of_all_others(spark):
    none = table(spark, []).withColumn("path", F.lit("p"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = rule_ensemble.fit_quality(none, labels)
    assert model.rules == [] and rule_ensemble.score_quality(none, model).count() == 0
    assert license_scan.inherit_licenses(license_scan.scan_licenses(none)).count() == 0
    assert license_scan.scan_licenses(spark.createDataFrame([(1, "a", "Released under the MIT License.")], "doc_id long, path string, text string"), {}).first()["own_license"] is None
    assert {r["score"] for r in rule_ensemble.score_quality(table(spark, ROWS), model).collect()} == {0.5}


def test_texts_over_a_slice(spark, monkeypatch):
    """A text longer than a slice, among short ones: slices of 4 KB give what one slice gives."""
    long_ = prose(3000, 7) + " " + prose(400, 8)
    rows = [(1, long_), (2, prose(90, 9)), (3, prose(400, 8) + " end"), (4, long_.replace("w7", "v7", 3)), (5, "é😀" * 3000), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))

    def every():
        out = []
        model = language_id.fit_languages(docs.withColumn("lang", F.lit("en")))
        for made in (sentencepiece_codec.encoding_digests(docs), quality_rules.quality_rules(docs), token_store.tokens_round_trip(docs), suffix_dedup.dedup_substrings(docs), ngram_join.jaccard_join(docs), rule_ensemble.statistics(docs), language_id.predict_languages(docs, model).select("doc_id", "lang_pred"), license_scan.scan_licenses(docs.withColumn("path", F.lit("a/b")))):
            out.append(sorted(map(str, made.collect())))
        return out

    assert common.SLICE_BYTES > len(long_)
    whole = every()
    kept = common.slices
    small = lambda batches, column="text", limit=4096: kept(batches, column, min(limit, 4096))
    for module in (sentencepiece_codec, quality_rules, token_store, suffix_dedup, ngram_join, rule_ensemble, language_id, license_scan):
        monkeypatch.setattr(module, "slices", small)
    assert every() == whole


def test_shards_against_the_definition(spark):
    """The winner of every key recomputed from hashes, ties and a shard without weight, and moves only into the new shard."""
    weights = (1.0, 0.0, 3.0, 2.0)
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(300)] + [(5, "again"), (5, "again"), (None, None)], "doc_id long, text string")
    got = sharding.shard_records(docs, weights, 2.5).collect()
    draws = {(r["k"], r["s"]): r["u"] for r in docs.select("doc_id").distinct().select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s")).select("k", "s", sharding.unit_draw(F.col("k"), F.col("s")).alias("u")).collect()}
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        value = {s: -w / np.log(draws[key, s]) for s, w in enumerate((*weights, 2.5)) if w}
        assert r["shard"] == max((s for s in value if s < 4), key=value.get)
        assert r["grown_shard"] == max(value, key=value.get)
    assert 1 not in {r["shard"] for r in got}
    for s in (0, 2, 3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sorted((r["doc_id"] or 0, r["text_crc32"]) for r in got if r["doc_id"] == 5) == sorted([(5, zlib.crc32(b"t5")), *[(5, zlib.crc32(b"again"))] * 2])


def test_language_vectors_against_the_definition(spark):
    """TF-IDF cosine of every text with every centroid worked out in plain Python; ties go to the first language."""
    en, de = "the cat and the other thing went with them ", "der hund und die andere sache ging nicht mit ihnen "
    rows = [(k, (en, de)[k % 2] * (1 + k % 3) + f"x{k}", ("en", "de")[k % 2]) for k in range(40)] + [(100, "zzz qqq", None), (101, en, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs)

    def vector(text):
        raw, out = text.encode(), collections.Counter()
        low = bytes(language_id._LOWER[b] for b in raw)
        for size in (2, 3):
            for j in range(len(low) - size + 1):
                part = low[j : j + size]
                if part.strip():
                    code = size
                    for b in part:
                        code = (code << 8 | b) & 0xFFFFFFFF
                    code = code * 2654435761 & 0xFFFFFFFF
                    code ^= code >> 15
                    code = code * 2246822519 & 0xFFFFFFFF
                    out[code >> 20] += 1
        return out

    got = {r["doc_id"]: r for r in language_id.predict_languages(docs, model).collect()}
    for k, text, _ in rows:
        v = {t: np.log1p(n) * float(model.idf[t]) for t, n in vector(text).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cosine = [sum(x * float(c[t]) for t, x in v.items()) / norm for c in model.vectors]
        best = int(np.argmax(np.round(cosine, 5)))
        assert abs(got[k]["score"] - min(max(cosine), 1)) < 1e-4
        assert got[k]["lang_pred"] == model.languages[model.owner[best]] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-5


def test_rule_weights_are_the_lasso_optimum():
    """At the optimum the gradient of the logistic loss equals the penalty for rules that stay and is below it for others."""
    rng = np.random.default_rng(1)
    x = rng.random((500, len(rule_ensemble.FEATURES)))
    y = ((x[:, 1] > 0.4) & (x[:, 2] < 0.7) | (x[:, 5] > 0.9)).astype(float)
    model = rule_ensemble.fit_rules(x, y, penalty=5e-3)
    r = model.score(x) - y
    assert abs(r.mean()) < 1e-3 and model.rules
    for conditions, weight in model.rules:
        g = float((rule_ensemble._holds(x, conditions) * r).mean())
        assert abs(g + np.sign(weight) * 5e-3) < 1e-3


def test_fitted_bands_judge_held_out_texts(spark):
    """Bands of one half of the labelled texts keep the good texts of the other half and reject most of the bad."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    bands = quality_rules.fit_bands(some.where(half), labels)
    assert set(bands) == {"en", "fr", "de", "es"}
    judged = quality_rules.quality_rules(some.where(~half), bands=bands).where("not base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    share = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.995 and share[0] < 0.5
    for lang, band in bands.items():
        stated = quality_rules.BANDS[lang]
        assert abs(band.mean - stated.mean) < 0.1 and abs(band.even - stated.even) < 0.02
    assert quality_rules.fit_bands(some.limit(0), labels) == {}


def test_kept_follows_from_what_is_measured(spark):
    """The verdict recomputed from the figures of an independent tokenizer and the stated bands."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def is_part(token):
        try:
            token.decode()
        except UnicodeDecodeError:
            return True
        return False

    part = {k for t, k in ranks.items() if is_part(t)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for d in docs.collect():
        r, text = got[d["doc_id"]], d["text"] or ""
        ids = encoding.encode_ordinary(text)
        n, times = len(ids), collections.Counter(ids)
        assert r["n_tokens"] == n
        if not n:
            continue
        entropy = -sum(c / n * np.log2(c / n) for c in times.values())
        most = min(np.log2(n), quality_rules.EVEN_BITS)
        even = entropy / most if most else 1.0
        per, share = len(text) / n, sum(i in part for i in ids) / n
        assert np.allclose([r["chars_per_token"], r["byte_share"], r["token_entropy"], r["evenness"]], [per, share, entropy, even])
        wide = sum(ord(c) >= 0x400 for c in text)
        band = quality_rules.BANDS.get(d["lang"]) or quality_rules.SCRIPT_BANDS["other" if 2 * wide > len(text) else "latin"]
        off = (per - band.mean) * n**0.5 / quality_rules.SPREAD
        uneven = min(even - band.even + band.slope * min(np.log2(n) - quality_rules.EVEN_BITS, 0), 0) / band.even_spread
        ok = (band.low <= per <= band.high or off * off + uneven * uneven <= quality_rules.RADIUS**2) and share <= band.most_bytes and even >= band.least_even
        assert r["kept"] == (ok and not r["base_failed"])


def test_a_stage_deletes_what_the_ones_before_set_aside(spark, tmp_path):
    """Only once its input no longer reads it."""
    made = []

    @common.stage
    def first(spark, docs, sf_dir):
        made.append(common.materialize(docs, "first"))
        return made[-1]

    @common.stage
    def second(spark, docs, sf_dir):
        return docs

    at = common.shared_dir(spark)
    there = lambda: (tmp_path.joinpath(at.removeprefix("file://")) / "tessera").glob("first-*")
    already = set(there())
    kept = first(spark, spark.range(5), "")
    assert second(spark, kept, "").count() == 5 and len(set(there()) - already) == 1
    kept.write.parquet(str(tmp_path / "kept"))
    assert second(spark, spark.read.parquet(str(tmp_path / "kept")), "").count() == 5 and not set(there()) - already


def test_many_rows_alike_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 16)
    rows = [(1, "same")] * 70 + [(2, "same")] * 16 + [(3, "same")] * 17 + [(k, f"t{k}") for k in range(4, 40)]
    got = sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string"), (1.0, 2.0)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    for s in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
