"""Every training-data operator against brute force on small tables with odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, language_id, license_scan, ngram_join, quality_rules, rule_ensemble, sentencepiece_codec, sharding, suffix_dedup, token_store
from tessera.llm.vocabularies import MarkedChunks, byte_bpe_chunks, vocabulary_path

GRAM = suffix_dedup.GRAM
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def sample():
    base, passage = words(150, 1), words(120, 2)
    near = base.copy()
    near[70] = "other"
    texts = [None, "", " \n\t ", "one", "two words", "a  b\n \nc ", " lead", "tail \n", "x" * 500, "é😀▁ü" * 130, " ".join(base), " ".join(base), " ".join(near), "intro " + " ".join(passage) + " end", " ".join(words(60, 3)) + "\n" + " ".join(passage), "same line here\n" * 40, "<|endoftext|> $$$ ### a a a", " ".join(words(30_000, 4)), "naïve 漢字 テスト " * 40]
    texts += [" ".join(words(80, 10 + k)) for k in range(6)]
    rows = [(k, t, ["en", None, "de"][k % 3], "s", None) for k, t in enumerate(texts)]
    return [*rows, rows[10], (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DDL).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text):
    w = split(text)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pieces_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    got = by_id(sentencepiece_codec.encode_documents(docs))
    for k, text, *_ in sample():
        assert got[k]["ids"] == sp.encode(text or "")
    assert all(r["exact"] for r in sentencepiece_codec.encoding_digests(docs).collect())
    back = by_id(sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs)))
    assert all(back[k]["text"] == (t or "").replace("▁", " ") for k, t, *_ in sample())


def test_token_store_round_trip(docs, tmp_path):
    store = token_store.write_tokens(docs, str(tmp_path / "store"), file_ids=5000)
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), 0
    got = sorted(store.read(docs.sparkSession).collect(), key=lambda r: r["start"])
    want = sorted(sample(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    for r, (_, text, *_) in zip(got, want):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["ids"]) == (at, ids)
        at += len(ids)


def test_added_tokens_and_hot_ids(spark, tmp_path, monkeypatch):
    """The library's plain call knows <|endoftext|>; a doc_id that half of all rows have fills several files."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|> c", "x<|endoftext|>y  z", "a b<|endoftext|> c", "<|end of text|>"]
    rows = [*enumerate(texts), *((9, f"hot {k}") for k in range(40)), *((None, f"none {k}") for k in range(30)), (50, "last")]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    monkeypatch.setattr(token_store, "FILE_BYTES", 40)
    store = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "hot"), file_ids=30)
    got = sorted(store.read(spark).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    want = collections.Counter((k, tuple([*t.encode(x, add_special_tokens=False).ids, 0])) for k, x in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([len(r["ids"]) for r in got])[:-1].tolist()]


def test_variable_length_codes():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7], np.int64)
    counts = np.array([3, 0, 4])
    control, data, _, _ = token_store.encode_ids(ranks, counts)
    assert token_store.decode_ids(control, data, counts).tolist() == ranks.tolist()


def test_quality_counts(docs):
    got = by_id(quality_rules.quality_rules(docs))
    for k, text, *_ in sample():
        w = split(text)
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        times, inside, seen, again = collections.Counter(three), set(), set(), 0
        for j, x in enumerate(three):
            if times[x] > 1:
                inside |= {j, j + 1, j + 2}
        for line in (text or "").split("\n"):
            if split(line):
                again += line in seen
                seen.add(line)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_short_clean_texts_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    clean, junk = (5854, 2438, 1202), (3377, 5147, 8194, 813)  # none has a label; the latter have a symbol at every word
    got = by_id(quality_rules.quality_rules(docs.where(F.col("doc_id").isin(*clean, *junk))))
    assert [got[k]["kept"] for k in clean] == [True] * 3 and [got[k]["kept"] for k in junk] == [False] * 4
    short = docs.where("length(text) < 1200").join(labels.select("doc_id", "quality"), "doc_id")
    judged = quality_rules.quality_rules(short).where("not base_failed").join(labels, "doc_id").collect()
    assert len(judged) > 100 and all(r["kept"] for r in judged if r["quality"])


def test_substrings_against_brute_force(docs):
    raw = [(r[1] or "").encode() for r in sample()]
    times = collections.Counter(b[j : j + 400] for b in raw for j in range(len(b) - 399))
    got = collections.defaultdict(set)
    for r in suffix_dedup.dedup_substrings(docs).collect():
        got[r["doc_id"]].add((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    for (k, *_), b in zip(sample(), raw):
        m = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 399):
            if times[b[j : j + 400]] > 1:
                m[j : j + 400] = True
        m = m[:-1]
        left = bytes(np.frombuffer(b, np.uint8)[~m])
        runs = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(b) else 0
        assert got[k] == {(len(b), int(m.sum()), runs, hashlib.sha256(left).hexdigest())}


def test_jaccard_join_against_brute_force(docs):
    rows = [r for r in sample() if r[0] is not None]
    sets = [grams(r[1]) for r in rows]
    link = [[i != j and bool(a or b) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = [r[0] for r in rows]
    for _ in rows:
        root = [min([root[i], *[root[j] for j in range(len(rows)) if link[i][j]]]) for i in range(len(rows))]
    got = by_id(ngram_join.jaccard_join(docs))
    for i, r in enumerate(rows):
        assert (got[r[0]]["class_id"], got[r[0]]["n_links"]) == (root[i], sum(link[i]))
    assert got[None]["class_id"] is None


def test_large_near_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    base, rows = words(300, 5), []
    for k in range(40):
        w = base.copy()
        w[5 + 7 * k] = f"edit{k}"
        rows.append((k, " ".join(w)))
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"], r["n_text_links"]) for r in got} == {(0, 39, 39)} and len(got) == 40


def test_a_repeated_id_with_another_text_is_searched(spark):
    """Rows (1, A), (2, A), (2, B): B is no copy of A, so its passages count."""
    passage = " ".join(words(90, 50))
    a, b, c = " ".join(words(100, 51)), "x " + passage, passage + " and more"
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_substrings(spark.createDataFrame([(1, a), (2, a), (2, b), (3, c)], "doc_id long, text string")).collect()]
    shared = len(passage) + 0
    assert sorted(got)[0] == (1, len(a), len(a)) and (2, len(a), len(a)) in got
    assert {n for _, k, n in got if k in (len(b), len(c))} <= {shared, shared + 1} and len(got) == 4


def test_substrings_of_random_edits(spark):
    """Chains of edited copies, periods, shifted overlaps and hot passages over many partitions, as by brute force."""
    rng = np.random.default_rng(12)
    base = " ".join(words(400, 60))
    texts = ["ab" * 500, "ab" * 260 + "c" + "ab" * 90, "abc" * 200, "x" + "abc" * 130 + "y", "Anst " * 300, "le " * 140 + "Anst " * 90]
    for k in range(25):
        x = list(base[int(rng.integers(0, 300)) : int(rng.integers(900, len(base)))])
        for at in rng.integers(0, len(x), int(rng.integers(0, 5))):
            x[at] = chr(65 + k)
        texts.append("".join(x))
    hot = " ".join(words(75, 61))
    texts += [f"{k} own words {k * 7} " + hot + f" {k * 3} tail" for k in range(40)]
    rows = [(k, x) for k, x in enumerate(texts)]
    for length in (200, 400):
        times = collections.Counter(x[j : j + length] for x in texts for j in range(len(x) - length + 1))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(df, length).collect()}
        for k, x in rows:
            m = np.zeros(len(x) + 1, bool)
            for j in range(len(x) - length + 1):
                m[j : j + length] |= times[x[j : j + length]] > 1
            assert got[k] == (int(m.sum()), int((m[:-1] & ~np.concatenate([[False], m[:-2]])).sum())), (length, k)


def covered(texts, length):
    """Bytes of each of texts (all of single-byte characters) under a string of length bytes that also starts elsewhere."""
    times = collections.Counter(x[j : j + length] for x in texts for j in range(len(x) - length + 1))
    out = []
    for x in texts:
        m = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            m[j : j + length] |= times[x[j : j + length]] > 1
        out.append(m)
    return out


def periodic(rng, period):
    unit = "".join(map(chr, rng.integers(97, 123, period)))
    return [(unit * (n // period + 2))[:n] for n in (int(rng.integers(400, 520)), int(rng.integers(620, 900)))]


@pytest.mark.parametrize("partitions", [1, 2, 9])
def test_two_texts_of_one_unit(spark, partitions):
    """Every period from 1 to 130, twice at different lengths, dealt into one slice and into several, beside other texts."""
    rng = np.random.default_rng(partitions)
    texts = [x for period in range(1, 131) for x in periodic(rng, period)] + ["\0" * 450, "\0" * 900, "spam " * 200, "spam " * 300]
    texts += ["".join(map(chr, rng.integers(97, 123, 700))) for _ in range(20)] + [texts[3][:410] + "".join(map(chr, rng.integers(97, 123, 300))), "once " * 110]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").orderBy(F.rand(partitions)).repartition(partitions)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(df).collect()}
    for k, m in enumerate(covered(texts, 400)):
        assert got[k] == (int(m.sum()), int((m & ~np.concatenate([[False], m[:-1]])).sum())), k


def test_repeats_of_one_unit_leave_the_pipeline(spark):
    """The pipeline's stage takes both texts of a unit whole, whichever slice they are in."""
    rows = [(k, unit * n) for k, (unit, n) in enumerate([("spam ", 200), ("spam ", 300), ("to be or not ", 60), ("to be or not ", 90)])]
    rows.append((9, " ".join(words(200, 77, 10**6))))
    for partitions in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        assert [r["doc_id"] for r in corpus_pipeline.repeated_passages(spark, df, "").collect()] == [9]


def test_phrases_closer_than_usual_are_ranked_to_the_threshold(spark, monkeypatch):
    """Counting texts hold positions a few bytes apart: runs of more than four phrases go through further rounds."""
    rounds = []
    kept = suffix_dedup.rank_by_sorting
    monkeypatch.setattr(suffix_dedup, "rank_by_sorting", lambda rows, keys, ties, name, **more: (rounds.append(name), kept(rows, keys, ties, name, **more))[1])
    a = "".join(f"{k:03d}" for k in range(400))
    # units of three kinds in an order without a period, so that the least neighbour comes again every few bytes
    rng = np.random.default_rng(3)
    b = "".join(("aaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaac", "aaaaaaaaaaaaaaaaad")[k] for k in rng.integers(0, 3, 60))
    texts = [a, "x" + a[200:900] + "y", b, "q" + b[100:800] + "z", b[300:720]]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for k, m in enumerate(covered(texts, 400)):
        assert got[k] == (int(m.sum()), int((m & ~np.concatenate([[False], m[:-1]])).sum())), k
    assert "ranks-8" in rounds


def test_shared_runs_tell_of_shorter_passages(spark):
    """Passages of 290 to 399 bytes stay, and n_shared shows them; texts of their own have 0; copies count once."""
    rows = []
    for k in range(12):
        passage = " ".join(words(60, 300 + k))[: 290 + 9 * k]
        rows += [(2 * k, " ".join(words(150, 400 + k)) + " " + passage + " tail"), (2 * k + 1, f"head {k} " + passage + " " + " ".join(words(100 + k, 500 + k)))]
    rows += [(100 + k, " ".join(words(200, 600 + k))) for k in range(6)] + [(200, rows[-1][1]), (201, rows[0][1])]
    got = by_id(suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    for k in range(24):
        assert (got[k]["n_removed"] == 0 or k in (0, 23)) and GRAM < got[k]["n_shared"] <= 290 + 9 * (k // 2) + 1
    assert {got[100 + k]["n_shared"] for k in range(6)} == {0}
    assert (got[200]["n_shared"], got[201]["n_shared"]) == (got[23]["n_shared"], got[0]["n_shared"])


def test_passages_of_fifty_words_go(spark):
    passage = words(52, 70, 10**6)
    rows = [(k, " ".join([*words(120, 71 + k, 10**6), *passage, *words(60, 91 + k, 10**6)]), 5) for k in range(4)]
    rows += [(9, " ".join([*words(120, 99, 10**6), *passage[:40], *words(60, 98, 10**6)]), 5), (10, " ".join(passage), None), (11, None, None)]
    got = by_id(corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), ""))
    for k in range(4):
        left = got[k]["text"].split()
        assert not set(passage[1:-1]) & set(left) and len(left) >= 178 and got[k]["n_chars"] == len(got[k]["text"])
    assert got[9]["text"] == rows[4][1] and 10 not in got and 11 in got


def test_a_unit_with_an_empty_side_has_no_links():
    grams = np.arange(300, dtype=np.uint64)
    sig = ngram_join._signature(grams, np.array([0, 300])).tobytes()
    rows = [(k, 0, 1, sig, grams.tobytes()) for k in (5, 6)]
    least = ngram_join.least_agreements(0.8, 1e-9)
    assert ngram_join._unit(rows, False, 0.8, least).num_rows == 0
    assert ngram_join._unit(rows, True, 0.8, least).to_pydict() == {"node": [5, 6], "n_texts": [1, 1], "n_rows": [1, 1], "root": [5, 5]}


def test_a_chain_of_distant_texts_is_no_component(spark, monkeypatch):
    """Texts that each share a third with the next: buckets join them, the posterior keeps none, so no unit verifies pairs."""
    seen = []
    whole = ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda e: seen.append(whole(e)) or seen[-1])
    long_ = words(400 * 60, 21, 10**6)
    rows = [(k, " ".join(long_[200 * k : 200 * k + 400])) for k in range(110)]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"] == r["doc_id"], r["n_links"]) for r in got} == {(True, 0)}
    assert seen[0].count() == 0


def test_buckets_in_units(spark, monkeypatch):
    """Two near-copy groups and strangers in units of two texts: as by brute force, also for a doc_id with two texts."""
    monkeypatch.setattr(ngram_join, "BUCKET_TEXTS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 3)
    base, rows = words(200, 31), []
    for k in range(24):
        w = base.copy()
        for at in np.random.default_rng(k).integers(0, 200, 1 + k // 2):
            w[at] = f"e{k}"
        rows.append((k, " ".join(w)))
    rows += [(3, "another text of the same id with words of its own"), (50, rows[5][1]), (51, rows[5][1])]
    sets = [grams(x) for _, x in rows]
    link = [[i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in range(len(rows)) if link[i][j]]]) for i in range(len(rows))]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = sorted((rows[i][0], least[root[i]], sum(link[i])) for i in range(len(rows)))
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_links_count_once_beside_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)  # two texts of 296 n-grams make two blocks
    block = {r["id"]: r["b"] for r in spark.range(200).select("id", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).alias("b")).collect()}
    both = [[k for k in block if block[k] == b][:2] for b in (0, 1)]
    for pair in (*both, [x[0] for x in both]):  # both in block 0, both in block 1, one in each
        rows = [(k, " ".join([*words(299, 6), f"end{k}"])) for k in pair]
        got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in got) == [(k, min(pair), 1, 1) for k in sorted(pair)]


def test_decontamination(spark, docs):
    items = [(1, " ".join(words(150, 1)[20:60])), (2, "short item"), (3, None), (4, " ".join(words(40, 99)))]
    got = decontamination.benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in got} == {(k, 1, 20, 1.0) for k in (10, 11, 12)}
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in sample()} - {10, 11, 12}


def weighted_similarity(a, b):
    """Weighted Jaccard of two multisets of word 5-grams; a 5-gram weighs its characters."""
    both = sum(min(a[g], b[g]) * sum(map(len, g)) for g in a)
    return both / (sum(n * sum(map(len, g)) for g, n in (*a.items(), *b.items())) - both)


def brute_matches(docs, items):
    out = {}
    fives = lambda w: [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    for item_id, text in items:
        item = fives(split(text))
        for k, x in docs:
            mine = fives(split(x))
            for s in range(len(mine) - len(item) + 1 if item else 0):
                value = weighted_similarity(collections.Counter(mine[s : s + len(item)]), collections.Counter(item))
                if value >= 0.8 - 1e-12 and value > out.get((k, item_id), (0, 0))[0] + 1e-12:
                    out[k, item_id] = (value, s)
    return out


def test_decontamination_against_all_windows(spark):
    long_, w = "l" * 41, [f"w{k:03}" for k in range(40)]
    five = [f"{k:05}" for k in range(17)]
    docs = [
        (0, " ".join(["z z z", *w[:37], *[f"{long_}{k}" for k in range(10)]])),  # the best window opens before the first shared shingle
        (1, " ".join(["a"] * 3 + w[:37] + ["b"] * 9)),
        (2, " ".join(["other", *five[1:], "sixsix", "tail"])),
        (3, " ".join(w)),
        (4, " ".join(w[:20])),
        (5, " ".join(["x"] * 30 + w[10:30] + ["y"] * 30)),
        (6, " ".join(w + w)),
        (7, " ".join(["q", "r"] * 40)),
        (8, None),
        (9, "one two"),
    ]
    rng = np.random.default_rng(3)
    for k in range(30):  # copies with edits, near the threshold
        x = [f"pre{k}"] * int(rng.integers(0, 6)) + w + [f"post{k}"] * int(rng.integers(0, 6))
        for at in rng.integers(0, len(x), int(rng.integers(1, 4))):
            x[at] = "e" * int(rng.integers(1, 12))
        docs.append((100 + k, " ".join(x)))
    items = [(1, " ".join(w)), (2, " ".join(five)), (3, "q r " * 6), (4, "one two"), (5, " ".join(w[:5])), (6, None)]
    got = decontamination.benchmark_matches(spark.createDataFrame([*docs, docs[3]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_matches(docs, items)
    assert {(0, 1), (2, 2), (3, 1), (6, 1), (7, 3)} <= set(want)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 7), r["start"]) for r in got} == {k: (round(v, 7), s) for k, (v, s) in want.items()}


def test_neighbours_cover_the_radius(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(200):
        a = int(rng.integers(-(1 << 63), (1 << 63) - 1))
        flips = sum(1 << int(b) for b in rng.choice(64, 20, replace=False))
        b = (a ^ flips) & ((1 << 64) - 1)
        rows.append((k, a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "id long, a long, b long")
    left = df.select("id", F.explode(decontamination.hamming_blocks(F.col("a"))).alias("x")).select("id", "x.k", "x.bits")
    right = df.select("id", F.explode(decontamination.hamming_neighbours(F.col("b"), 20)).alias("x")).select("id", "x.k", "x.bits")
    assert left.join(right, ["id", "k", "bits"]).select("id").distinct().count() == 200


def test_shards(docs):
    got = [r for r in sharding.shard_records(docs).collect()]
    for k in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    text = {r[0]: (r[1] or "").encode() for r in sample()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    heavy = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.shard_records(heavy, (1.0, 3.0)).groupBy("shard").count().collect()}
    assert 2.6 < n[1] / n[0] < 3.4


def test_license_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/d/y.py", None), (5, "z.py", "text\nLicensed under CC BY-NC 4.0.\ntext"), (6, None, ""), (7, "q/r.py", "plain")]
    got = by_id(license_scan.inherit_licenses(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"))))
    assert {k: r["license"] for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Apache-2.0", 5: "CC-BY-NC-4.0", 6: None, 7: None}
    assert got[4]["inherited"] and got[4]["license_from"] == "a/b/c/COPYING"


def scanned(spark, texts):
    rows = list(enumerate(texts))
    got = by_id(license_scan.scan_licenses(spark.createDataFrame([(k, f"d/{k}.txt", x) for k, x in rows], "doc_id long, path string, text string")))
    return [got[k]["own_license"] for k, _ in rows]


def test_every_license_line_of_the_documents_is_found(spark):
    want = {"All rights reserved.": "proprietary", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {x for r in docs.collect() for x in (r["text"] or "").split("\n") if re.search("licen[sc]e|rights reserved", x, re.I)}
    assert lines == set(want)
    assert scanned(spark, list(want)) == list(want.values())
    got = by_id(license_scan.scan_licenses(docs.select("doc_id", F.lit("x.txt").alias("path"), "text")))
    for r in docs.collect():
        of = {v for k, v in want.items() if k in (r["text"] or "").split("\n")}
        assert got[r["doc_id"]]["own_license"] in (of or {None})


def test_own_templates_need_no_known_word(spark):
    own = {"Zork-1": ("Use of this software is governed by the Zork terms of use v1.",), "short": ("Go away.",)}
    texts = ["code\nUse of this software is governed by the Zork terms of use v1.\ncode", "plain text of some words", "please go away. now", None, "words " * 300_000 + "use of this software is governed by\nthe zork terms of use v1"]
    rows = [(k, f"d/{k}", x) for k, x in enumerate(texts)]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), own))
    assert [got[k]["own_license"] for k in range(5)] == ["Zork-1", None, "short", None, "Zork-1"]


def test_every_template_is_found_under_its_own_name(spark):
    """Alone, wrapped in a comment, in capitals, and amid other text; a licence without a template is none."""
    every = [(name, x) for name, texts in license_scan.TEMPLATES.items() for x in texts]
    shapes = [lambda x: x, lambda x: "/* " + x.replace(" ", "\n * ") + " */", str.upper, lambda x: "Der Fuchs springt über den Zaun. " * 20 + x + " Und läuft davon." * 20]
    rows = [(name, shape(x)) for name, x in every for shape in shapes]
    rows += [(None, x) for x in ("Released under the Foo Bar Baz agreement.", "This program is free to read, and anyone can run it.", "He can go by with his form of information.")]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame([(k, "x.txt", x) for k, (_, x) in enumerate(rows)], "doc_id long, path string, text string")))
    assert [(rows[k], got[k]["own_license"]) for k in range(len(rows)) if got[k]["own_license"] != rows[k][0]] == []
    assert len(license_scan.TEMPLATES) >= 30


def test_license_cosines_against_all_windows(spark):
    """Brute force: every window of every template's size in a text, TF-IDF cosine from the definition, no filter of words."""
    known = license_scan.Templates()
    every = [(name, license_scan._words(x)) for name, texts in sorted(license_scan.TEMPLATES.items()) for x in texts]

    def vector(w):
        return {t: n * known.idf.get(t, known.rare) for t, n in license_scan._terms(w).items()}

    def cosine(a, b):
        return sum(v * b.get(t, 0) for t, v in a.items()) / (sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5)

    rng = np.random.default_rng(4)
    pool = sorted({w for _, ws in every for w in ws})
    texts = []
    for k in range(25):
        name, w = every[int(rng.integers(len(every)))]
        w = list(w)
        for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[at] = str(rng.choice([*pool, "other", "word"]))
        texts.append(" ".join([*rng.choice(pool, 6), *w, *rng.choice(["plain", "prose", "here"], 6)]))
    for text in texts:
        w, best = license_scan._words(text), license_scan.NONE
        for k, (name, words_) in enumerate(every):
            size = len(words_)
            top = max(cosine(vector(w[j : j + size]), vector(words_)) for j in range(max(1, len(w) - size + 1)))
            best = min(best, known._rank(k, top))
        assert known.around(text) == best


def test_short_wrapped_and_enclosed_notices(spark):
    prose = "some plain words of prose that speak of other things and go on for a good while before the notice comes up "
    texts = {
        "SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */": "GPL-2.0",
        "SPDX-License-Identifier: (MIT OR BSD-3-Clause)": "BSD-3-Clause",
        "SPDX-License-Identifier: ISC": None,
        "SPDX-License-Identifier: MIT-0": None,
        prose + "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. " + prose: "Apache-2.0",
        "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 3 of the License, or (at your option) any later version.": "LGPL-3.0",
        " * This Source Code Form is\n * subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy of the MPL was not distributed": "MPL-2.0",
        "Copyright 2020 A Company, Inc. All rights reserved.\n" + prose: "proprietary",
        "Copyright 2020 A. All rights reserved.\n\n" + prose + "Redistribution and use in source and\nbinary forms, with or without\nmodification, are allowed provided that the following conditions are met:": "BSD-3-Clause",
        "Some rights reserved.": None,
        prose + "with the permission of a friend": None,
    }
    assert scanned(spark, list(texts)) == list(texts.values())


def test_rules_score_alike_in_python_and_spark(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(rule_ensemble.FEATURES)))
    y = ((x[:, 0] < 0.3) & (x[:, 3] > 0.2)).astype(float)
    model = rule_ensemble.fit_rules(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    stats = rule_ensemble.statistics(docs)
    got = stats.select(*rule_ensemble.feature_columns(), model.column().alias("score")).toPandas()
    assert np.allclose(model.score(got[list(rule_ensemble.FEATURES)].to_numpy(float)), got["score"])
    assert len(rule_ensemble.score_quality(docs, rule_ensemble.fit_rules(x[:0], y[:0])).collect()) == len(sample())


def test_languages(spark):
    en, de = "the cat and the other thing went with them", "der hund und die andere sache ging nicht mit ihnen"
    rows = [(k, f"{(en, de)[k % 2]} {k}", ("en", "de")[k % 2]) for k in range(60)] + [(100, None, None), (101, "123 !!", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.predict_languages(docs, language_id.fit_languages(docs, F.col("doc_id") < 40)))
    assert all(got[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    items = spark.createDataFrame([], "item_id long, text string")
    assert [x.count() for x in (quality_rules.quality_rules(none), sharding.shard_records(none), suffix_dedup.dedup_substrings(none), ngram_join.jaccard_join(none), decontamination.benchmark_matches(none, items), sentencepiece_codec.encoding_digests(none), token_store.tokens_round_trip(none), language_id.predict_languages(none, language_id.fit_languages(none)))] == [0] * 8


def test_pipeline(spark):
    sf, rows = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) <= kept.count() and all(r["n_pieces"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(50, k) for k in range(1, 40)], [(3, 3), (None, 4), (9, 7), (7, 8), (9, 7)], [(int(a), int(b)) for a, b in np.random.default_rng(5).integers(0, 300, (260, 2))]])
def test_components_equal_brute_force(spark, edges):
    from tessera.llm.components import connected_components

    want = {x: x for e in edges if None not in e for x in e}
    for _ in want:
        for a, b in (e for e in edges if None not in e):
            want[a] = want[b] = min(want[a], want[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want


def test_chunks_of_the_token_store_are_learnt_once():
    """op4: 800,000 chunks that come again go to the library once; marks, white space and zero bytes are found in bulk as one by one."""
    seen = []

    def chunks(new):
        seen.append(len(new))
        return np.arange(len(new), dtype=np.int32), np.ones(len(new), np.int64)

    encoder = MarkedChunks(chunks, lambda text: [0], ["<|end of text|>"])
    texts = [" ".join(f"c{k}" for k in range(at, at + 100_000)) for at in range(0, 800_000, 100_000)]
    for _ in range(2):
        for text in texts:
            encoder([text])
    assert sum(seen) == 800_000 - len(texts)
    odd = ["a", "", "b\n", "c\u2003", "\x00 d", "e\x00", "f\nf", "<|end", "text|>", "xtext|>y", "é"]
    for some in (odd, odd[:8], odd[:1]):
        assert encoder.are_safe(some) == [encoder.is_safe(c) for c in some]


def test_columns_of_the_token_store_equal_plain_calls(monkeypatch):
    """op4: a column's chunks are looked up once each, words with and without punctuation go to the library once; ids are those of its plain call."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    t, encoder = Tokenizer.from_file(path), byte_bpe_chunks.__wrapped__(path)
    seen, plain = [], encoder.encode_chunks
    monkeypatch.setattr(encoder, "encode_chunks", lambda new: seen.extend(new) or plain(new))
    odd = ["word", "word,", "word.", "(word)", "don't,", "it's'", "x's", "x'", "'s,", "été!", "слово?", "слово", "a1,", "1,", "×,", "÷.", "中文,", "ª,", "á,", "one.\nTwo,", "a\n,", ",", "...", "__x__", "a’,", "<|endoftext|>", "x<|endoftext|>.", "<|endoftext", "a\x00b,", "\x00 q,", "é—,", "b ,", "c\r\n."]
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolorem") for b in ("", ",", ".", "!?", ")", "'", "...", "\n", "  ")]
    texts = ["", None, " ", "word, ", *odd, *(f"{a} {b}" for a in odd for b in odd), " ".join(words), " ".join(reversed(words)), "  two  spaces "]
    for some in (texts, texts[::-1], texts[3:40], texts[1:2]):
        for column in (pa.array(some, pa.string()), pa.array(["cut", *some, None, "off"], pa.string()).slice(1, len(some))):
            ids, counts = encoder.column(column)
            want = [t.encode(x or "", add_special_tokens=False).ids for x in some]
            assert counts.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
            alone = encoder([x or "" for x in some])
            assert alone[0].tolist() == ids.tolist() and alone[1].tolist() == counts.tolist()
    assert len(seen) == len(set(seen)) and not {"word,", "word.", "été!", "слово?", "lorem,", "lorem..."} & set(seen)
    assert {"word", "lorem", "×,", "中文,", "a1,"} <= set(seen)
