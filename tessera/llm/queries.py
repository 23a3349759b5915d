"""Queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents
from tessera.llm.decontamination import benchmark_matches
from tessera.llm.divergence import audit_sources
from tessera.llm.fill_in_middle import middle_digests
from tessera.llm.language_id import fit_languages, predict_languages
from tessera.llm.license_scan import inherit_licenses, scan_licenses
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import jaccard_join
from tessera.llm.quality_rules import quality_rules
from tessera.llm.rule_ensemble import fit_quality, id_remainder, score_quality
from tessera.llm.sentencepiece_codec import encoding_digests
from tessera.llm.sharding import shard_records
from tessera.llm.suffix_dedup import dedup_substrings
from tessera.llm.token_store import tokens_round_trip


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a directory for each source and thousand of ids stands in; each one's first files are its notices."""
    name = F.when(F.pmod("doc_id", F.lit(1000)) < 40, F.lit("NOTICE-")).otherwise(F.lit("text-"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(name, F.col("doc_id").cast("string"), F.lit(".txt")))
    return inherit_licenses(scan_licenses(documents(spark, sf_dir).select("doc_id", path.alias("path"), "text")))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of two thirds of the ids; the others are held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder(F.col("doc_id"), 3) != 1)
    held = (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return score_quality(docs, fit_quality(docs, labels)).select("doc_id", held, "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three quarters of the ids; the others are held out."""
    docs = documents(spark, sf_dir)
    model = fit_languages(docs, id_remainder(F.col("doc_id"), 4) != 2)
    held = (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return predict_languages(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(documents(spark, sf_dir))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "weight", "epochs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_quality_rules, op4_token_store, op5_license_scan, op6_rule_ensemble, op7_sharding, op8_language_id, op9_suffix_dedup, op10_ngram_join, op11_source_divergence, op12_fill_in_middle, op13_source_mix)}


#: crc32 of a list of bytes b, with the usual table made by its rule.
_CRC_TABLE = "crc as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda a, k: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) t(i)))"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x'||x)::bigint)"
_SHARDS = f"""with {_CRC_TABLE},
t as (select doc_id, coalesce(doc_id::varchar, 'null') as key, {_BYTES.format("coalesce(text, '')")} as b from documents),
r as (select row_number() over () as id, doc_id, key, len(b) + 1 as size, {_CRC} as text_crc32 from t, crc),
k as (select *, {_BYTES.format("key||'/'||size||'/'||text_crc32")} as b from r),
n as (select greatest(16, 4 * ceil(count(*) / 320000.0))::bigint as buckets from (select distinct doc_id, size, text_crc32 from r)),
p as (select id, doc_id, size, text_crc32, {_CRC} % buckets as bucket from k, crc, n),
d as (select id, s, -1.0::double / ln((('0x'||substr(md5(key||'/'||s), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double) as draw from r, range(17) x(s)),
w as (select id, (first(s order by draw desc, s) filter (where s < 16))::int as shard, first(s order by draw desc, s)::int as grown_shard from d group by id)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard from p join w using (id)"""


#: Every kept term of every group and language said in full, with exact integers.
_DIVERGENCE = r"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
w as (select id, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct id) >= 10),
v as (select lang, count(*) as v, sum(n)::hugeint as n from kept group by lang),
groups as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept on w.lang = kept.lang and w.term = kept.term group by w.lang, w.source, w.term),
t as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n from groups g left join c on g.lang = c.lang and g.source = c.source group by g.lang, g.source),
p as (select t.lang, t.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v.v) as p, 1 + (1000000000::hugeint * (kept.n + 2)) // (v.n + 2 * v.v) as q
  from t join kept on t.lang = kept.lang join v on v.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q),
x as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from r)
select lang, source, part, item, value, rank::int as rank from x where part = 'pair' or rank <= 10"""

#: Units, draws and cuts said once more; what is restored must be the text.
_MIDDLE = r"""with t as (select doc_id, coalesce(text, '') as text, sha256('7:'||doc_id) as h from documents),
u as (select *, case when text = '' then [] else regexp_extract_all(text, '[^\n]*\n|[^\n]+') end as lines, ('0x'||substr(h, 1, 8))::bigint as h1, ('0x'||substr(h, 9, 8))::bigint as h2, ('0x'||substr(h, 17, 8))::bigint as h3, ('0x'||substr(h, 25, 8))::bigint as h4 from t),
c as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b from u),
f as (select doc_id, text, n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
  coalesce(array_to_string(lines[1:a], ''), '') as head, coalesce(array_to_string(lines[a + 1:b], ''), '') as mid, coalesce(array_to_string(lines[b + 1:n], ''), '') as tail from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(head)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>'||head||'<S>'||tail||'<M>'||mid else '<S>'||tail||'<P>'||head||'<M>'||mid end) as output_sha256, sha256(text) as restored_sha256 from f"""

#: The mix with windows over all sources and a recursive first fit.
_MIX = r"""with recursive t as (select doc_id, source, coalesce(text, '') as text from documents),
c as (select doc_id, source, md5(text) as digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as size, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as ink,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
w as (select doc_id, source, digest, size, greatest((ink - symbols)::double / greatest(ink, 1) * (len(list_distinct(lines))::double / greatest(len(lines), 1)), 0.05::double) as weight from c),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as sid from w group by source),
v as (select *, 1 + sid % 3 as turn from s),
p as (select *, (sum(source_size) over ())::double - 3 * (sum(source_size) over (order by 3 * source_size::double / turn, sid) - source_size) as open_words, (sum(turn) over () - sum(turn) over (order by 3 * source_size::double / turn, sid) + turn)::double as open_turns from v),
l as (select open_words, open_turns from p where open_words * turn / open_turns <= 3 * source_size order by 3 * source_size::double / turn, sid limit 1),
g as (select sid, source, source_size, least(l.open_words * turn / l.open_turns, 3 * source_size)::double as target from v, l),
e as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as epochs from g),
k as (select doc_id, sid, size, weight, source_size, target, epochs, row_number() over (partition by sid order by -ln((('0x'||substr(md5(doc_id||'/'||digest), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double) / weight, doc_id, digest) as nth from w join e on w.source is not distinct from e.source),
f as (select sid, 0::bigint as nth, floor(target - epochs * source_size)::bigint as room, false as fits from e
  union all select k.sid, k.nth::bigint, case when k.size <= f.room then f.room - k.size else f.room end::bigint, k.size <= f.room from f join k on k.sid = f.sid and k.nth = f.nth + 1)
select doc_id, size::bigint as size, source_size, target, (epochs * size + case when fits then size else 0 end)::bigint as taken, weight, epochs from k join f using (sid, nth)"""


def oracle_sql() -> dict[str, str]:
    """Tokenisers, models, similarity joins and substrings can't be said in SQL; tests/llm hold those against brute force."""
    return {"op7_sharding": _SHARDS, "op11_source_divergence": _DIVERGENCE, "op12_fill_in_middle": _MIDDLE, "op13_source_mix": _MIX}
