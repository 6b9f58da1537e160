"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, htmltext, importance, langid, lines, mixing, outliers, pieces, quality, simhash, tokencount, topk, warc
from .shared import shipped

TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: The mixture asked for: the sources of the synthetic corpus in equal shares.
MIXTURE = {f"src{i}": 0.05 for i in range(20)}
SEED = 17


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(table(spark, sf_dir, "pages"))
    # what is asked for is in the headers, so payloads are stepped over
    return warc.read(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = pieces.decode(pieces.encode(docs, path, seed=SEED), path)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), MIXTURE, seed=SEED)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.split_and_identify(table(spark, sf_dir, "documents")).drop("spans")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), depth=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.align(table(spark, sf_dir, "documents"), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality, op2_html_text, op3_warc, op4_top_k, op5_pieces, op6_line_dedup, op7_quality_rules, op8_mixture, op9_token_counts, op10_simhash, op11_languages, op12_importance, op13_alignment)
    }


ORACLES: dict[str, str] = {
    "op8_mixture": """
with shares as (select 'src' || i as source, 0.05::double as w from range(20) t(i)),
n as (select source, count(*) as n from documents where source in (select source from shares) group by source),
rates as (select source, w / sum(w) over () * sum(n) over () / n as mean from n join shares using (source)),
steps as (
  select source, k, least(1.0, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) over (partition by source order by k)) as upto
  from rates, range(200) t(k)
),
u as (select *, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double as u from documents),
counted as (
  select u.*, case when source is null or source not in (select source from rates) then 1
    else (select count(*) from steps s where s.source = u.source and s.upto <= u.u) end as c
  from u
)
select doc_id, text, lang, source, n_chars, unnest(range(1, c + 1))::bigint as copy from counted
""",
    "op12_importance": r"""
with recursive steps as (
  select b::bigint as b, b::bigint as c, 0 as k from range(256) t(b)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), crc as (select list(c order by b) as crc from steps where k = 8),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from documents
), g as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as w from benchmark
), dw as (select doc_id, unnest(words) as w from d),
hexed as (select w, hex(encode(w)) as x from (select w from dw union select w from g)),
bytes as (select w, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint) as bytes from hexed),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from bytes, crc
),
s as (select bucket, count(*) as n from dw join hashed using (w) group by bucket),
t as (select bucket, count(*) as n from g join hashed using (w) group by bucket),
gains as (
  select b.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double) / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
  from (select bucket::bigint as bucket from range(10000) r(bucket)) b left join s using (bucket) left join t using (bucket)
),
w as (select doc_id, count(*) as n, sum(gain) as gain from dw join hashed using (w) join gains using (bucket) group by doc_id),
scored as (
  select d.doc_id, coalesce(w.n, 0)::bigint as n_features, coalesce(floor(w.gain::double / w.n), 0)::bigint as weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h
  from d left join w using (doc_id)
),
noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from scored),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from noisy where n_features >= 20
)
select doc_id, n_features, weight, score, rank::bigint as rank
from noisy left join (select * from drawn where rank <= (select 10 * count(*) // 100 from drawn)) using (doc_id)
""",
    "op4_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""",
}
