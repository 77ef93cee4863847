"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, bpe, decontaminate, line_dedup, ngram_join, pitman_yor, repeats, sharding, token_records, weak_quality
from ._store import fresh_path, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ball_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines_gone", "text")


# Sets of tokens by line, one row for each distinct set; prefixes by rarity find the candidates, all of them verified.
OP2_SQL = r"""
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as part from documents where text is not null),
s as (
  select doc_id, line, part, list_sort(list_distinct(regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09\x0B-\x0D]+'))) as w from l),
f as (select w, min((doc_id, line)) as first, row_number() over () as id, len(w) as n from s where len(w) > 0 group by w),
e as (select id, n, first, unnest(w) as t from f),
c as (select t, count(*) as k from e group by t),
p as (select * from (select e.*, row_number() over (partition by id order by k, t) as i from e join c using (t)) where i <= n - ceil(n * 0.8) + 1),
late as (
  select distinct b.id from (
    select distinct x.id as a, y.id as b from p x join p y on x.t = y.t and x.first < y.first and least(x.n, y.n) * 5 >= greatest(x.n, y.n) * 4) m
  join f a on a.id = m.a join f b on b.id = m.b
  where len(list_intersect(a.w, b.w)) * 9 >= (a.n + b.n) * 4),
g as (
  select s.*, f.id is not null and (late.id is not null or (s.doc_id, s.line) <> f.first) as gone
  from s left join f on f.w = s.w left join late on late.id = f.id),
d as (select doc_id, count(*) filter (gone)::int as n_lines_gone, coalesce(string_agg(part, chr(10) order by line) filter (not gone), '') as text from g group by doc_id)
select d0.doc_id, coalesce(d.n_lines_gone, 0)::int as n_lines_gone, d.text from documents d0 left join d using (doc_id)
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') as w from documents),
g as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as g from w),
e as (select doc_id, unnest(g) as s from g),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as k from e x join e y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2)
  join g ga on ga.doc_id = a join g gb on gb.doc_id = b
  where 100 * k >= 85 * (len(ga.g) + len(gb.g) - k)),
reach as (select doc_id as a, doc_id as b from g union select r.a, l.b from reach r join links l on l.a = r.b)
select g.doc_id, len(g.g)::bigint as n_shingles, (select min(b) from reach where a = g.doc_id) as component_id from g
"""


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    token_records.write_records(_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    read = token_records.read_records(spark, path)
    kept = stored(read.select("file", "record", "offset", "length", "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "index")
    token_records.write_index(kept, path + "-index")
    return token_records.add_starts(kept).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weak_quality.score(docs, weak_quality.fit(docs))


def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    both = bpe.decode_ids(bpe.encode_texts(_table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(_table(spark, sf_dir, "documents"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ball_tree": op1_ball_tree,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_records": op4_token_records,
    "op5_weak_quality": op5_weak_quality,
    "op6_run_index": op6_run_index,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_shards": op9_shards,
    "op10_pitman_yor": op10_pitman_yor,
}

ORACLE_SQL: dict[str, str] = {"op1_ball_tree": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL}
