"""The thirteen registered queries, each an operator over its whole table, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import bpe, embed_dedup, exact_dedup, hmm, html_extract, langid, mixing, near_dedup, prefix_trie, sharding, token_alignment, toxicity, url_templates
from dayline.llm.common import held_out, staged

#: The tokenizer's file; a path that every worker can read.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The two vocabularies that are aligned.
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24
#: The rules of the URL filter.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.hmm_scores(docs.withColumn("held_out", held_out(F.col("doc_id"), 7)))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_and_decode(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, ~held_out(F.col("doc_id"), 4))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align_tokens(_table(spark, sf_dir, "documents"), BYTES, PIECES)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = staged(aligned.withColumn("groups_sha256", sha).drop("groups"), "aligned")
    return token_alignment.alignment_statistics(aligned, token_alignment.vocabulary_size(PIECES))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(_table(spark, sf_dir, "pages"), RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash_near_dedup, op2_hmm_scores, op3_byte_bpe, op4_embedding_near_dedup, op5_language_id, op6_source_mixing, op7_sharding, op8_exact_dedup, op9_toxicity, op10_html_extraction, op11_token_alignment, op12_prefix_trie, op13_url_templates)
    return {f.__name__: f for f in own}


MIXING_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as digest
  from documents),
g as (select *, length(size::varchar) * 1000 + left(size::varchar, 3)::int as grade, left(digest, 2) as slot from d),
s as (select source, sum(size)::bigint as source_size from g group by 1),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight,
             source_size::double * 3 as cap from s),
l as (select *, cap / weight as cpw,
             (sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
v as (select (select level from l where level < cpw order by cpw, source nulls last limit 1) as level),
t as (select source, source_size, coalesce(least(cap, weight * v.level), cap) as target,
             ('0x' || left(md5('mix|' || coalesce(source, '')), 8))::bigint / 4294967296.0::double as off from l, v),
r as (select *, case when source_size > 0 then least(3.0::double, target / source_size) else 0.0::double end as rate from t),
p as (select g.*, r.source_size, r.target, r.rate, r.off,
             row_number() over (partition by g.source order by g.grade, g.slot, g.digest, g.size, g.doc_id) as place
      from g join r on g.source is not distinct from r.source)
select doc_id, size, source_size, target,
       ((floor(place * rate + off) - floor((place - 1) * rate + off))::bigint * size)::bigint as taken
from p
"""

EXACT_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (
  select doc_id, norm, first_value(doc_id) over (partition by norm order by n desc, doc_id nulls last) as keep_id,
         count(*) over (partition by norm) as group_size from d)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256 from g
"""


TRIE_SQL = r"""
with recursive
crc as (
  select conv_id, xor(4294967295::bigint, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
           lambda acc, b: list_reduce(range(8)::bigint[], lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end, xor(acc, b)),
           4294967295::bigint)) % 9 as h
  from (select distinct conv_id from conversations where conv_id is not null)),
t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
         sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as code, strlen(coalesce(text, '')) as size
  from conversations where conv_id is not null),
r as (
  select c.conv_id, t.pos, 0 as own, t.code, t.size from crc c join t on t.conv_id = c.conv_id - c.conv_id % 5 and t.pos < c.h
  union all select c.conv_id, t.pos, 1, t.code, t.size from crc c join t on t.conv_id = c.conv_id and t.pos >= c.h),
seq as (
  select crc.conv_id, coalesce(list(code order by own, pos) filter (code is not null), []) as codes, coalesce(list(size order by own, pos) filter (code is not null), []) as sizes
  from crc left join r using (conv_id) group by 1),
p as (
  select conv_id, len(codes) as n, unnest(range(len(codes) + 1)) as depth, codes, sizes from seq),
q as (
  select conv_id, n, depth, md5(array_to_string(codes[1:depth], ',')) as node, case when depth > 0 then md5(array_to_string(codes[1:depth - 1], ',')) end as up,
         case when depth > 0 then sizes[depth] else 0 end as size from p),
nodes as (
  select depth, node, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends
  from q group by 1, 2),
kids as (select depth - 1 as depth, up as node, count(*) as n_children from nodes where depth > 0 group by 1, 2),
full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (depth, node)),
above as (
  select depth as anc_depth, node as anc, depth, node, up, (n_children = 0)::int as leaf, (n_convs - 1) * size as saved from full_
  union all select f.depth, f.node, a.depth, a.node, f.up, a.leaf, a.saved from above a join full_ f on f.depth = a.anc_depth - 1 and f.node = a.up),
sums as (select anc_depth as depth, anc as node, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above group by 1, 2)
select f.conv_id, f.depth::bigint as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) as ends_sha256
from full_ f join sums s using (depth, node) left join full_ u on u.depth = f.depth - 1 and u.node = f.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": MIXING_SQL, "op8_exact_dedup": EXACT_SQL, "op12_prefix_trie": TRIE_SQL}
