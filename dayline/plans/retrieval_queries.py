"""Queries of retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.operators import retrieval as R
from dayline.plans.fixtures import table

K = 5
r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


#: Columns of the corpus that hits carry.
_META = ["id", "category", "source"]


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("category"), (F.col("vec_id") % 40).alias("source"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("wanted"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The K nearest rows of each query among all others, with what is known of both."""
    q, c = _queries(spark, d), _corpus(spark, d)
    return R.vector_topk(q, c, K, skip_self=True).join(c.select(*_META), "id").join(q.select("query_id", "wanted"), "query_id").withColumn("hit", F.col("category") == F.col("wanted"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


def q_chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return R.chunk_pages(_pages(spark, d)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "pages", "chunk_id", "label", F.md5(F.col("content").cast("binary")).alias("digest"))


def q_assign_category(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("source < 'src5'").select("source", F.concat(F.lit("cat-"), "source").alias("category"))
    out = table(spark, d, "documents").select("doc_id", "source").join(known, "source", "left")
    return out.select("doc_id", F.coalesce("category", F.lit("Unknown")).alias("category"))


def q_token_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(R.token_set(F.col("text"))), " ").alias("tokens"))


def q_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("name"))
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title"))
    return R.fuzzy_match(files, titles).select("file_id", "title_id", *r6("score"))


def q_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "id", *r6("cosine"), "place")


#: Rows of a cell of the approximate search: the smallest table has several.
CELL = 64


def q_vector_topk_lsh(spark: SparkSession, d: str) -> DataFrame:
    """What an approximate search over several cells finds of each query's true neighbours, and how many of all rows it compares."""
    q, c = _queries(spark, d), _corpus(spark, d)
    index = R.CellIndex.fit(c, CELL)
    probes = index.probes_for(q, K, 0.95, skip_self=True)
    near = index.search(q, K, probes, skip_self=True).select("query_id", "id", F.lit(1).alias("found"))
    true = R.vector_topk(q, c, K, skip_self=True).select("query_id", "id").join(near, ["query_id", "id"], "left")
    per = true.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("found").alias("found"))
    whole = F.broadcast(per.agg((F.sum("found") / F.sum("wanted")).alias("recall")).join(index.sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells"))))  # one row
    return per.join(index.work(q, probes), "query_id").join(whole).withColumn("probes", F.lit(probes))


def _filtered(spark, d):
    q = _queries(spark, d)
    return R.vector_topk(q.withColumn("category", F.when(F.col("query_id") % 100 == 0, F.col("wanted")).otherwise(-1)), _corpus(spark, d), K, same="category", skip_self=True)


def q_topk_fallback(spark: SparkSession, d: str) -> DataFrame:
    whole = R.vector_topk(_queries(spark, d), _corpus(spark, d), K, skip_self=True)
    return R.with_fallback(_filtered(spark, d), whole).select("query_id", "id", *r6("cosine"), "place")


def q_nearest_category(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest category by the cosine of its mean vector, largest first, smallest label on ties."""
    e = table(spark, d, "embeddings").select("vec_id", "label", R.unit(F.col("embedding")).alias("u"))
    long = e.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    top = R.nearest_category(e.select(F.col("vec_id").alias("id"), F.col("u").alias("vector")), centres.select(F.col("label").alias("category"), "vector"))
    return top.select(F.col("id").alias("vec_id"), "category")


def q_retrieval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Up to four hits a source group over several queries, in order of query and place."""
    from pyspark.sql import Window

    h = _hits(spark, d).withColumn("person", F.floor(F.col("query_id") / 200))
    w = Window.partitionBy("person").orderBy("query_id", "place")
    return h.withColumn("n", F.row_number().over(w)).where("n <= 4").select("person", "n", "query_id", "id")


def q_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return R.hit_measures(_hits(spark, d), K).select("query_id", *r6("precision_k", "precision_returned"))


def q_mrr(spark: SparkSession, d: str) -> DataFrame:
    return R.hit_measures(_hits(spark, d), K).select("query_id", *r6("mrr"))


def q_retrieval_shape(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieval_shape(_hits(spark, d)).select("query_id", *r6("avg_similarity", "top_similarity", "concentration"), "unique_sources")


def q_keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    words = ["the", "ing", "tion", "idiot", "ment"]
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("hits"), F.round(F.size(found) / len(words), 6).alias("rate"))


def q_retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    h = R.hit_measures(_hits(spark, d), K).join(_queries(spark, d).select("query_id", "wanted"), "query_id")
    s = h.rollup("wanted").agg(F.count(F.lit(1)).alias("n"), F.avg("precision_k").alias("precision_k"), F.avg("mrr").alias("mrr"))
    return s.select(F.coalesce(F.col("wanted").cast("string"), F.lit("all")).alias("category"), "n", *r6("precision_k", "mrr"))


def q_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).groupBy("query_id").agg(F.round(F.min(1 - F.col("cosine")), 6).alias("best"), F.round(F.avg(1 - F.col("cosine")), 6).alias("mean"))


def _responses(spark, d):
    """Answers of three kinds made of the whole text of a turn: JSON with a score from it, the text itself, and text after a number."""
    n = F.length("text") % 10
    digit = F.concat(F.lit("0."), n.cast("string"))
    k = F.col("turn") % 3
    response = F.when(k == 0, F.concat(F.lit('{"score": '), digit, F.lit("}"))).when(k == 1, F.col("text")).otherwise(F.concat(F.lit("I give "), digit, F.lit(": "), F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", response.alias("response"))


def q_judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("conv_id", "turn", F.round(R.judge_score(F.col("response")), 6).alias("score"))


def q_judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).withColumn("s", R.judge_score(F.col("response"))).groupBy("role").agg(F.count("s").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


def q_context_pack(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select(F.col("conv_id").alias("pid"), F.col("turn").alias("place"), "text")
    return R.pack_context(e).select("pid", "entries", "chars", F.md5(F.col("context").cast("binary")).alias("digest"))


def q_corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_U = "list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))"
_TOP = f"""with e as (select vec_id, label, {_U} as u from embeddings),
s as (select q.vec_id as query_id, q.label as wanted, c.vec_id as id, c.label as category, c.vec_id % 40 as source, round(list_dot_product(q.u, c.u), 9) as cosine from e q, e c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
h as (select *, category = wanted as hit from (select *, row_number() over (partition by query_id order by cosine desc, id) as place from s) where place <= {K}),
m as (select query_id, any_value(wanted) as wanted, count(*) filter (hit) / {K}::double as precision_k, count(*) filter (hit) / count(*)::double as precision_returned, coalesce(1 / min(place) filter (hit)::double, 0) as mrr from h group by query_id) """
_RESP = r"""(select conv_id, turn, role, case when g is not null then greatest(0, least(1, g)) end as s from (
  select *, try_cast(case when turn % 3 = 1 then regexp_extract(text, '(?:^|[^0-9.])(0(?:\.[0-9]+)?|1(?:\.0+)?)(?:[^0-9.]|$)', 1) else '0.' || (length(text) % 10) end as double) as g from conversations))"""
SQL = {
    "chunk_pages": r"""select doc_id, chunk, count(*)::int as pages, doc_id || '-' || chunk as chunk_id, case when regexp_matches(string_agg(t, chr(10) || chr(10) order by i), '^[^\n]*[0-9A-Za-z_]') then left(arg_min(t, i), 80) else 'untitled' end as label, md5(string_agg(t, chr(10) || chr(10) order by i)) as digest from (
      select doc_id, i, i // 6 as chunk, trim(p, ' ') as t from (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)) where t <> '' group by doc_id, chunk""",
    "assign_category": "select doc_id, case when source < 'src5' then 'cat-' || source else 'Unknown' end as category from documents",
    "token_sets": "select item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') as tokens from benchmark",
    "fuzzy_match": """with f as (select doc_id as file_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as ft from documents),
t as (select item_id as title_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as tt from benchmark)
select file_id, title_id, round(score, 6) as score from (select *, row_number() over (partition by file_id order by score desc, title_id) as rn from (select file_id, title_id, len(list_intersect(ft, tt)) / len(ft)::double as score from f, t where len(ft) > 0) where score >= 0.3) where rn = 1""",
    "vector_topk": _TOP + "select query_id, id, round(cosine, 6) as cosine, place from h",
    "topk_fallback": _TOP + f"select query_id, id, round(cosine, 6) as cosine, place from (select *, row_number() over (partition by query_id order by cosine desc, id) as place from s where query_id % 100 <> 0 or category = wanted) where place <= {K}",
    "nearest_category": f"""with e as (select vec_id, label, {_U} as u from embeddings), l as (select label, i, avg(x) as x from (select label, unnest(u) as x, generate_subscripts(u, 1) as i from e) group by all),
c as (select label, list(x order by i) as v from l group by label), cu as (select label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from c)
select vec_id, label as category from (select vec_id, c.label, row_number() over (partition by vec_id order by round(list_dot_product(u, v), 9) desc, c.label) as rn from e, cu c) where rn = 1""",
    "retrieval_merge": _TOP + "select query_id // 200 as person, n, query_id, id from (select *, row_number() over (partition by query_id // 200 order by query_id, place) as n from h) where n <= 4",
    "precision_at_k": _TOP + "select query_id, round(precision_k, 6) as precision_k, round(precision_returned, 6) as precision_returned from m",
    "mrr": _TOP + "select query_id, round(mrr, 6) as mrr from m",
    "retrieval_shape": _TOP + "select query_id, round(sum(s) / sum(c), 6) as avg_similarity, round(max(m), 6) as top_similarity, round(max(c) / sum(c), 6)::double as concentration, count(*) as unique_sources from (select query_id, source, count(*) as c, sum(cosine) as s, max(cosine) as m from h group by all) group by query_id",
    "keyword_hits": "select doc_id, len(list_filter(['the', 'ing', 'tion', 'idiot', 'ment'], lambda w: contains(lower(text), w)))::int as hits, round(len(list_filter(['the', 'ing', 'tion', 'idiot', 'ment'], lambda w: contains(lower(text), w))) / 5.0, 6)::double as rate from documents",
    "retrieval_summary": _TOP + "select coalesce(wanted::varchar, 'all') as category, count(*) as n, round(avg(precision_k), 6) as precision_k, round(avg(mrr), 6) as mrr from m group by rollup (wanted)",
    "distance_summary": _TOP + "select query_id, round(min(1 - cosine), 6) as best, round(avg(1 - cosine), 6) as mean from h group by query_id",
    "judge_scores": f"select conv_id, turn, round(s, 6)::double as score from {_RESP}",
    "judge_summary": f"select role, count(s) as n, round(avg(s), 6) as mean from {_RESP} group by role",
    "context_pack": "select conv_id as pid, count(*) as entries, max(used)::bigint as chars, md5(string_agg(text, chr(10) order by turn)) as digest from (select *, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as used from conversations) where used <= 6000 group by conv_id",
    "corpus_profile": "select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*) as n from documents group by cube (lang, source)",
}
