"""The registered queries of this subpackage and their SQL where SQL can say them.

Every query reads its whole tables, with the parameters that it would have in production.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, cross_polytope, hnsw, html_text, jaccard, langid, lexical, mixing, multi_index, packing, sharding, token_rollup, warc
from ._store import cut, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OLD, NEW = "word_bpe_49k", "byte_bpe_50k"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, take away exact copies, recount the rest with a newer tokenizer, and
    commit two of the batches again; totals are compacted on the way."""
    docs = _table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", "lang", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    base = cut(token_rollup.count_tokens(slim, {v: public_tokenizers.path(f"{v}.json") for v in (OLD, NEW)}), "rollup-counts")
    first = cut(base.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first")), "rollup-first")
    base = base.withColumn("tokenizer", F.lit(OLD)).withColumn("tokens", F.col(f"tokens_{OLD}"))
    marked = base.join(first, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)))
    marked = cut(marked.select(*token_rollup.KEYS, "tokens", f"tokens_{NEW}", "copy"), "rollup-marked")
    new = marked.where("not copy").select("source", "lang", F.lit(NEW).alias("tokenizer"), F.col(f"tokens_{NEW}").alias("tokens"))
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    batches = {
        "load": token_rollup.inserts(base),
        "copies": token_rollup.deletes(marked.where("copy")),
        "recount": token_rollup.revisions(marked.where("not copy"), new),
    }
    for name in ("load", "copies", "recount", "load", "copies"):
        rollup.commit(name, batches[name])
        if name == "copies":
            rollup.compact()
    return rollup.totals()


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), jaccard.Jaccard(words=3, percent=90))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return multi_index.hard_negatives(vectors.select("vec_id", values.alias("embedding"), label.alias("label")), "vec_id % 100 = 0")


def op12_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.language_scores(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (op1_html_extraction, op2_best_fit_packing, op3_token_counts, op4_nearest_neighbours, op5_mixing, op6_embedding_dedup, op7_language_id, op8_ngram_jaccard, op9_warc, op10_sharding, op11_hard_negatives, op12_bloom_lm, op13_ranked_search)
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 10))::bigint as hash from documents
), t as (
  select source, sum(size)::bigint as source_size, (case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight
  from s group by source
), u as (
  select *, 2.0::double * source_size as cap,
    (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
      / sum(weight) over (order by 2.0::double * source_size / weight, source asc nulls last rows between current row and unbounded following) as level from t
), v as (select *, max(case when level * weight < cap then level end) over () as water from u
), w as (select source, source_size, case when water is null then cap else least(cap, water * weight) end as target from v
), x as (
  select s.*, w.source_size, w.target, case when w.source_size > 0 then floor(w.target / w.source_size)::bigint else 0 end as whole,
    sum(s.size) over (partition by s.source order by s.hash range between unbounded preceding and current row) as upto
  from s join w on s.source is not distinct from w.source
)
select doc_id, size, source_size, target, ((whole + case when upto <= target - whole * source_size then 1 else 0 end) * size)::bigint as taken from x
"""

_COMPONENTS = """, reach as (
  select a as node, a as other from (select a from links union select b from links)
  union select r.node, l.b from reach r join (select a, b from links union all select b, a from links) l on r.other = l.a
), comp as (select node, min(other) as component from reach group by node)"""

OP6 = f"""
with recursive e as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id < b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9
){_COMPONENTS}, n as (select node, count(*) as links from (select a as node from links union all select b from links) group by node)
select vec_id, coalesce(n.links, 0)::bigint as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept
from embeddings left join comp on vec_id = comp.node left join n on vec_id = n.node
"""

OP8 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w
), n as (select doc_id, count(*) as n from s group by doc_id
), links as (
  select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * c >= 90 * (na.n + nb.n - c)
){_COMPONENTS}
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join comp on comp.node = w.doc_id
"""

OP9 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by payload_digest having count(*) > 1)
select page_id, payload_bytes, p.payload_digest, case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""


_WRAP = "18446744073709551616::hugeint"


def _times(a: str, k: int) -> str:
    """A product modulo 2**64, by halves that fit DuckDB's widest integer."""
    return f"(({a}) * {k % 2**32}::hugeint + ((({a}) * {k >> 32}::hugeint) % 4294967296::hugeint) * 4294967296::hugeint) % {_WRAP}"


def _folded(a: str, n: int) -> str:
    return f"xor(({a})::ubigint, (({a})::ubigint >> {n}))::hugeint"


OP10 = f"""
with recursive a as (select doc_id, coalesce(text, '') as text, ((coalesce(doc_id, 0)::hugeint + {0x9E3779B97F4A7C15}::hugeint) % {_WRAP} + {_WRAP}) % {_WRAP} as z from documents),
b as (select doc_id, text, {_times(_folded("z", 30), 0xBF58476D1CE4E5B9)} as z from a), c as (select doc_id, text, {_times(_folded("z", 27), 0x94D049BB133111EB)} as z from b),
k as (select doc_id, text, {_folded("z", 31)} as z from c),
j as (
  select n, doc_id, z, -1::bigint as here, 0::bigint as ahead from k, (select unnest([16, 17]) as n) union all
  select n, doc_id, next, ahead, floor((ahead + 1) * (2147483648::double / ((next::ubigint >> 33)::double + 1)))::bigint from (select n, doc_id, ahead, ({_times("z", 2862933555777941757)} + 1) % {_WRAP} as next from j where ahead < n)
), s as (select n, doc_id, max(here) as shard from j where ahead >= n group by n, doc_id
), t as (select list(c order by x) as t from (select x, list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, {0xEDB88320}) else c >> 1 end, x) as c from (select unnest(range(256)) as x))
), r as (select doc_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), {2**32 - 1}::bigint), {2**32 - 1})::bigint as text_crc32 from k, t)
select k.doc_id, strlen(text)::bigint + 1 as size, text_crc32, 'key' as law, p.shard::int as shard, (row_number() over (partition by p.shard order by k.doc_id) - 1)::bigint as slot, q.shard::int as grown_shard
from k join r on r.doc_id = k.doc_id join s p on p.doc_id = k.doc_id and p.n = 16 join s q on q.doc_id = k.doc_id and q.n = 17
"""


OP11 = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
    (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id))::int as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents), b as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
k as (select count_if(len(ts) > 0)::bigint as docs, sum(len(ts))::bigint as total from d),
p as (select r, t, count(*)::bigint as tf from (select r, unnest(ts) as t from d) where t in (select t from b) group by all),
w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from p, k group by t, docs),
s as (select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * docs) // total))))::bigint as score
  from b join p using (t) join w using (t) join d using (r), k group by item_id, doc_id, r),
o as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from o where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5, "op6_embedding_dedup": OP6, "op8_ngram_jaccard": OP8, "op9_warc": OP9, "op10_sharding": OP10, "op11_hard_negatives": OP11, "op13_ranked_search": OP13}
