"""The registered queries of the training-data operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, clustering, decontamination, media, mixing, near_duplicates, packing, quotations, secrets, token_files, topk, toxicity, wrappers
from .common import prepared, read_table, scratch_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(fn):
    _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
    return fn


@query
def op1_bit_sliced_top_k(spark, sf_dir):
    vectors = topk.quantised(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = topk.build_index(vectors)
    return topk.search(index, vectors.filter(F.col("id") % 50 == 0), 5)


_SQL["op1_bit_sliced_top_k"] = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x : floor(x::double * 256)) as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.r <> q.r and len(c.e) = len(q.e) where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s
) where rank <= 5
"""


@query
def op2_orc_tokens(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(token_files.encode_documents(read_table(spark, sf_dir, "documents")), path)
    return token_files.token_report(token_files.read_tokens(spark, path))


@query
def op3_page_wrappers(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    found = wrappers.extract(pages, wrappers.infer_wrappers(pages))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op4_layered_secrets(spark, sf_dir):
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("finds", lambda f: f["base"])

    def count(kind):
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.KINDS]
    digest = F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.span_text(F.col("finds")).alias("spans"))


@query
def op5_minhash_near_duplicates(spark, sf_dir):
    groups = near_duplicates.near_duplicate_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_toxicity(spark, sf_dir):
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces_of(read_table(spark, sf_dir, "documents")))


def quality_weights(spark, sf_dir):
    """Labelled quality as a sampling weight: good 2, bad 1/2; documents without a label weigh 1."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


@query
def op8_source_mix(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))


_SQL["op8_source_mix"] = r"""
with q as (
  select doc_id, max(case quality when 1 then 2.0 when 0 then 0.5 end) as quality from labels group by doc_id
), d as (
  select documents.doc_id, source, coalesce(q.quality, 1.0) as quality,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5('7|mix|' || documents.doc_id), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double) as e
  from documents left join q using (doc_id)
), s as (
  select source, sum(size)::bigint as source_size, sum(sum(size)) over () * 150 / 100.0::double as mix,
    [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as w
  from d group by source
), r as (
  select *, (mix - coalesce(sum(2.0::double * source_size) over (
      order by 2.0 * source_size / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 2.0 * source_size / w, encode(source) nulls last rows between current row and unbounded following) as rate
  from s
), t as (
  select source, source_size, least(2.0::double * source_size, w * coalesce((
      select rate from r where w * rate < 2 * source_size order by 2.0 * source_size / w, encode(source) nulls last limit 1
    ), 1e18::double)) as target
  from r
), p as (
  select d.*, t.source_size, t.target, floor(target)::bigint as budget,
    coalesce(sum(size) over (partition by d.source order by e / quality, doc_id
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source
)
select doc_id, source, size, source_size, target,
  case when source_size = 0 then 0
    else size * (budget // source_size) + greatest(0, least(size, budget % source_size - start)) end::bigint as taken
from p
"""


@query
def op9_quotation_links(spark, sf_dir):
    return quotations.reply_ordered(read_table(spark, sf_dir, "conversations"))


@query
def op10_media_sequences(spark, sf_dir):
    """Each text is the media payload of a page of its own, which refers to it by digest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    payload = media.padded(F.col("text"))
    digest = F.sha2(payload, 256)
    described = media.describe_media(media.store_media(docs.select(digest.alias("digest"), payload.alias("payload"))))
    page = F.concat(F.lit(f'<figure><img src="{media.SCHEME}'), digest, F.lit('"><figcaption>text</figcaption></figure>'))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    pages = docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("id"), page.alias("html"))
    found = media.resolve(media.sequences(pages, "id"), described)
    return found.select(
        "id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


@query
def op11_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.alignment_report(read_table(spark, sf_dir, "documents"))


@query
def op12_bisector_clusters(spark, sf_dir):
    vectors = clustering.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return clustering.cluster_report(*clustering.cluster(vectors))


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out: distances of all pairs in long form, the nearest, the exact floor of the mean."""
    parts = [
        """kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x : floor(x::double * 64)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0
), x as materialized (select r, unnest(e) as v, unnest(range(64)) as d from kept
), p0 as materialized (
  select c, unnest(e) as v, unnest(range(64)) as d from (
    select (row_number() over (order by sha256('1:' || vec_id) nulls last, e) - 1)::int as c, e from kept qualify c < %d)
)"""
        % k
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} as materialized (
  select r, c, distance from (
    select r, c, sum((x.v - p{i}.v) * (x.v - p{i}.v))::bigint as distance from x join p{i} using (d) group by r, c
  ) qualify row_number() over (partition by r order by distance, c) = 1
)"""
        )
        if i < rounds:
            parts.append(
                f"""p{i + 1} as materialized (
  select c, d, coalesce(m.v, p{i}.v) as v from p{i} left join (
    select c, d, ((s - ((s % n) + n) % n) // n)::bigint as v
    from (select c, d, sum(v)::bigint as s, count(*) as n from x join a{i} using (r) group by c, d)
  ) m using (c, d)
)"""
            )
    return (
        "with "
        + ", ".join(parts)
        + f"""
select vec_id, c as cluster, distance, (sum(distance) over (partition by c))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256
from kept join a{rounds} using (r) join (
  select c, sha256(string_agg(v::varchar, ',' order by d)) as centroid_sha256 from p{rounds} group by c
) using (c)
"""
    )


_SQL["op12_bisector_clusters"] = _cluster_sql()


@query
def op13_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL["op13_benchmark_decontamination"] = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), places as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows))
), found as (
  select r, i, n, item_id from places join windows using (n, win)
), hits as (
  select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r
), items as (
  select r, count(*) as n_items, string_agg(item, ',' order by encode(item)) as names
  from (select distinct r, item_id::varchar as item from found where item_id is not null) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join items using (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
