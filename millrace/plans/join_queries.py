"""Joins, similarity and trace lookups over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import corpus, groups, joins, similarity
from ..operators.ordering import row_total, with_position
from ..session import cut_lineage
from . import sqltext as q
from .group_queries import RO, rollouts, steps
from .registry import query, table

TRACES = """traces as (select event_id as id, event_type as context_type, 'user' || user_id % 5 as namespace, user_id as session_uid, epoch(ts) as created_at from events)"""
SINCE = 1704153600.0  # 2024-01-02


def traces(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("context_type"),
        F.concat(F.lit("user"), F.pmod("user_id", F.lit(5)).cast("string")).alias("namespace"),
        F.col("ts").cast("timestamp").cast("double").alias("created_at"),
    )


def bridge(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("trace_id"), F.col("user_id").alias("session_uid"), F.col("ts").cast("timestamp").cast("double").alias("created_at")
    )


@query(
    "j1_judge_predictions",
    """
    select o_orderkey, o_orderpriority as category, o_orderstatus = l_linestatus as correct, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey group by all
    """,
)
def _(spark, d):
    predictions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    golds = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("category"))
    judged = joins.judge_predictions(predictions, golds, "o_orderkey", "l_linestatus", "o_orderstatus")
    return judged.groupBy("o_orderkey", "category", "correct").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j2_session_traces",
    f"""
    with {TRACES} select id, context_type, namespace from traces
    where session_uid in (1, 2, 3, 5, 8) and created_at >= {SINCE} and context_type in ('click', 'view') and namespace <> 'user4'
    """,
)
def _(spark, d):
    out = joins.session_traces(
        traces(spark, d), bridge(spark, d), [1, 2, 3, 5, 8], SINCE, ["click", "view"], [f"user{i}" for i in range(4)]
    )
    return out.select("id", "context_type", "namespace")


@query(
    "j2_latest_traces",
    f"with {TRACES} select id, context_type from traces where session_uid < 20 order by created_at desc, id limit 50",
)
def _(spark, d):
    sessions = bridge(spark, d).filter("session_uid < 20").select("session_uid").distinct()
    return joins.session_traces(traces(spark, d), bridge(spark, d), sessions, limit=50).select("id", "context_type")


@query("j3_trace_sessions", "select distinct user_id as session_uid from events where event_id = 17")
def _(spark, d):
    return joins.trace_sessions(bridge(spark, d), 17)


@query(
    "j4_drop_tasks",
    f"with {RO} select task, sample from ro where task not in (select task from ro group by 1 having not bool_or(correct))",
)
def _(spark, d):
    rows = rollouts(spark, d)
    unsolved = groups.solve_classes(rows, "task", F.col("correct")).filter("not any_correct")
    return joins.drop_tasks(rows, unsolved, "task").select("task", "sample")


@query(
    "j5_surviving_steps",
    f"""
    with {RO}, s as (select *, step = max(step) over (partition by task) as is_last from ro)
    select task, sample from s where not is_last and task in (select task from s where is_last and correct)
    """,
)
def _(spark, d):
    s = groups.with_group_stats(steps(spark, d), ["task"], last=F.max("step"))
    s = s.withColumn("is_last", F.col("step") == F.col("last"))
    kept = s.filter("is_last and correct")
    return joins.surviving_steps(s, kept, ["task"]).select("task", "sample")


@query(
    "j6_last_step_advantage",
    f"""
    with {RO}, l as (select sample, last_value(reward) over (partition by task order by step rows between unbounded preceding and unbounded following) as advantage from ro)
    select sample, advantage from l
    """,
)
def _(spark, d):
    s = groups.with_group_stats(steps(spark, d), ["task"], n_steps=F.count(F.lit(1)))
    last = s.filter(F.col("step") == F.col("n_steps") - 1).withColumn("advantage", F.col("reward"))
    return groups.broadcast_last_step(s, ["task"], last).select("sample", "advantage")


@query(
    "j7_nearest_other_label",
    """
    with p as (select a.vec_id as query, b.vec_id as neighbour, list_distance(a.embedding::double[], b.embedding::double[]) as d
               from embeddings a join embeddings b on a.label <> b.label),
    r as (select *, row_number() over (partition by query order by d, neighbour) as rank from p)
    select query, rank::int as rank, neighbour, round(d, 5) as score from r where rank <= 5
    """,
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    found = similarity.nearest(vectors, vectors, "vec_id", "embedding", 5, group="label")
    return found.select("query", "rank", "neighbour", F.round("score", 5).alias("score"))


@query(
    "j10_top_inner_product",
    """
    with p as (select a.vec_id as query, b.vec_id as neighbour, list_inner_product(a.embedding::double[], b.embedding::double[]) as s
               from embeddings a join embeddings b on a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by query order by s desc, neighbour) as rank from p)
    select query, rank::int as rank, neighbour, round(s, 5) as score from r where rank <= 3
    """,
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    found = similarity.nearest(vectors, vectors, "vec_id", "embedding", 3, group="vec_id", metric="ip")
    return found.select("query", "rank", "neighbour", F.round("score", 5).alias("score"))


@query(
    "j7_padded_neighbours",
    """
    with p as (select a.vec_id as query, b.vec_id as neighbour, list_inner_product(a.embedding::double[], b.embedding::double[]) as s
               from embeddings a join embeddings b on a.label <> b.label),
    r as (select *, row_number() over (partition by query order by s desc, neighbour) as rank from p),
    l as (select query, list(neighbour order by rank) as n from r where rank <= 6 group by 1)
    select vec_id as query, array_to_string(list_resize(coalesce(n, []), 6, -1::bigint), ',') as neighbours from embeddings left join l on vec_id = query
    """,
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    found = similarity.nearest(vectors, vectors, "vec_id", "embedding", 6, group="label", metric="ip")
    return similarity.padded_neighbours(found, vectors, "vec_id", 6).withColumn("neighbours", F.array_join("neighbours", ","))


@query(
    "j7_padded_whole_table",
    """
    with p as (select a.vec_id as query, b.vec_id as neighbour, list_distance(a.embedding::double[], b.embedding::double[]) as d
               from embeddings a join embeddings b on a.label <> b.label),
    r as (select *, row_number() over (partition by query order by d, neighbour) as rank from p),
    l as (select query, list(neighbour order by rank) as n from r where rank <= 4 group by 1)
    select vec_id as query, array_to_string(list_resize(coalesce(n, []), 4, -1::bigint), ',') as neighbours from embeddings left join l on vec_id = query
    """,
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    found = similarity.nearest(vectors, vectors, "vec_id", "embedding", 4, group="label")
    return similarity.padded_neighbours(found, vectors, "vec_id", 4).withColumn("neighbours", F.array_join("neighbours", ","))


SIZED = f"sized as (select doc_id, {q.words('text')} as w from documents)"


@query(
    "j8_continuations",
    f"""
    with {SIZED}, c as (select doc_id, unnest(range(0, len(w), 64)) as s, w from sized),
    k as (select row_number() over (order by doc_id, s) - 1 as chunk_id, array_to_string(w[s + 1 : s + 64], ' ') as t, count(*) over () as n from c),
    nb as (select chunk_id as query, r as rank, (chunk_id * 13 + r) % n as neighbour, n from k, (select unnest([0, 1]) as r)),
    p as (select query, rank, neighbour, x, (neighbour + x) % n as chunk_id from nb, (select unnest([0, 1]) as x)),
    j as (select p.*, k.t from p join k using (chunk_id))
    select query, md5(string_agg(neighbour || '=' || t, '|' order by rank, x)) as texts from (select query, rank, neighbour, 0 as x, string_agg(t, ' ' order by x) as t from j group by 1, 2, 3) group by 1
    """,
)
def _(spark, d):
    from ..functions.text import words

    docs = table(spark, d, "documents").select("doc_id", words("text").alias("w"))
    sized = docs.withColumn("n_tokens", F.size("w").cast("bigint"))
    cut = corpus.chunk_documents(sized, "doc_id", 64, ["w"])
    # Chunk ids follow (document, chunk); a document has under 2**20 chunks. A chunk goes on with its own words only, and words
    # hold no space: chunks are read several times, so they are written out once, as text.
    own = F.array_join(F.slice("w", (F.col("token_start") + 1).cast("int"), F.lit(64)), " ")
    keyed = cut_lineage(cut.select((F.col("doc_id") * (1 << 20) + F.col("chunk")).alias("ck"), own.alias("t")))
    chunks = with_position(keyed, "ck", "chunk_id").select("chunk_id", F.col("t").alias("tokens"))
    n = row_total(keyed)
    rank = F.explode(F.array(F.lit(0), F.lit(1))).alias("rank")
    wanted = chunks.select(F.col("chunk_id").alias("query"), rank).withColumn("neighbour", F.pmod(F.col("query") * 13 + F.col("rank"), n))
    made = joins.with_continuations(wanted, chunks, n, 2, lambda t: F.split(t, " "))
    shown = F.transform("neighbours", lambda x: F.concat(x["neighbour"].cast("string"), F.lit("="), F.array_join(x["tokens"], " ")))
    return made.select("query", F.md5(F.array_join(shown, "|")).alias("texts"))


@query("j9_column_union", "select doc_id as pos, lang, source from documents")
def _(spark, d):
    from ..operators import batch

    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "pos")
    return batch.union_columns(docs.select("pos", "lang", "n_chars"), docs.select("pos", "source", "n_chars")).select("pos", "lang", "source")


# Word 3-gram sets, as SQL sees them.
def _grams(key, relation):
    return f"""
      (with w as (select {key} as id, {q.words('lower(text)')} as w from {relation}),
       e as (select id, unnest(w) as x, generate_subscripts(w, 1) as i, len(w) as n from w),
       g as (select id, n, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o as g from e window o as (partition by id order by i))
       select distinct id, g from g where g is not null
       union select id, array_to_string(w, ' ') from w where len(w) between 1 and 2)"""


@query(
    "j11_decontaminate",
    f"""
    with a as {_grams('doc_id', 'documents')}, b as {_grams('item_id', 'benchmark')},
    an as (select id, count(*) as n from a group by 1), bn as (select id, count(*) as n from b group by 1),
    s as (select a.id as doc_id, b.id as item, count(*) as c from a join b using (g) group by 1, 2),
    hit as (select distinct doc_id from s join an on an.id = s.doc_id join bn on bn.id = s.item where c / (an.n + bn.n - c) > 0.2)
    select doc_id, source from documents where doc_id not in (select doc_id from hit)
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    clean = similarity.decontaminate(docs, "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", 0.2)
    return clean.select("doc_id", "source")


@query(
    "j12_drop_listed_errors",
    f"""
    with a as {_grams('doc_id', 'documents')},
    b as {_grams('doc_id', '(select doc_id, text from documents join labels using (doc_id) where quality = 0)')},
    an as (select id, count(*) as n from a group by 1),
    s as (select a.id as doc_id, b.id as item, count(*) as c from a join b using (g) group by 1, 2),
    r as (select doc_id, row_number() over (partition by item order by c / (x.n + y.n - c) desc, doc_id) as place, c / (x.n + y.n - c) as score
          from s join an x on x.id = s.doc_id join an y on y.id = s.item)
    select doc_id from documents where doc_id not in (select doc_id from r where place = 1 and score >= 0.99)
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    bad = docs.join(table(spark, d, "labels").filter("quality = 0"), "doc_id").select("text")
    return similarity.drop_listed_errors(docs, "doc_id", "text", bad, "text").select("doc_id")


@query(
    "d5_drop_near_duplicates",
    f"""
    with recursive a as materialized {_grams('doc_id', 'documents')}, an as (select id, count(*) as n from a group by 1),
    s as (select x.id as x, y.id as y, count(*) as c from a x join a y on x.g = y.g and x.id < y.id group by 1, 2),
    e as (select s.y, list(s.x) as earlier from s join an p on p.id = s.x join an r on r.id = s.y where c / (p.n + r.n - c) > 0.792 group by 1),
    o as materialized (select y, earlier, row_number() over (order by y) as i from e),
    pass as (select 0::bigint as i, []::bigint[] as gone
             union all
             select o.i, case when len(list_filter(o.earlier, lambda d: not list_contains(pass.gone, d))) > 0 then list_append(pass.gone, o.y) else pass.gone end
             from pass join o on o.i = pass.i + 1),
    removed as (select unnest(gone) as doc_id from (select gone from pass order by i desc limit 1))
    select doc_id, lang from documents where doc_id not in (select doc_id from removed)
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return similarity.drop_near_duplicates(docs, "doc_id", "text").select("doc_id", "lang")


@query(
    "j15_sample_negatives",
    "select conv_id || '-' || turn as id, least(7, (select count(distinct text) from conversations) - 1)::int as n, true as others_only from conversations",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.array("text").alias("positives"))
    drawn = joins.sample_negatives(rows, "id", "positives", 7).join(rows, "id")
    others_only = ~F.arrays_overlap("negatives", "positives") & (F.size(F.array_distinct("negatives")) == F.size("negatives"))
    return drawn.select("id", F.size("negatives").alias("n"), others_only.alias("others_only"))


@query(
    "j16_existing_media",
    "select page_id from pages where url in (select url from pages where page_id in (select doc_id from labels))",
)
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    listing = pages.join(table(spark, d, "labels"), F.col("page_id") == F.col("doc_id")).select(F.col("url").alias("path"))
    return joins.with_existing_media(pages, listing, "url").select("page_id")


def _letter_counts(texts):
    """A small stand-in embedder: letter frequencies."""
    return np.array([[t.lower().count(c) for c in "abcdefghijklmnop"] for t in texts])


@query(
    "c22_embed",
    """select item_id, array_to_string(list_transform(string_split('a b c d e f g h i j k l m n o p', ' '),
         lambda c: len(lower(text)) - len(replace(lower(text), c, ''))), ',') as counts from benchmark where item_id >= 5""",
)
def _(spark, d):
    items = table(spark, d, "benchmark")
    done = items.filter("item_id < 5")
    made = similarity.embed(items, "item_id", "text", _letter_counts, done)
    return made.select("item_id", F.array_join(F.transform("embedding", lambda x: x.cast("int")), ",").alias("counts"))


@query("c23_clusters")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    model = similarity.train_clusters(vectors, "vec_id", "embedding", 8, 2000)
    return similarity.assign_clusters(vectors, model, "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
