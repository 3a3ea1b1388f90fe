"""Sampling, set and batch-table operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch, dedup, sampling
from ..operators.ordering import row_total, with_position
from . import sqltext as q
from .registry import query, table

N_SOURCES = 20
MIX = {f"src{i}": float(i + 1) for i in range(N_SOURCES)}


def documents(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns)


def placed_documents(spark, d, *columns):
    return with_position(documents(spark, d, *columns), "doc_id")


PLACED = "placed as (select *, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)"


# --- sampling -----------------------------------------------------------------------------------


@query(
    "l1_sample_rows",
    f"""
    with p as (select doc_id, row_number() over (order by {q.shuffled('sample', 'doc_id')}, doc_id) - 1 as pos,
                      count(*) over () as n from documents),
    c as (select doc_id, 2500 // n + case when pos < 2500 % n then 1 else 0 end as k from p)
    select doc_id, cast(unnest(range(k)) as integer) as copy from c
    """,
)
def _(spark, d):
    return sampling.sample_rows(documents(spark, d), 2500, ["doc_id"])


@query(
    "l2_train_val_split",
    f"""
    with p as (select doc_id, row_number() over (order by {q.shuffled('split', 'doc_id')}, doc_id) - 1 as pos,
                      count(*) over () as n from documents),
    v as (select *, greatest(cast(floor(least(n, 1200) * 0.05::double) as bigint), 1) as nv from p),
    c as (select doc_id, case when pos < nv then 'val' else 'train' end as split,
                 case when pos < nv then 1
                      else (1200 - nv) // (n - nv) + case when pos - nv < (1200 - nv) % (n - nv) then 1 else 0 end end as k
          from v)
    select doc_id, split, k as n_copies from c where k > 0
    """,
)
def _(spark, d):
    split = sampling.train_val_split(documents(spark, d), 0.05, ["doc_id"], n=1200)
    return split.groupBy("doc_id", "split").agg(F.count(F.lit(1)).alias("n_copies"))


@query(
    "l3_shuffled_ratio_split",
    f"""
    with p as (select doc_id, row_number() over (order by {q.shuffled('shuffle', 'doc_id')}, doc_id) - 1 as pos,
                      cast(floor(count(*) over () * 0.9::double) as bigint) as k from documents)
    select doc_id, case when pos < k then 'train' else 'test' end as split,
           case when pos < k then pos else pos - k end as "index" from p
    """,
)
def _(spark, d):
    return sampling.shuffled_ratio_split(documents(spark, d), 0.9, ["doc_id"])


@query(
    "l4_percent_slice",
    """
    with p as (select event_id, user_id, row_number() over (order by event_id) - 1 as pos, count(*) over () as n from events)
    select event_id, user_id from p where pos >= round_even(n * 25.0 / 100, 0) and pos < round_even(n * 75.5 / 100, 0)
    """,
)
def _(spark, d):
    return sampling.percent_slice(table(spark, d, "events").select("event_id", "user_id"), 25, 75.5, "event_id")


@query(
    "l5_shuffle",
    f"select o_orderkey, row_number() over (order by {q.shuffled('shuffle', 'o_orderkey')}, o_orderkey) - 1 as pos from orders",
)
def _(spark, d):
    return sampling.shuffle_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


def _mix_sql():
    total, edge, cases = sum(MIX.values()), 0.0, []
    for name in list(MIX)[:-1]:
        edge += MIX[name] / total
        cases.append(f"when u < {edge!r}::double then '{name}'")
    return f"case {' '.join(cases)} else '{list(MIX)[-1]}' end"


@query(
    "l6_interleave",
    f"""
    with sizes as (select source, count(*) as n from documents group by 1),
    grid as (select range as pos, {q.unit('interleave', 'range')} as u
             from range((select cast(sum(n) as bigint) from sizes))),
    drawn as (select pos, {_mix_sql()} as source from grid),
    turns as (select d.pos, d.source, row_number() over (partition by d.source order by d.pos) - 1 as turn, s.n
              from drawn d join sizes s using (source)),
    stop as (select min(pos) as p from turns where turn = n - 1),
    items as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as turn from documents)
    select t.pos, t.source, i.doc_id from turns t join items i using (source, turn), stop where t.pos <= stop.p
    """,
)
def _(spark, d):
    return sampling.interleave(documents(spark, d, "source"), "source", "doc_id", MIX).select("pos", "source", "doc_id")


@query(
    "l6_interleave_all_exhausted",
    f"""
    with sizes as (select source, count(*) as n from documents group by 1),
    grid as (select range as pos, {q.unit('interleave', 'range')} as u
             from range((select cast(50 * sum(n) as bigint) from sizes))),
    drawn as (select pos, {_mix_sql()} as source from grid),
    turns as (select d.pos, d.source, row_number() over (partition by d.source order by d.pos) - 1 as turn, s.n
              from drawn d join sizes s using (source)),
    stop as (select max(pos) as p from turns where turn = n - 1),
    items as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as turn from documents)
    select t.pos, t.source, i.doc_id from turns t join items i on i.source = t.source and i.turn = t.turn % t.n, stop where t.pos <= stop.p
    """,
)
def _(spark, d):
    return sampling.interleave(
        documents(spark, d, "source"), "source", "doc_id", MIX, stop="all_exhausted"
    ).select("pos", "source", "doc_id")


@query(
    "l7_repeat_rows",
    """
    with p as (select doc_id, row_number() over (order by doc_id) - 1 as pos from labels)
    select doc_id, pos * 3 + c as pos from p, (select unnest(range(3)) as c)
    """,
)
def _(spark, d):
    return sampling.repeat_rows(table(spark, d, "labels").select("doc_id"), 3, "doc_id").select("doc_id", "pos")


@query(
    "l7_select_positions",
    f"""
    with {PLACED}, w as (select pos as out_pos, (pos * 7 + 3) % n as pos from placed)
    select w.out_pos, p.doc_id from w join placed p using (pos)
    """,
)
def _(spark, d):
    docs = documents(spark, d)
    n = row_total(docs)
    wanted = with_position(docs, "doc_id").select(F.col("pos").alias("out_pos"), F.pmod(F.col("pos") * 7 + 3, n).alias("pos"))
    return sampling.select_positions(docs, "doc_id", wanted).select("out_pos", "doc_id")


@query("l8_head", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sampling.head_rows(orders, 25, F.desc("o_totalprice"), "o_orderkey")


@query("l9_upsample", "select item_id, cast(unnest(range(20)) as integer) as copy from benchmark")
def _(spark, d):
    return sampling.upsample(table(spark, d, "benchmark").select("item_id"), 20)


@query(
    "l10_top_row_per_group",
    """
    select conv_id, turn, role from conversations
    qualify row_number() over (partition by conv_id order by turn desc, length(text) desc) = 1
    """,
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("score"))
    return sampling.top_per_group(rows, ["conv_id"], [F.desc("turn"), F.desc("score")]).select("conv_id", "turn", "role")


# --- sets ---------------------------------------------------------------------------------------


@query(
    "d1_union",
    """
    select cast(id as bigint) as id, lang, md5(text) as text_md5 from (
      select doc_id as id, lang, text from documents union all select item_id, null, text from benchmark)
    """,
)
def _(spark, d):
    docs = documents(spark, d, "lang", "text").withColumnRenamed("doc_id", "id")
    items = table(spark, d, "benchmark").withColumnRenamed("item_id", "id")
    return dedup.union_all([docs, items]).select("id", "lang", F.md5("text").alias("text_md5"))


@query(
    "d2_first_per_prompt",
    "select doc_id, source from documents qualify row_number() over (partition by text, lang order by doc_id) = 1",
)
def _(spark, d):
    docs = documents(spark, d, "source", "lang", "text")
    return dedup.first_per_key(docs, dedup.fingerprint("text", "lang"), ["doc_id"]).select("doc_id", "source")


@query(
    "d3_first_prediction",
    """
    select l_orderkey, l_linenumber, l_partkey from lineitem
    qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1
    """,
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return dedup.first_per_key(lines, F.col("l_orderkey"), order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("d4_distinct_episodes", "select distinct user_id, event_type from events")
def _(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@query(
    "d6_common_names",
    """
    select n_name from nation where n_nationkey in (select c_nationkey from customer)
      and n_nationkey in (select s_nationkey from supplier)
    """,
)
def _(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return dedup.common_names(customers, suppliers, "n_name")


@query("d7_epochs_union", "select vec_id, cast(unnest(range(3)) as integer) as epoch from embeddings")
def _(spark, d):
    return dedup.epochs_union(table(spark, d, "embeddings").select("vec_id"), 3)


# --- batch table --------------------------------------------------------------------------------


@query(
    "b1_select_rename",
    f"with {PLACED} select pos, doc_id as uid, lang from placed",
)
def _(spark, d):
    rest, popped = batch.pop_columns(placed_documents(spark, d, "lang", "source"), ["source"])
    del popped
    return batch.rename_columns(batch.select_columns(rest, ["doc_id", "lang"]), {"doc_id": "uid"})


@query(
    "b2_slice_and_mask",
    f"""
    with {PLACED}, s as (select (pos - 10) // 3 as pos, doc_id, lang from placed where pos >= 10 and (pos - 10) % 3 = 0)
    select pos, doc_id from s where lang = 'en'
    """,
)
def _(spark, d):
    rows = batch.slice_rows(placed_documents(spark, d, "lang"), 10, None, 3)
    return batch.select_mask(rows, F.col("lang") == "en").select("pos", "doc_id")


@query("b3_chunk", f"with {PLACED} select doc_id, cast(pos // (n // 5) as bigint) as chunk from placed")
def _(spark, d):
    return batch.chunk(placed_documents(spark, d), 5, strict=False).select("doc_id", "chunk")


@query(
    "b3_split_by_size",
    f"with {PLACED} select pos // 64 as chunk, count(*) as n, min(doc_id) as first_doc from placed group by 1",
)
def _(spark, d):
    chunks = batch.split_by_size(placed_documents(spark, d), 64)
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "b4_concat",
    f"""
    with {PLACED}, items as (select item_id, row_number() over (order by item_id) - 1 as pos from benchmark)
    select pos, doc_id as id from placed
    union all select pos + (select count(*) from documents), item_id from items
    """,
)
def _(spark, d):
    items = with_position(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id")
    return batch.concat([placed_documents(spark, d).withColumnRenamed("doc_id", "id"), items]).select("pos", "id")


@query("b5_reorder", f"with {PLACED} select n - 1 - pos as pos, doc_id from placed")
def _(spark, d):
    rows = placed_documents(spark, d)
    order = rows.select("pos", (row_total(rows) - 1 - F.col("pos")).alias("out_pos"))
    return batch.reorder(rows, order).select("pos", "doc_id")


@query(
    "b6_repeat",
    f"""
    with {PLACED}
    select doc_id, pos * 2 + c as adjacent, c * n + pos as tiled from placed, (select unnest(range(2)) as c)
    """,
)
def _(spark, d):
    rows = placed_documents(spark, d)
    adjacent = batch.repeat(rows, 2).select("doc_id", F.col("pos").alias("adjacent"))
    tiled = batch.repeat(rows, 2, interleaved=False).select(F.col("doc_id").alias("other"), F.col("pos").alias("tiled"))
    # Copy c of a row sits at 2*pos+c in one order and at c*n+pos in the other.
    n = row_total(rows)
    keyed = tiled.withColumn("copy", F.floor(F.col("tiled") / n))
    return adjacent.join(
        keyed, (F.col("doc_id") == F.col("other")) & (F.pmod("adjacent", F.lit(2)) == F.col("copy"))
    ).select("doc_id", "adjacent", "tiled")


@query(
    "b7_repeat_by_count",
    """
    with c as (select doc_id, quality * 2 + toxic as k from labels)
    select doc_id, cast(unnest(range(1, k + 1)) as integer) as copy from c
    """,
)
def _(spark, d):
    counted = table(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("k"))
    return batch.repeat_by_count(counted, "k").select("doc_id", "copy")


@query(
    "b8_pad_to_divisor",
    f"""
    with {PLACED} select pos, doc_id, false as is_pad from placed
    union all select n + pos, doc_id, true from placed where pos < (37 - n % 37) % 37
    """,
)
def _(spark, d):
    return batch.pad_to_divisor(placed_documents(spark, d), 37).select("pos", "doc_id", "is_pad")


@query(
    "b9_fold",
    f"""
    with {PLACED}
    select pos // 16 as pos, string_agg(doc_id::varchar, ',' order by pos) as docs from placed group by 1
    """,
)
def _(spark, d):
    folded = batch.fold(placed_documents(spark, d), 16)
    return folded.select("pos", F.array_join(F.transform("items", lambda i: i["doc_id"].cast("string")), ",").alias("docs"))


@query("b9_unfold", f"with {PLACED} select pos, doc_id from placed")
def _(spark, d):
    return batch.unfold(batch.fold(placed_documents(spark, d), 16)).select("pos", "doc_id")


@query(
    "b10_unfold_column",
    """
    select vec_id, cast(c as integer) as chunk, len(embedding[c * 16 + 1 : c * 16 + 16]) as n,
           round(list_sum(list_transform(embedding[c * 16 + 1 : c * 16 + 16], lambda x: x::double)), 6) as total
    from embeddings, (select unnest(range(4)) as c)
    """,
)
def _(spark, d):
    chunks = batch.unfold_column(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return chunks.select("vec_id", "chunk", F.size("embedding").cast("bigint").alias("n"), F.round(total, 6).alias("total"))


@query(
    "b11_union_columns",
    f"with {PLACED} select pos, doc_id, lang, source from placed",
)
def _(spark, d):
    return batch.union_columns(
        placed_documents(spark, d, "lang"), placed_documents(spark, d, "source")
    ).select("pos", "doc_id", "lang", "source")


@query(
    "b12_mini_batches",
    f"""
    with {PLACED}, e as (select *, cast(unnest(range(2)) as integer) as epoch from placed),
    s as (select epoch, doc_id,
                 row_number() over (partition by epoch order by {q.shuffled('mini', "epoch || '|' || pos")}, pos) - 1 as "at"
          from e)
    select epoch, "at", "at" // 48 as batch, doc_id from s
    """,
)
def _(spark, d):
    return batch.mini_batches(placed_documents(spark, d), 48, 2).select("epoch", "at", "batch", "doc_id")
