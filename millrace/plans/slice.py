"""The first end-to-end query: clean, split and describe a labelled document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text, words
from ..operators.dedup import first_per_key
from ..operators.sampling import train_val_split
from . import sqltext as q
from .registry import query, table

MIN_TOKENS, MAX_TOKENS = 20, 20_000

@query(
    "clean_split_profile",
    f"""
    with good as (
      select d.doc_id, d.lang, {q.normal('text')} as norm
      from documents d join labels l on d.doc_id = l.doc_id
      where l.quality = 1 and l.toxic = 0),
    uniq as (select * from good qualify row_number() over (partition by md5(norm) order by doc_id) = 1),
    sized as (select doc_id, lang, len({q.words('norm')}) as n_tokens from uniq),
    kept as (select * from sized where n_tokens between {MIN_TOKENS} and {MAX_TOKENS}),
    placed as (select *, row_number() over (order by {q.shuffled('split', 'doc_id')}, doc_id) - 1 as pos,
                      count(*) over () as total from kept)
    select case when pos < greatest(cast(floor(total * 0.1::double) as bigint), 1) then 'val' else 'train' end as split,
           lang, count(*) as n_docs, cast(sum(n_tokens) as bigint) as n_tokens,
           round(avg(n_tokens), 6) as mean_tokens, round(stddev_pop(n_tokens), 6) as std_tokens
    from placed group by 1, 2
    """,
)
def clean_split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    good = docs.join(labels, "doc_id").withColumn("norm", normalize_text("text")).drop("text")
    unique = first_per_key(good, F.md5("norm"), ["doc_id"])
    sized = unique.select("doc_id", "lang", F.size(words("norm")).cast("bigint").alias("n_tokens"))
    kept = sized.filter(F.col("n_tokens").between(MIN_TOKENS, MAX_TOKENS))
    placed = train_val_split(kept, 0.1, ["doc_id"])
    return placed.groupBy("split", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.round(F.avg("n_tokens"), 6).alias("mean_tokens"),
        F.round(F.stddev_pop("n_tokens"), 6).alias("std_tokens"),
    )
