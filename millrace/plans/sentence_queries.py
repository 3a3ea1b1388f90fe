"""Sentences by a model of the corpus, over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, sentences
from ..session import spread
from .registry import query, table

GAPS = r"[ \t\n\r\f]"
BARE = r"regexp_replace({}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\p{{M}}.]+$', '', 'g')"
FORM = r"case when regexp_matches(regexp_replace({0}, '\.$', ''), '\p{{L}}') and not suffix(regexp_replace({0}, '\.$', ''), '.') then lower(regexp_replace({0}, '\.$', '')) end"

MODEL = rf"""
    raw as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as word from
      (select doc_id, list_filter(regexp_split_to_array(text, '{GAPS}+'), lambda x: x <> '') as w from documents)),
    bares as (select doc_id, i, word, {BARE.format("word")} as bare from raw),
    facts as (select doc_id, i, bare, {FORM.format("bare")} as form, suffix(bare, '.') as period,
      regexp_matches(word, '[.!?][^\p{{L}}\p{{N}}]*$') as ended from bares),
    behind as (select *, coalesce(lag(ended) over o, true) as after_end, case when lag(period) over o then lag(form) over o end as behind
      from facts window o as (partition by doc_id order by i)),
    pairs as (select form, behind, count(*) as n, count_if(period) as period, count_if(regexp_matches(bare, '^\p{{Ll}}')) as lower,
      count_if(regexp_matches(bare, '^\p{{Lu}}') and not after_end) as upper_inside from behind where form is not null group by 1, 2),
    forms as (select form, sum(n)::double as n, sum(period)::double as period, sum(lower)::double as lower, sum(upper_inside)::double as upper_inside,
      length(replace(form, '.', ''))::double as letters, length(form) - length(replace(form, '.', '')) + 1 as periods from pairs group by 1),
    totals as (select sum(n) as total, sum(period) / sum(n) as share from forms),
    scored as (select forms.*, total, case when period > 0 then 2 * (period * ln(0.99::double) + (n - period) * ln(1 - 0.99::double) - period * ln(share)
      - case when n > period then (n - period) * ln(1 - share) else 0 end) * periods * exp(-letters - (n - period) * ln(letters)) else 0 end as a_score from forms, totals),
    starts as (select form, sum(n)::double as starts from pairs where behind in (select form from scored where a_score < 0.3) group by 1),
    ends as (select coalesce(sum(period), 0)::double as e from scored where a_score < 0.3),
    cells as (select scored.*, coalesce(starts, 0) as s, e from scored left join starts using (form), ends),
    model as (select *, case when s * total > e * n then 2 * (
        case when s > 0 then s * ln(s * total / (e * n)) else 0 end
        + case when e - s > 0 then (e - s) * ln((e - s) * total / (e * (total - n))) else 0 end
        + case when n - s > 0 then (n - s) * ln((n - s) * total / ((total - e) * n)) else 0 end
        + case when total - e - n + s > 0 then (total - e - n + s) * ln((total - e - n + s) * total / ((total - e) * (total - n))) else 0 end)
      else 0 end as s_score from cells)
"""


@query(
    "c2_sentence_model",
    f"""
    with {MODEL}
    select form, period::bigint as with_period, (n - period)::bigint as without_period, lower::bigint as lower, upper_inside::bigint as upper_inside,
      s::bigint as starts, round(a_score, 4) as abbreviation_score, a_score >= 0.3 as abbreviation, round(s_score, 4) as starter_score, s_score >= 30 as starter
    from model
    """,
)
def _(spark, d):
    model = sentences.sentence_model(spread(table(spark, d, "documents")), "text")
    return model.withColumn("abbreviation_score", F.round("abbreviation_score", 4)).withColumn("starter_score", F.round("starter_score", 4))


@query(
    "c2_model_sentences",
    rf"""
    with {MODEL},
    cut as (select doc_id, generate_subscripts(p, 1) as i, unnest(p) as piece from
      (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])({GAPS})', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from documents)),
    followed as (select *, lead(piece) over (partition by doc_id order by i) as follower from cut),
    words as (select *, {BARE.format(r"regexp_extract(piece, '[^ \t\n\r\f]+$')")} as bare, {BARE.format(r"regexp_extract(follower, '^[ \t\n\r\f]*([^ \t\n\r\f]+)', 1)")} as next from followed),
    typed as (select doc_id, i, piece, follower, next, case when suffix(bare, '.') then {FORM.format("bare")} end as form, {FORM.format("next")} as next_form from words),
    decided as (select doc_id, i, piece, follower is not null and a.form is not null
        and not (regexp_matches(next, '^\p{{Lu}}') and coalesce(o.s_score >= 30 or (o.lower > 0 and o.upper_inside = 0), false)) as held
      from typed t left join model a on t.form = a.form and a.a_score >= 0.3 left join model o on t.next_form = o.form),
    numbered as (select *, coalesce(sum((not held)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from decided),
    made as (select doc_id, k, regexp_replace(string_agg(piece, '' order by i), '^{GAPS}+|{GAPS}+$', '', 'g') as s, count(*) - 1 as held from numbered group by 1, 2)
    select doc_id, count_if(s <> '') as n_sentences, sum(held)::bigint as n_held, md5(coalesce(string_agg(s, '|' order by k) filter (s <> ''), '')) as sentences from made group by 1
    """,
)
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    model = sentences.sentence_model(docs, "text")
    made = sentences.model_sentences(docs, "doc_id", "text", model).select(
        "doc_id", F.size("sentences").alias("n_made"), F.md5(F.array_join("sentences", "|")).alias("sentences")
    )
    rule = docs.select(F.col("doc_id").alias("r_id"), F.size(corpus.sentences("text")).alias("n_rule"))
    return made.join(rule, F.col("doc_id") == F.col("r_id")).select(
        "doc_id",
        F.col("n_made").cast("bigint").alias("n_sentences"),
        (F.col("n_rule") - F.col("n_made")).cast("bigint").alias("n_held"),
        "sentences",
    )
