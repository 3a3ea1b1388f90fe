"""Text functions, rule rewards, answer scoring and filters over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, rewards, text
from ..operators import dedup, filters
from ..operators.ordering import value_offsets
from . import sqltext as q
from .registry import query, table


def documents(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns)


# Turns that answer the turn before them: prediction = this text, gold = the previous one.
PAIRS_SQL = """pairs as (
  select b.conv_id, b.turn, b.text as prediction, a.text as gold
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""


def turn_pairs(spark, d):
    turns = table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return turns.select("conv_id", "turn", F.col("text").alias("prediction")).join(before, ["conv_id", "turn"])


# A response per document: think block and answer tag, final number, or neither.
RESPONSE_SQL = """responses as (
  select doc_id, source, n_chars, lang, case
    when lang = 'en' then '<think>' || text || '</think> <answer>no</answer> <answer> The ' || source || '! </answer>'
    when lang = 'fr' then '<think>' || text || '</think><tool_call>{"q": "' || source || '"}</tool_call>'
    when lang = 'de' then text || chr(10) || '#### ' || n_chars || ',5' else text end as response from documents)"""


def responses(spark, d):
    docs = documents(spark, d, "source", "n_chars", "lang", "text")
    think = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"))
    response = (
        F.when(
            F.col("lang") == "en",
            F.concat(think, F.lit(" <answer>no</answer> <answer> The "), "source", F.lit("! </answer>")),
        )
        .when(F.col("lang") == "fr", F.concat(think, F.lit('<tool_call>{"q": "'), "source", F.lit('"}</tool_call>')))
        .when(F.col("lang") == "de", F.concat("text", F.lit("\n#### "), F.col("n_chars").cast("string"), F.lit(",5")))
        .otherwise(F.col("text"))
    )
    return docs.withColumn("response", response).drop("text")


# --- text ---------------------------------------------------------------------------------------


@query("x1_normalize_text", f"select doc_id, md5({q.normal('text')}) as norm from documents")
def _(spark, d):
    return documents(spark, d, "text").select("doc_id", F.md5(text.normalize_text("text")).alias("norm"))


@query("x2_normalize_answer", f"select doc_id, md5({q.answer('text')}) as norm from documents")
def _(spark, d):
    return documents(spark, d, "text").select("doc_id", F.md5(text.normalize_answer("text")).alias("norm"))


@query(
    "x3_exact_and_contained",
    f"""
    with p as (select p_partkey, p_name, case when p_size > 25 then ['the ' || upper(p_name) || '!', p_type]
                      else [p_type, string_split(p_name, ' ')[2]] end as golds from part)
    select p_partkey, len(list_filter(golds, lambda g: {q.answer('g')} = {q.answer('p_name')})) > 0 as exact,
           len(list_filter(golds, lambda g: contains({q.answer('p_name')}, {q.answer('g')}))) > 0 as contained
    from p
    """,
)
def _(spark, d):
    golds = F.when(
        F.col("p_size") > 25, F.array(F.concat(F.lit("the "), F.upper("p_name"), F.lit("!")), F.col("p_type"))
    ).otherwise(F.array(F.col("p_type"), F.get(F.split("p_name", " "), F.lit(1))))
    part = table(spark, d, "part").select("p_partkey", "p_name", golds.alias("golds"))
    return part.select(
        "p_partkey",
        answers.exact_match("p_name", "golds").alias("exact"),
        answers.contains_match("p_name", "golds").alias("contained"),
    )


F1_SQL = f"""
    norm as (select conv_id, turn, {q.answer('prediction')} as p, {q.answer('gold')} as g from pairs),
    pt as (select conv_id, turn, w, count(*) as c from (select conv_id, turn, unnest({q.words('p')}) as w from norm) group by all),
    gt as (select conv_id, turn, w, count(*) as c from (select conv_id, turn, unnest({q.words('g')}) as w from norm) group by all),
    same as (select conv_id, turn, sum(least(pt.c, gt.c)) as n from pt join gt using (conv_id, turn, w) group by all),
    pr as (select conv_id, turn, n / len({q.words('p')}) as pre, n / len({q.words('g')}) as rec from norm join same using (conv_id, turn)),
    f1s as (select n.conv_id, n.turn, coalesce(2 * pre * rec / (pre + rec), 0) as f1, coalesce(pre, 0) as pre,
                   coalesce(rec, 0) as rec from norm n left join pr using (conv_id, turn))"""


@query(
    "x4_token_f1",
    f"with {PAIRS_SQL}, {F1_SQL} select conv_id, turn, round(f1, 9) as f1, round(pre, 9) as pre, round(rec, 9) as rec from f1s",
)
def _(spark, d):
    scored = turn_pairs(spark, d).withColumn("s", answers.token_f1("prediction", "gold"))
    return scored.select(
        "conv_id",
        "turn",
        F.round("s.f1", 9).alias("f1"),
        F.round("s.precision", 9).alias("pre"),
        F.round("s.recall", 9).alias("rec"),
    )


@query(
    "x5_best_gold_reward",
    f"""
    with {PAIRS_SQL}, {F1_SQL}, best as (select conv_id, max(f1) as f1 from f1s group by 1)
    select conv_id, f1 >= 0.3 as is_correct, round(f1, 9) as score, round(case when f1 >= 0.3 then 2.0 * f1 else -1.0 end, 9) as reward
    from best
    """,
)
def _(spark, d):
    scored = turn_pairs(spark, d).select(
        "conv_id",
        answers.token_f1("prediction", "gold")["f1"].alias("f1"),
        answers.exact_match("prediction", F.array("gold")).alias("exact"),
    )
    best = scored.groupBy("conv_id").agg(F.max("f1").alias("f1"), F.bool_or("exact").alias("exact"))
    r = answers.best_gold_reward("exact", "f1", 2.0, -1.0)
    return best.select("conv_id", r.alias("r")).select(
        "conv_id", "r.is_correct", F.round("r.score", 9).alias("score"), F.round("r.reward", 9).alias("reward")
    )


@query(
    "x6_answer_tag",
    f"""
    with {RESPONSE_SQL}, t as (select doc_id, response, regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1) as tags,
      {q.collapse("regexp_replace(response, '(?is)<think>.*?</think>', ' ', 'g')")} as bare from responses)
    select doc_id, {q.strip('tags[-1]')} as last_tag,
           md5(coalesce({q.strip("nullif(regexp_extract_all(bare, '(?is)<answer>(.*?)</answer>', 1)[1], '')")}, bare)) as final
    from t
    """,
)
def _(spark, d):
    return responses(spark, d).select(
        "doc_id", answers.last_answer_tag("response").alias("last_tag"), F.md5(answers.final_answer("response")).alias("final")
    )


@query("x6_short_answer")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answers.short_answer("text").alias("answer"))


@query(
    "x7_final_number",
    f"""
    with {RESPONSE_SQL}, t as (select doc_id, n_chars, right(response, 300) as tail from responses),
    f as (select doc_id, n_chars, replace(regexp_extract_all(tail, '#### (\\-?[0-9.,]+)', 1)[-1], ',', '') as strict,
                 regexp_extract_all(tail, '(\\-?[0-9.,]+)', 1) as nums from t)
    select doc_id, strict, coalesce(list_filter(nums, lambda n: n <> '.')[-1], nums[1]) as flexible,
           case when strict is null then 0.0 when strict = n_chars || '5' then 1.0 else 0.1 end::double as score from f
    """,
)
def _(spark, d):
    gold = F.concat(F.col("n_chars").cast("string"), F.lit("5"))
    return responses(spark, d).select(
        "doc_id",
        answers.final_number("response").alias("strict"),
        answers.final_number("response", "flexible").alias("flexible"),
        answers.final_number_score("response", gold, format_score=0.1).alias("score"),
    )


@query(
    "x8_tag_penalised_score",
    f"""
    with {RESPONSE_SQL}, r as (select doc_id, source,
        response || repeat('<answer>', case when n_chars > 2000 then 12 else 0 end) as response from responses)
    select doc_id, case when not contains(response, '</answer>') then 0.0
                        when n_chars > 2000 then 0.25 else 1.0 end::double as score
    from r join documents using (doc_id)
    """,
)
def _(spark, d):
    extra = F.repeat(F.lit("<answer>"), F.when(F.col("n_chars") > 2000, 12).otherwise(0))
    rows = responses(spark, d).withColumn("response", F.concat("response", extra))
    return rows.select("doc_id", answers.tag_penalised_score("response", F.array("source")).alias("score"))


@query(
    "x9_format_reward",
    f"""
    with {RESPONSE_SQL}
    select doc_id, regexp_matches(response, '(?s)^<think>.*?</think>\\s*<answer>.*?</answer>$')::int::double as think_answer,
      regexp_matches(response, '(?s)^<think>.*?</think>\\s*(<tool_call>.*?</tool_call>|<answer>.*?</answer>)\\s*$')::int::double as think_action,
      0.0::double as react
    from responses
    """,
)
def _(spark, d):
    return responses(spark, d).select(
        "doc_id",
        rewards.format_reward("response").alias("think_answer"),
        rewards.format_reward("response", rewards.THINK_ACTION).alias("think_action"),
        rewards.format_reward("response", rewards.REACT).alias("react"),
    )


@query(
    "x10_cosine_length_reward",
    """
    select l.doc_id, round(case when quality = 1
      then 1.0 - 0.5 * (1 - cos(n_chars * pi() / 4000)) / 2 else -0.5 + 0.5 * (1 - cos(n_chars * pi() / 4000)) / 2 end, 9) as reward
    from labels l join documents d using (doc_id)
    """,
)
def _(spark, d):
    rows = table(spark, d, "labels").join(documents(spark, d, "n_chars"), "doc_id")
    r = rewards.cosine_length_reward(F.col("quality") == 1, "n_chars", max_len=4000)
    return rows.select("doc_id", F.round(r, 9).alias("reward"))


@query(
    "x11_repetition_penalty",
    f"""
    with w as (select doc_id, {q.words('lower(text)')} as w from documents),
    e as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
    g as (select doc_id, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o as g from e window o as (partition by doc_id order by i)),
    r as (select doc_id, count(distinct g) / nullif(count(g), 0) as share from g group by 1)
    select doc_id, round(coalesce((1 - share) * -1.0, 0), 9) as reward from documents left join r using (doc_id)
    """,
)
def _(spark, d):
    return documents(spark, d, "text").select("doc_id", F.round(text.repetition_penalty("text") + 0.0, 9).alias("reward"))


@query(
    "x12_soft_overlong",
    "select doc_id, round(least(-(n_chars - (3000 - 1000)) / 1000.0::double, 0.0), 9) as reward from documents",
)
def _(spark, d):
    return documents(spark, d, "n_chars").select("doc_id", F.round(rewards.soft_overlong("n_chars", 3000, 1000), 9).alias("reward"))


@query(
    "x13_countdown",
    """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, case when l_linenumber = 1 then 0.0 when l_linenumber in (2, 3) then 0.1
      when l_linenumber = 4 then 1.0 when l_linenumber = 5 then 0.1 else 1.0 end::double as score
    from lineitem
    """,
)
def _(spark, d):
    p, s, n = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    line = F.col("l_linenumber")
    equation = (
        F.when(line == 2, F.concat(p, F.lit(" + "), s))  # a number is missing
        .when(line == 3, F.concat(p, F.lit(" + "), s, F.lit(" + "), n, F.lit(" + "), n))  # one is used twice
        .when(line == 5, F.concat(p, F.lit(" + "), s, F.lit(" + x "), n))  # not arithmetic
        .otherwise(F.concat(F.lit("("), p, F.lit(" + "), s, F.lit(") * "), n))
    )
    response = F.when(line == 1, F.lit("no tag")).otherwise(F.concat(F.lit("Assistant: <answer>"), equation, F.lit("</answer>")))
    score = answers.countdown_score(
        response, (F.col("l_partkey") + F.col("l_suppkey")) * line, F.array("l_partkey", "l_suppkey", line.cast("bigint"))
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", score.alias("score")
    )


@query(
    "x14_anls",
    """
    with p as (select p_partkey, lower(p_name) as a, [lower(p_name) || 'x', lower(p_brand), lower(p_type)] as golds from part),
    s as (select p_partkey, list_transform(golds, lambda g: levenshtein(a, g) / greatest(length(a), length(g))) as ds from p)
    select p_partkey, round(list_max(list_transform(ds, lambda x: case when x < 0.5 then 1 - x else 0.0 end)), 9) as anls from s
    """,
)
def _(spark, d):
    golds = F.array(F.concat("p_name", F.lit("X ")), F.col("p_brand"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.round(answers.anls("p_name", golds), 9).alias("anls"))


@query(
    "x15_relaxed_accuracy",
    """
    select o_orderkey, case when o_orderpriority = '1-URGENT' then (o_orderstatus = 'F')::int
      else (o_totalprice between o_totalprice * (1 + o_custkey / 10000.0::double) * 0.95::double
                             and o_totalprice * (1 + o_custkey / 10000.0::double) * 1.05::double)::int end::double as acc
    from orders
    """,
)
def _(spark, d):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    price = F.col("o_totalprice")
    gold = F.when(urgent, F.lit("F%")).otherwise((price * (1 + F.col("o_custkey") / F.lit(10000.0))).cast("string"))
    prediction = F.when(urgent, F.col("o_orderstatus")).otherwise(price.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", answers.relaxed_accuracy(prediction, gold).alias("acc"))


@query(
    "x16_vote_accuracy",
    """
    select o_orderkey, round(least(1.0, (select count(*) from lineitem l where l.l_orderkey = o.o_orderkey and l.l_linestatus = o.o_orderstatus) / 3.0), 9) as acc
    from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)
    """,
)
def _(spark, d):
    # Votes are counted per value first, so an order with many lines stays a short array.
    votes = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("n"))
    golds = votes.groupBy("l_orderkey").agg(
        F.flatten(F.collect_list(F.array_repeat("l_linestatus", F.col("n").cast("int")))).alias("golds")
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    joined = orders.join(golds, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", F.round(answers.vote_accuracy("o_orderstatus", "golds"), 9).alias("acc"))


CHOICES = {"A": "there", "B": "and the", "C": "nicht", "D": "que"}


def choice_sql():
    bare = "text"
    for mark in ",.!?;:":
        bare = f"regexp_replace({bare}, '^[{mark}]+|[{mark}]+$', '', 'g')"
    bare = f"regexp_replace({bare}, '^['']+|['']+$', '', 'g')"

    def last(rules):
        """The choice whose mark comes last; the first of those at one place. ``rules`` are (letter, condition, haystack, mark)."""
        each = [
            f"case when {found} then {{'at': case when contains({hay}, '{mark}') then length({hay}) - instr(reverse({hay}), reverse('{mark}')) - length('{mark}') + 1 "
            f"else -1 end, 'first': {-i}, 'ch': '{ch}'}} end"
            for i, (ch, found, hay, mark) in enumerate(rules)
        ]
        return f"list_sort(list_filter([{', '.join(each)}], lambda x: x is not null), 'desc')[1].ch"

    bracketed = last([(ch, f"contains(r, '{ch})')", "r", f"({ch})") for ch in CHOICES])
    letters = last([(ch, f"contains(r, ' {ch} ')", "r", f" {ch} ") for ch in CHOICES])
    contents = last([(ch, f"contains(lower(r), '{said}') and len({q.words('r')}) > 5", "lower(r)", said) for ch, said in CHOICES.items()])
    return f"with t as (select doc_id, ' ' || {bare} || ' ' as r from documents) select doc_id, coalesce({bracketed}, {letters}, {contents}, 'A') as choice from t"


@query("x17_choice_answer", choice_sql())
def _(spark, d):
    options = F.array(*[F.lit(said) for said in CHOICES.values()])
    return documents(spark, d, "text").select("doc_id", answers.choice_answer("text", list(CHOICES), options).alias("choice"))


@query("x17_open_answer")
def _(spark, d):
    return turn_pairs(spark, d).select(
        "conv_id", "turn", answers.open_answer_correct("prediction", F.array(F.get(text.words("gold"), F.lit(0)))).alias("correct")
    )


@query(
    "x18_extract_action",
    f"""
    with {RESPONSE_SQL}
    select doc_id, case when contains(response, '<tool_call>') then 'tool_call' when contains(response, '<answer>') then 'final_answer' else 'reasoning' end as type,
      md5(case when contains(response, '<tool_call>') then trim(string_split(string_split(response, '<tool_call>')[2], '</tool_call>')[1])
           when contains(response, '<answer>') then trim(string_split(string_split(response, '<answer>')[2], '</answer>')[1]) else response end) as content
    from responses
    """,
)
def _(spark, d):
    action = responses(spark, d).select("doc_id", rewards.extract_action("response").alias("a"))
    return action.select("doc_id", "a.type", F.md5("a.content").alias("content"))


@query(
    "x19_split_keeping_delimiters",
    """
    with p as (select page_id, [''] || regexp_extract_all(html, '(<p>|<li>|<h1>)', 1) as keys,
                      string_split_regex(html, '<p>|<li>|<h1>') as parts from pages),
    e as (select page_id, unnest(range(1, len(parts) + 1)) as i, keys, parts from p)
    select page_id, keys[i] as key, md5(parts[i]) as content, count(*) as n from e
    where keys[i] <> '' or parts[i] <> '' group by all
    """,
)
def _(spark, d):
    parts = text.split_keeping_delimiters("html", ["<p>", "<li>", "<h1>"])
    rows = table(spark, d, "pages").select("page_id", F.explode(parts).alias("p"))
    return rows.groupBy("page_id", F.col("p.key").alias("key"), F.md5("p.content").alias("content")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x21_row_fingerprint",
    """select doc_id, md5('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') as hash from documents""",
)
def _(spark, d):
    return documents(spark, d, "source", "n_chars", "lang").select("doc_id", dedup.fingerprint("source", "n_chars", "lang").alias("hash"))


@query(
    "x24_rating_percentile",
    """
    with r as (select distinct round(c_acctbal, 0) as rating from customer)
    select rating, round(100.0 * (select count(*) from customer where round(c_acctbal, 0) < r.rating) / (select count(*) from customer), 1) as percentile
    from r
    """,
)
def _(spark, d):
    ratings = table(spark, d, "customer").select(F.round("c_acctbal", 0).alias("rating"))
    below = value_offsets(ratings, "rating")
    total = ratings.agg(F.count(F.lit(1)).alias("n")).scalar()
    return below.select("rating", F.round(100.0 * F.col("n_before") / total, 1).alias("percentile"))


@query(
    "x25_sublist_positions",
    f"""
    with w as (select doc_id, {q.words('lower(text)')} as w from documents),
    e as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from w),
    p as (select doc_id, i, x = 'the' and lead(x) over (partition by doc_id order by i) = 'of' as hit from e)
    select doc_id, coalesce(n, 0) as n, coalesce(total, 0)::bigint as total from documents left join
      (select doc_id, count(*) as n, sum(i)::bigint as total from p where hit group by 1) using (doc_id)
    """,
)
def _(spark, d):
    at = text.sublist_positions(text.words(F.lower("text")), F.array(F.lit("the"), F.lit("of")))
    rows = documents(spark, d, "text").select("doc_id", at.alias("at"))
    total = F.aggregate("at", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("at").cast("bigint").alias("n"), total.alias("total"))


# --- filters ------------------------------------------------------------------------------------


@query(
    "f1_membership",
    """
    select doc_id, source from documents where source in ('src1', 'src2', 'src3') and lang not in ('es')
      and doc_id not in (select doc_id from labels where toxic = 1)
    """,
)
def _(spark, d):
    docs = documents(spark, d, "source", "lang")
    listed = docs.filter(filters.in_list("source", ["src1", "src2", "src3"]) & ~filters.in_list("lang", ["es"]))
    return filters.exclude_ids(listed, table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query(
    "f2_quality_gate",
    """
    select doc_id from documents d join labels l using (doc_id)
    where source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') and lang = 'en' and quality < 9 and toxic < 0.9
      and len(regexp_extract_all(text, 'the')) >= 8
    """,
)
def _(spark, d):
    rows = documents(spark, d, "source", "lang", "text").join(table(spark, d, "labels"), "doc_id")
    gate = filters.quality_gate("source", [f"src{i}" for i in range(8)], "lang", "en", "quality", "toxic", "text", word="the")
    return rows.filter(gate).select("doc_id")


@query(
    "f3_minimum_test_count",
    "select page_id from pages where len(regexp_extract_all(html, '<p>')) > 4",
)
def _(spark, d):
    cases = F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))
    return table(spark, d, "pages").filter(filters.more_than(cases, 4)).select("page_id")


@query(
    "f4_date_window",
    """
    select o_orderkey, case when o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-07-01' then 'train' else 'test' end as split
    from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01'
    """,
)
def _(spark, d):
    split = filters.date_window("o_orderdate", {"train": ("1995-01-01", "1996-07-01"), "test": ("1996-07-01", "1997-01-01")})
    return table(spark, d, "orders").select("o_orderkey", split.alias("split")).filter("split is not null")


@query(
    "f5_marker_contamination",
    "select conv_id, bool_or(contains(lower(text), 'moss') or contains(lower(text), 'hand')) as contaminated from conversations group by 1",
)
def _(spark, d):
    # A conversation is contaminated when any turn is, so no conversation has to be collected.
    turns = table(spark, d, "conversations").select("conv_id", F.array(F.struct(F.col("text").alias("content"))).alias("m"))
    hit = text.any_message_contains("m", ["moss", "hand"])
    return turns.groupBy("conv_id").agg(F.bool_or(hit).alias("contaminated"))


@query(
    "f6_distinct_captures",
    """select page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as n from pages
       where len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) > 1""",
)
def _(spark, d):
    n = text.distinct_captures("html", 'href="([^"]*)"').cast("bigint")
    return table(spark, d, "pages").select("page_id", n.alias("n")).filter("n > 1")


@query("f7_not_longer", f"select doc_id from documents where len({q.words('text')}) <= 300")
def _(spark, d):
    return documents(spark, d, "text").filter(filters.not_longer(F.size(text.words("text")), 300)).select("doc_id")


@query("f8_type_equality", "select event_id, user_id from events where event_type = 'click'")
def _(spark, d):
    return table(spark, d, "events").filter("event_type = 'click'").select("event_id", "user_id")


SCORE_SQL = "s as (select c_custkey, case when c_mktsegment <> 'HOUSEHOLD' then round(c_acctbal / 100, 0) end as score from customer)"


def scored_customers(spark, d):
    score = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.round(F.col("c_acctbal") / 100, 0))
    return table(spark, d, "customer").select("c_custkey", score.alias("score"))


@query(
    "f9_lowest_half",
    f"""
    with {SCORE_SQL}
    select c_custkey, score from s where score is not null
    qualify row_number() over (order by score, c_custkey) <= (select count(*) // 2 from s)
    """,
)
def _(spark, d):
    return filters.lowest_half(scored_customers(spark, d), "score", "c_custkey")


@query(
    "f9_score_report",
    f"""
    with {SCORE_SQL}
    select count(score) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std,
      count(score) filter (score >= 50) as n_high, round(avg(score) filter (score >= 50), 6) as mean_high, round(stddev_pop(score) filter (score >= 50), 6) as std_high,
      count(score) filter (score < 50) as n_low, round(avg(score) filter (score < 50), 6) as mean_low, round(stddev_pop(score) filter (score < 50), 6) as std_low
    from s
    """,
)
def _(spark, d):
    report = filters.score_report(scored_customers(spark, d), "score", 50)
    return report.select(*[F.col(c) if c.startswith("n") else F.round(c, 6).alias(c) for c in report.columns])


@query("f10_difficulty_gate", "select p_partkey, p_size from part where p_size between 2 and 5 or p_size >= 10")
def _(spark, d):
    return table(spark, d, "part").filter(filters.difficulty_gate("p_size")).select("p_partkey", "p_size")


@query(
    "f11_vote_average",
    """select event_id, case when event_type = 'error' then null else round((value + user_id) / 2, 6) end as score from events""",
)
def _(spark, d):
    error = F.col("event_type") == "error"
    votes = F.array(
        F.when(error, "n/a").otherwise(F.col("value").cast("string")), F.lit("unparsable"),
        F.when(error, F.lit(None)).otherwise(F.col("user_id").cast("string")),
    )
    return table(spark, d, "events").select("event_id", F.round(rewards.vote_average(votes), 6).alias("score"))


# DuckDB cuts every n-gram from the start of the text, so SQL is too slow here; tests compare by brute force.
@query(
    "f12_repetitive_text",
    """
    select doc_id, coalesce(len(text) >= 30 and list_unique(list_transform(range(1, len(text) - 28), lambda i: substr(text, i, 30))) / (len(text) - 29)::double < 0.5, false) as repetitive
    from documents
    """,
)
def _(spark, d):
    return documents(spark, d, "text").select("doc_id", text.is_repetitive("text").alias("repetitive"))


@query("f13_word_count", "select doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[''-][A-Za-z]+)*')) as n from documents")
def _(spark, d):
    return documents(spark, d, "text").select("doc_id", text.word_count("text").cast("bigint").alias("n"))


@query(
    "f14_episode_mask",
    """
    with last as (select user_id, arg_max(event_type, ts) as ended, count(*) as n, count(*) filter (event_type = 'error') as bad from events group by 1)
    select user_id, case when ended <> 'click' then ended when bad / n > 0.5 then 'tool_errors_too_many' end as reason from last
    """,
)
def _(spark, d):
    # Steps are counted per user before any array is built: a user's two counts decide the mask.
    ended = F.max_by("event_type", "ts")
    users = table(spark, d, "events").groupBy("user_id").agg(
        F.when(ended == "click", "answer").otherwise(ended).alias("ended"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("bad"),
    )
    return users.select("user_id", filters.mask_reason_from_counts("ended", "n", "bad").alias("reason"))


@query(
    "f15_usable_samples",
    "select l_orderkey, count(*) as n from lineitem where l_returnflag <> 'N' and not l_linestatus = 'O' group by 1",
)
def _(spark, d):
    usable = filters.usable_sample(F.col("l_returnflag") != "N", F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").filter(usable).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
