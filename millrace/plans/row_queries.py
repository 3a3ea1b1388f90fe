"""Row normalisation and chat operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, templates
from ..functions.text import words
from ..operators import corpus, rows, sampling
from . import sqltext as q
from .registry import query, table
from .text_queries import PAIRS_SQL, turn_pairs


def documents(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns)


def conversations(spark, d):
    turns = table(spark, d, "conversations")
    return rows.turns_to_messages(turns, ["conv_id"], "turn", "role", "text")


def rendered(messages="messages"):
    """Messages as one comparable text: role:md5(content), in order."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"]))), ",")


TURNS_SQL = "string_agg(role || ':' || md5(text), ',' order by turn)"
LISTS_SQL = """conv as (select conv_id, list(role order by turn) as roles, list(text order by turn) as texts,
  count(*) as n from conversations group by 1)"""


@query("p1_rename_by_alias", "select doc_id, text as response, lang as system from documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("SYSTEM_PROMPT"))
    return rows.rename_by_alias(docs, rows.RESPONSE_COLUMNS).select("doc_id", "response", "system")


@query("p2_keep_standard", "select quality as label, source as channel from documents join labels using (doc_id)")
def _(spark, d):
    docs = documents(spark, d, "lang", F.col("source").alias("channel")).join(table(spark, d, "labels"), "doc_id")
    return rows.keep_standard(docs.withColumnRenamed("quality", "label")).select("label", "channel")


@query(
    "p3_detect_and_standardise",
    "select 'user:' || md5(lang || chr(10) || source) || ',assistant:' || md5(text) as messages, count(*) as n from documents group by 1",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("lang").alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output")
    )
    return rows.standardise(docs).groupBy(rendered().alias("messages")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p4_query_response_messages",
    f"""
    with {PAIRS_SQL}
    select conv_id, turn, 'system:' || md5('be brief') || ',user:' || md5('q0') || ',user:' || md5(gold) || ',assistant:' || md5(prediction) as messages
    from pairs
    """,
)
def _(spark, d):
    pairs = turn_pairs(spark, d).select(
        "conv_id", "turn", F.col("gold").alias("query"), F.array("prediction", F.lit("other")).alias("response"),
        F.lit("be brief").alias("system"), F.array(F.array(F.lit("q0"), F.lit(None).cast("string"))).alias("history"),
    )
    return rows.from_response(pairs).select("conv_id", "turn", rendered().alias("messages"))


@query(
    "p5_instruction_query",
    "select doc_id, md5(case when lang = 'en' then source when lang = 'fr' then lang else lang || chr(10) || source end) as query from documents",
)
def _(spark, d):
    first = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    second = F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("source"))
    return documents(spark, d, first.alias("a"), second.alias("b")).select("doc_id", F.md5(chat.instruction_query("a", "b")).alias("query"))


@query(
    "p6_standard_messages",
    f"""
    with m as (select conv_id, {TURNS_SQL} as body, arg_min(role, turn) as first from conversations group by 1)
    select conv_id, case when first = 'system' then body else 'system:' || md5('sys') || ',' || body end as messages from m
    """,
)
def _(spark, d):
    alias = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turn = F.sort_array(F.collect_list(F.struct("turn", alias.alias("from"), F.col("text").alias("value"))))
    shared = table(spark, d, "conversations").groupBy("conv_id").agg(turn.alias("conversations"))
    return rows.from_messages(shared.withColumn("system", F.lit("sys"))).select("conv_id", rendered().alias("messages"))


@query("p7_turns_to_messages", f"select conv_id, {TURNS_SQL} as messages from conversations group by 1")
def _(spark, d):
    return conversations(spark, d).select("conv_id", rendered().alias("messages"))


@query(
    "p8_history",
    f"""
    with {LISTS_SQL}, s as (select *, case when roles[1] = 'system' then 1 else 0 end as o from conv),
    p as (select *, cast(ceil((n - o) / 2) as bigint) as k from s)
    select conv_id, greatest(k - 1, 0) as n_history, md5(texts[o + 2 * k - 1]) as query, md5(texts[o + 2 * k]) as response,
           case when o = 1 then md5(texts[1]) end as system from p
    """,
)
def _(spark, d):
    parts = conversations(spark, d).select("conv_id", chat.history_of("messages").alias("h"))
    return parts.select(
        "conv_id",
        F.size("h.history").cast("bigint").alias("n_history"),
        F.md5("h.query").alias("query"),
        F.md5("h.response").alias("response"),
        F.md5("h.system").alias("system"),
    )


@query(
    "p9_validate_messages",
    "select conv_id, bool_or(role = 'system') as rejected from conversations group by 1",
)
def _(spark, d):
    odd = F.when(F.col("role") == "system", "narrator").otherwise(F.col("role"))
    turns = table(spark, d, "conversations").withColumn("role", odd)
    good, bad = rows.validate_messages(rows.turns_to_messages(turns, ["conv_id"], "turn", "role", "text"))
    return good.select("conv_id", F.lit(False).alias("rejected")).unionByName(bad.select("conv_id", F.lit(True).alias("rejected")))


@query(
    "p10_rejected_response",
    f"with {PAIRS_SQL} select conv_id, turn from pairs where turn <> 1 and length(prediction) <= length(gold)",
)
def _(spark, d):
    # A pair is bad when its rejected answer is null (turn 1) or repeats the chosen one (longer answers).
    pairs = turn_pairs(spark, d)
    rejected = F.when(F.col("turn") == 1, F.lit(None)).when(F.length("prediction") > F.length("gold"), F.col("prediction")).otherwise("x")
    made = pairs.select(
        "conv_id", "turn", chat.query_response_messages("gold", "prediction").alias("messages"), rejected.alias("rejected_response")
    )
    return rows.validate_messages(made)[0].select("conv_id", "turn")


@query("p11_cast_media", "select page_id, url as path, 1::bigint as n from pages")
def _(spark, d):
    pages = rows.cast_media(rows.cast_images(table(spark, d, "pages").select("page_id", F.col("url").alias("images"), F.col("url").alias("videos"))), "videos")
    return pages.select("page_id", F.get("images", F.lit(0))["path"].alias("path"), F.size("videos").cast("bigint").alias("n"))


@query(
    "p12_normalise_boxes",
    """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice, least(l_quantity, l_tax * 100) as x1, greatest(l_quantity, l_tax * 100) as x2,
      least(l_partkey, l_suppkey)::double as y1, greatest(l_partkey, l_suppkey)::double as y2 from lineitem
    """,
)
def _(spark, d):
    box = F.array("l_quantity", F.col("l_partkey").cast("double"), F.col("l_tax") * 100, F.col("l_suppkey").cast("double"))
    boxes = table(spark, d, "lineitem").withColumn("b", rows.normalise_boxes(F.array(box))[0])
    return boxes.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *[F.col("b")[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])]
    )


@query("p13_class_label", "select o_orderkey, substr(o_orderpriority, 1, 1)::int as label from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))


@query("p14_query_template", "select item_id, md5('Read this: ' || text || ' Now answer.') as query from benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(rows.query_template("Read this: {{QUERY}} Now answer.", "text")).alias("query"))


@query(
    "p15_classification_rows",
    """
    select doc_id, md5('Task: Judge the text' || chr(10) || 'Sentence: ' || text || chr(10) || 'Category: bad, good' || chr(10) || 'Output:') as query,
      case when quality = 1 then 'good' else 'bad' end as response
    from documents join labels using (doc_id)
    """,
)
def _(spark, d):
    rated = documents(spark, d, "text").join(table(spark, d, "labels"), "doc_id", "left")
    made = rows.classification_rows(rated, "Judge the text", ["bad", "good"], "quality", "text")
    return made.select("doc_id", F.md5("query").alias("query"), "response")


def _prompt_list(lang):
    return "[" + ", ".join("'" + text + "'" for text, _ in rows.GROUNDING_PROMPTS[lang]) + "]"


@query(
    "p16_grounding_prompt",
    f"""
    with h as (select doc_id, ('0x' || substr({q.shuffled('template', 'doc_id')}, 1, 12))::bigint as h, {q.unit('language', 'doc_id')} < 0.8 as english from documents)
    select doc_id, case when english then ({_prompt_list('en')})[(h % {len(rows.GROUNDING_PROMPTS['en'])} + 1)::int]
      else ({_prompt_list('zh')})[(h % {len(rows.GROUNDING_PROMPTS['zh'])} + 1)::int] end as query, '<bbox>' as response from h
    """,
)
def _(spark, d):
    prompt = documents(spark, d).select("doc_id", rows.grounding_prompt(42, "doc_id").alias("p"))
    return prompt.select("doc_id", "p.query", "p.response")


@query(
    "p17_self_cognition",
    """select doc_id, 'Who is ' || case when lang = 'en' then 'Weir' else 'Mill' end || '? /think' as query,
       'I am ' || case when lang = 'en' then 'Weir' else 'Mill' end || ' by {{AUTHOR}}' as response from documents""",
)
def _(spark, d):
    tag = F.when(F.col("lang") == "en", "zh").otherwise(F.col("lang"))
    made = rows.self_cognition(F.lit("Who is {{NAME}}?"), F.lit("am {{NAME}} by {{AUTHOR}}"), tag, {"name": ("Weir", "Mill")}, " /think", "I ")
    return documents(spark, d, "lang").select("doc_id", made.alias("m")).select("doc_id", "m.query", "m.response")


@query(
    "p18_rl_row",
    """
    select 'docs' as data_source, md5(text) as prompt, 'rule' as style, source as gold, row_number() over (order by doc_id) - 1 as "index", 'train' as split
    from documents
    """,
)
def _(spark, d):
    from ..operators.ordering import with_position

    placed = with_position(documents(spark, d, "source", "text"), "doc_id", "index")
    made = placed.select(*rows.rl_row("text", "source", "docs", "reading", "index", "train", answer="source"))
    return made.select(
        "data_source", F.md5(F.col("prompt")[0]["content"]).alias("prompt"), "reward_model.style",
        F.col("reward_model.ground_truth").alias("gold"), "extra_info.index", "extra_info.split",
    )


@query(
    "p19_multiple_choice",
    f"""
    with o as (select p_partkey, unnest([p_name, p_brand, p_type, 'none']) as t, unnest([0, 1, 2, 3]) as i from part),
    r as (select *, row_number() over (partition by p_partkey order by md5('7|option' || i || '|' || p_partkey)) as k from o)
    select p_partkey, md5('Pick' || chr(10) || chr(10) || string_agg(substr('ABCD', k::int, 1) || ') ' || t, chr(10) order by k)) as question,
           substr('ABCD', (max(k) filter (i = 0))::int, 1) as gold from r group by 1
    """,
)
def _(spark, d):
    made = rows.multiple_choice(F.lit("Pick"), "p_name", ["p_brand", "p_type", F.lit("none")], 7, "p_partkey")
    picked = table(spark, d, "part").select("p_partkey", made.alias("m"))
    return picked.select("p_partkey", F.md5("m.question").alias("question"), "m.gold")


@query(
    "p20_search_qa_row",
    "select 'searchR1_' || source as data_source, doc_id as \"index\", md5('Think. ' || text) as content, md5(text) as question, 'gold ' || lang as gold from documents",
)
def _(spark, d):
    docs = documents(spark, d, "text", "source", F.array(F.concat(F.lit("gold "), "lang")).alias("golds"))
    made = docs.select(*rows.search_qa_row("text", "golds", "source", "doc_id", "train", "You help.", "Think. \n"))
    # The prefix loses its line breaks only.
    return made.select(
        "data_source",
        "extra_info.index",
        F.md5(F.col("prompt")[1]["content"]).alias("content"),
        F.md5("extra_info.question").alias("question"),
        F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth")[0].alias("gold"),
    )


@query(
    "p21_preference_rows",
    f"with {PAIRS_SQL} select conv_id, turn, r as rank, md5(case when r = 0 then prediction else gold end) as response from pairs, (select unnest([0, 1]) as r)",
)
def _(spark, d):
    pairs = turn_pairs(spark, d).withColumn("prompt", F.lit("p"))
    made = rows.preference_to_sft(pairs, "prompt", "prediction", "gold")
    return made.select("conv_id", "turn", "rank", F.md5("response").alias("response"))


@query(
    "p22_transcript_messages",
    """
    with c as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n
               from conversations where role <> 'system')
    select conv_id, string_agg(case when k % 2 = 1 then 'user:' else 'assistant:' end || md5(trim(text)), ',' order by k) as messages
    from c where k <= n // 2 * 2 group by 1
    """,
)
def _(spark, d):
    turns = table(spark, d, "conversations").filter("role <> 'system'")
    packed = F.sort_array(F.collect_list(F.struct("turn", "text")))
    per = turns.groupBy("conv_id").agg(packed.alias("t"))
    lines = F.transform("t", lambda t, i: F.concat(F.when(i % 2 == 0, "\n\nHuman: ").otherwise("\n\nAssistant: "), t["text"]))
    made = per.select("conv_id", rows.transcript_messages(F.array_join(lines, "")).alias("messages"))
    return made.filter(F.size("messages") > 0).select("conv_id", rendered().alias("messages"))


@query(
    "p22_marked_history",
    f"""with {PAIRS_SQL} select conv_id, turn, md5(' ' || gold || ' ') as query, md5(' ' || prediction) as response from pairs""",
)
def _(spark, d):
    text = F.concat(F.lit("User: "), "gold", F.lit(" Assistant: "), "prediction")
    made = turn_pairs(spark, d).select("conv_id", "turn", rows.marked_history(text, ["User:"], ["Assistant:", "Assistent:"]).alias("h"))
    return made.filter("h is not null").select("conv_id", "turn", F.md5(F.col("h")[0][0]).alias("query"), F.md5(F.col("h")[0][1]).alias("response"))


@query(
    "p23_label_pivot",
    f"with {PAIRS_SQL} select conv_id, turn, md5(gold) as answer, 'Human' as label from pairs union all select conv_id, turn, md5(prediction), 'Machine' from pairs",
)
def _(spark, d):
    made = rows.label_pivot(turn_pairs(spark, d), {"gold": "Human", "prediction": "Machine"}, "answer", "label")
    return made.select("conv_id", "turn", F.md5("answer").alias("answer"), "label")


@query(
    "p24_similarity_pairs",
    f"with {PAIRS_SQL} select conv_id, turn, md5(gold) as anchor, md5(prediction) as positive from pairs where turn >= 2",
)
def _(spark, d):
    made = rows.similarity_pairs(turn_pairs(spark, d), "gold", "prediction", "turn", 2.0)
    return made.select(
        "conv_id", "turn", F.md5(F.col("messages")[0]["content"]).alias("anchor"), F.md5(F.col("positive_messages")[0][0]["content"]).alias("positive")
    )


@query("p24_rerank_rows", "select p_partkey, p_name as query, p_type as positive, p_brand as negative, 2::bigint as n_negative from part")
def _(spark, d):
    part = table(spark, d, "part").withColumn("neg", F.array("p_brand", F.lit("x")))
    made = rows.rerank_rows(part, "p_name", "p_type", "neg")
    return made.select(
        "p_partkey", F.col("messages")[0]["content"].alias("query"), F.col("positive_messages")[0][0]["content"].alias("positive"),
        F.col("negative_messages")[0][0]["content"].alias("negative"), F.size("negative_messages").cast("bigint").alias("n_negative"),
    )


@query(
    "p25_replace_spans",
    """select doc_id, md5(substr(text, 1, 2) || '<ref-object><bbox>' || substr(text, 6, 4) || '<ref-object><bbox>' || substr(text, 13)) as tagged
       from documents where length(text) >= 20 and n_chars % 2 = 0""",
)
def _(spark, d):
    def span(a, b):
        return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))

    overlapping = F.array(span(2, 5), span(4, 12))
    spans = F.when(F.col("n_chars") % 2 == 0, F.array(span(9, 12), span(2, 5))).otherwise(overlapping)
    made = documents(spark, d, "text", "n_chars").filter(F.length("text") >= 20).select("doc_id", F.md5(rows.replace_spans("text", spans)).alias("tagged"))
    return made.filter("tagged is not null")


@query(
    "p26_positional_question",
    f"""
    with p as (select text, row_number() over (order by {q.shuffled('shuffle', 'item_id')}, item_id) - 1 as pos,
                      cast(floor(count(*) over () * 0.9::double) as bigint) as k from benchmark)
    select case when pos < k then 'train' else 'test' end as split, (case when pos < k then pos else pos - k end)::varchar as id,
           md5('image_id: 1 ' || chr(10) || ' Question: ' || text) as question from p
    """,
)
def _(spark, d):
    placed = sampling.shuffled_ratio_split(table(spark, d, "benchmark"), 0.9, ["item_id"])
    made = placed.select("split", *[c.alias(n) for n, c in rows.positional_question("text", "index").items()])
    return made.select("split", "id", F.md5("question").alias("question"))


@query("u3_messages_as_text", "select conv_id, turn, role, md5(text) as content from conversations where text is not null")
def _(spark, d):
    turns = table(spark, d, "conversations").filter("text is not null")
    short = F.to_json(F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))))
    plain = F.to_json(F.array(F.struct("role", F.col("text").alias("content"))))
    wrapped = turns.select("conv_id", "turn", F.concat(F.lit("x"), F.when(F.col("turn") % 2 == 0, short).otherwise(plain)).alias("conversation"))
    done = rows.from_messages(wrapped, repair=lambda text: F.substring(text, 2, 2**31 - 1))
    first = F.get("messages", F.lit(0))
    return done.select("conv_id", "turn", first["role"].alias("role"), F.md5(first["content"]).alias("content"))


@query(
    "p27_test_cases",
    """select event_id, (k + 0)::bigint as n from (select event_id, cast(regexp_extract(props, '(\\d+)', 1) as bigint) % 9 as k, event_type from events)
       where k >= 5 and event_type <> 'error'""",
)
def _(spark, d):
    k = F.pmod(F.regexp_extract("props", r"(\d+)", 1).cast("bigint"), F.lit(9)).cast("int")
    case = F.when(F.col("event_type") == "click", '{"input": "1", "output": "2"}').otherwise("{'input': '1', 'output': '2'}")
    body = F.concat(F.lit('{"language": "python", "test_cases": ['), F.array_join(F.array_repeat(case, k), ", "), F.lit("]}"))
    broken = F.when(F.col("event_type") == "error", F.lit("{not a literal")).otherwise(body)
    made = rows.test_case_rows(table(spark, d, "events").select("event_id", broken.alias("t")), "t", 5)
    return made.select("event_id", F.size("tests").cast("bigint").alias("n"))


@query(
    "p28_retrieval_prompt",
    f"""
    with {PAIRS_SQL}, n as (select conv_id, turn, gold, {q.words("gold || chr(10) || chr(10) || prediction")} as w from pairs)
    select conv_id, turn, md5('Sys: ' || list_aggregate(w[1 : greatest(24 - 1 - 13 - len({q.words('gold')}), 0)], 'string_agg', ' ') || chr(10) || chr(10)
        || 'User: Answer the following question with a short span. ' || gold || chr(10) || chr(10) || 'Assistant: The answer is') as prompt
    from n where 24 - 1 - 13 - len({q.words('gold')}) > 0
    """,
)
def _(spark, d):
    made = turn_pairs(spark, d).filter(F.lit(24 - 1 - 13) - F.size(words("gold")) > 0)
    prompt = rows.retrieval_prompt("gold", F.array("gold", "prediction", F.lit("unused")), 2, "short", 34, 10, "Sys: ")
    return made.select("conv_id", "turn", F.md5(prompt).alias("prompt"))


@query(
    "p29_context_qa_rows",
    """select p_partkey, md5(p_name || chr(10) || 'Choose one based on the following options: (A) ' || p_brand || ' (B) ' || p_type) as question,
       ' ' || p_brand as answer, 'title: ' || p_type || ', source: ' || p_name as neighbour from part where p_size > 10""",
)
def _(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("options"),
        F.array(F.struct(F.col("p_type").alias("title"), F.col("p_name").alias("text"))).alias("ctxs"),
        F.when(F.col("p_size") > 10, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("answers"),
    )
    made = rows.context_qa_rows(part, "question", "ctxs", "answers", "options")
    return made.select("p_partkey", F.md5("question").alias("question"), "answer", F.col("neighbours")[0].alias("neighbour"))


SESSION_SQL = "s as (select *, sum((event_type = 'signup')::int) over (order by event_id) as session from events)"


@query(
    "p30_marker_sessions",
    f"""with {SESSION_SQL} select session::bigint as session, count(*) as n,
        md5(string_agg(event_id || ':' || event_type, ',' order by event_id)) as events from s group by 1""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    placed = rows.marker_sessions(events, "event_id", F.col("event_type") == "signup")
    packed = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    names = F.transform(packed, lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["event_type"]))
    return placed.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(names, ",")).alias("events"))


@query(
    "p30_sessions_to_messages",
    f"""with {SESSION_SQL}, f as (select *, row_number() over (partition by session order by event_id) as k from s)
        select session::bigint as session, string_agg('user:' || md5(case when k = 1 then event_type || chr(10) || props else event_type end)
          || ',assistant:' || md5(props), ',' order by k) as messages from f group by 1""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "props", "user_id")
    placed = rows.marker_sessions(events, "event_id", F.col("event_type") == "signup")
    made = rows.sessions_to_messages(placed, "session", "event_id", "event_type", "props", "user_id", "props")
    return made.select("session", rendered().alias("messages"))


@query("p31_flatten_parts", "select page_id, md5('<image>' || url || '<image>') as text from pages")
def _(spark, d):
    def part(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    none = F.lit(None).cast("string")
    parts = F.array(part("image", none), part("text", F.col("url")), part("image", none), part("audio", none))
    return table(spark, d, "pages").select("page_id", F.md5(chat.flatten_parts(parts)).alias("text"))


@query("p32_choice_by_index", "select p_partkey, [p_name, p_brand, p_type][p_size % 3 + 1] as choice from part")
def _(spark, d):
    choice = rows.choice_by_index(F.array("p_name", "p_brand", "p_type"), F.col("p_size") % 3)
    return table(spark, d, "part").select("p_partkey", choice.alias("choice"))


@query(
    "p32_random_pair",
    "select p_partkey, [p_name, p_brand, p_type][('0x' || substr(md5('42|pair|' || p_partkey), 1, 12))::bigint % 3 + 1] as choice from part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", rows.random_pair(F.array("p_name", "p_brand", "p_type"), 42, "p_partkey").alias("choice"))


@query(
    "p33_category_names",
    "select doc_id, ['low', 'high'][quality + 1] || ',' || ['low', 'high'][toxic + 1] as names, '<ref-object><bbox><ref-object><bbox>' as tags from labels",
)
def _(spark, d):
    ids = F.array("quality", "toxic")
    names = F.array_join(rows.category_names(ids, ["low", "high"]), ",")
    return table(spark, d, "labels").select("doc_id", names.alias("names"), rows.object_tags(ids).alias("tags"))


# --- conversations as training text ---------------------------------------------------------------


@query(
    "x20_render_chat",
    """
    with c as (select conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) order by turn) as t, arg_max(role, turn) as last
               from conversations group by 1)
    select conv_id, md5(case when last = 'assistant' or last = 'system' then t else t || chr(10) || '<|im_start|>assistant' || chr(10) || '<|im_end|>' end) as prompt from c
    """,
)
def _(spark, d):
    return conversations(spark, d).select("conv_id", F.md5(chat.render_chat("messages")).alias("prompt"))


def _turn_sql(parts, strip_assistant):
    """SQL of a turn's text, by role: user rows whose turn is a multiple of four count as tool output."""
    content = f"case when role = 'assistant' then {q.strip('text')} else text end" if strip_assistant else "text"
    cases = " ".join(f"when '{role}' then '{a}' || {content} || '{b}'" for role, (a, b) in parts.items())
    return f"case role {cases} end"


def _family_sql(name, begin, parts, strip_assistant, default, generation):
    size = f"len({q.strip('text') if strip_assistant else 'text'}) + {len(parts['assistant'][1].replace("' || chr(10) || '", 'x'))}"
    opened = f"case when first_role <> 'system' then '{default}' else '' end || " if default else ""
    return f"""
      select conv_id, '{name}' as family, md5('{begin}' || {opened}string_agg({_turn_sql(parts, strip_assistant)}, '' order by turn) || '{generation}') as prompt,
        coalesce(sum({size}) filter (role = 'assistant'), 0)::bigint as n_loss, true as read_back
      from t group by conv_id, first_role"""


_NL = "' || chr(10) || '"
_FAMILIES = " union all ".join(
    [
        _family_sql(
            "im", "", {**{r: (f"<|im_start|>{r}{_NL}", f"<|im_end|>{_NL}") for r in ("system", "user", "assistant")},
                       "tool": (f"<|im_start|>user{_NL}<tool_response>{_NL}", f"{_NL}</tool_response><|im_end|>{_NL}")},
            True, f"<|im_start|>system{_NL}You are a helpful assistant.<|im_end|>{_NL}", f"<|im_start|>assistant{_NL}",
        ),
        _family_sql(
            "header", "<|begin_of_text|>", {**{r: (f"<|start_header_id|>{r}<|end_header_id|>{_NL}{_NL}", "<|eot_id|>") for r in ("system", "user", "assistant")},
                                            "tool": (f"<|start_header_id|>user<|end_header_id|>{_NL}{_NL}<|start_header_id|>tool_response<|end_header_id|>{_NL}{_NL}", "<|eot_id|><|eot_id|>")},
            False, "", f"<|start_header_id|>assistant<|end_header_id|>{_NL}{_NL}",
        ),
        _family_sql(
            "bar", "<｜begin▁of▁sentence｜>", {"system": ("", ""), "user": ("<｜User｜>", ""), "assistant": ("<｜Assistant｜>", "<｜end▁of▁sentence｜>"),
                                              "tool": (f"<｜User｜><｜tool▁response▁begin｜>{_NL}", f"{_NL}<｜tool_response_end｜>")},
            True, "", f"<｜Assistant｜><think>{_NL}",
        ),
    ]
)


@query(
    "x20_template_families",
    f"""
    with t as (select conv_id, turn, text, case when role = 'user' and turn % 4 = 0 and turn > 0 then 'tool' else role end as role,
                      first_value(case when role = 'user' and turn % 4 = 0 and turn > 0 then 'tool' else role end) over (partition by conv_id order by turn) as first_role from conversations)
    {_FAMILIES}
    """,
)
def _(spark, d):
    """Three families: the prompt, the characters to learn, and whether the turns are read back from the text."""
    role = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0) & (F.col("turn") > 0), "tool").otherwise(F.col("role"))
    turn = F.struct("turn", role.alias("role"), F.col("text").alias("content"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    out = None
    for name, t in templates.TEMPLATES.items():
        turns = F.transform(templates.template_turns(t, "messages"), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
        spans = templates.loss_spans(t, "messages")
        # contents without text leave nothing to read back in a family whose marks are empty
        kept = F.filter(turns, lambda x: (x["role"] != "system") | (x["content"] != "")) if t.turns["system"][0] == "" else turns
        one = talks.select(
            "conv_id",
            F.lit(name).alias("family"),
            F.md5(templates.render_template(t, "messages", True)).alias("prompt"),
            F.aggregate(F.transform(spans, lambda s: s["end"] - s["start"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_loss"),
            (templates.parse_template(t, templates.render_template(t, "messages")) == kept).alias("read_back"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "p29_source_forms",
    """
    with p as (select p_partkey, p_partkey % 8 as form, p_name, p_brand, p_type, p_size from part)
    select p_partkey, md5(case when form = 1 then p_name || chr(10) || 'Choose one based on the following options: (A) ' || p_brand || ' (B) ' || p_type else p_name end) as question,
      ' ' || case form when 0 then p_brand when 1 then p_brand when 2 then p_type when 3 then p_brand when 4 then p_size::varchar when 5 then 'True' when 7 then p_type end as answer,
      case form when 0 then 'title: ' || p_type || ', source: ' || p_name when 1 then 'title: , source: ' || p_type when 2 then 'title: , source: ' || p_brand else 'title: , source: ' end as neighbour
    from p where form <> 6
    """,
)
def _(spark, d):
    """Eight forms of a question-answering row by part key, as JSON text read into a variant."""

    def obj(**fields):
        return F.to_json(F.struct(*[v.alias(k.replace("__", "-")) for k, v in fields.items()]))

    name, brand, kind, size = (F.col(f"p_{n}") for n in ("name", "brand", "type", "size"))
    none = F.array().cast("array<string>")
    forms = [
        obj(question=name, sub__paragraphs=F.array(kind, name), answers=F.array(brand, kind)),
        obj(question=name, qa_type=F.lit("multi_choice_qa"), multichoice_options=F.array(brand, kind), sub__paragraphs=kind, answer=brand),
        obj(question=name, sub_paragraph=brand, answers=F.array(F.struct(F.concat(F.lit(" "), kind, F.lit(" ")).alias("text"), F.lit(3).alias("start")))),
        obj(question=name, answer=F.array(brand, kind)),
        obj(question=name, answer=size),
        obj(question=name, answer=F.lit(True)),
        obj(question=name, answers=none),
        obj(question=name, answer=F.array(F.struct(kind.alias("text")))),
    ]
    chosen = forms[0]
    for i, form in enumerate(forms):
        chosen = F.when(F.pmod("p_partkey", F.lit(8)) == i, form).otherwise(chosen)
    instances = table(spark, d, "part").select("p_partkey", F.parse_json(chosen).alias("instance"))
    made = rows.qa_rows(instances, "instance", sub_paragraph=True)
    return made.select("p_partkey", F.md5("question").alias("question"), "answer", F.col("neighbours")[0].alias("neighbour"))


@query(
    "p29_retrieved_contexts",
    """
    select conv_id, md5(string_agg('title: ' || role || ', source: ' || text, '|' order by turn)) as neighbours, ' ' || max(text) filter (turn = 0) as answer
    from conversations group by 1 having max(text) filter (turn = 0) is not null
    """,
)
def _(spark, d):
    turn = F.struct("turn", F.col("role").alias("title"), "text")
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("ctxs"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("longform_answer")
    )
    instance = F.parse_json(F.to_json(F.struct(F.lit("q").alias("question"), "ctxs", "longform_answer")))
    made = rows.qa_rows(talks.select("conv_id", instance.alias("instance")), "instance", source="retrieved", longform=True)
    return made.select("conv_id", F.md5(F.array_join("neighbours", "|")).alias("neighbours"), "answer")


@query(
    "p4_drawn_response",
    f"""
    with {PAIRS_SQL}
    select conv_id, turn, 'user:' || md5(gold) || ',assistant:' || md5([prediction, 'other', 'third'][(('0x' || substr({q.shuffled('response', "conv_id || '|' || turn")}, 1, 12))::bigint % 3 + 1)::int]) as messages
    from pairs
    """,
)
def _(spark, d):
    pairs = turn_pairs(spark, d).select(
        "conv_id", "turn", F.col("gold").alias("query"), F.array("prediction", F.lit("other"), F.lit("third")).alias("response")
    )
    return rows.from_response(pairs, 42, ["conv_id", "turn"]).select("conv_id", "turn", rendered().alias("messages"))


MASK_SQL = f"""
    with c as (select conv_id, turn, role, len({q.words('text')}) as n, min(turn) filter (role = 'assistant') over w as first,
                      max(turn) filter (role = 'assistant') over w as last from conversations window w as (partition by conv_id))
    select conv_id, coalesce(sum(n), 0)::bigint as n_tokens, coalesce(sum(n) filter (role = 'assistant'), 0)::bigint as n_all,
      coalesce(sum(n) filter (turn = last), 0)::bigint as n_last,
      coalesce(sum(n) filter (turn >= first and role not in ('user', 'tool')), 0)::bigint as n_after from c group by 1"""


@query("c28_loss_mask", MASK_SQL)
def _(spark, d):
    counts = F.transform("messages", lambda m: F.size(words(m["content"])))
    conv = conversations(spark, d).withColumn("n", counts)

    def total(strategy):
        return F.aggregate(chat.loss_mask("messages", F.col("n"), strategy), F.lit(0).cast("bigint"), lambda a, x: a + x)

    return conv.select(
        "conv_id",
        F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
        total("all").alias("n_all"),
        total("last").alias("n_last"),
        total("after_first").alias("n_after"),
    )


@query(
    "c29_loss_weights",
    """
    with c as (select conv_id, turn, role, max(turn) filter (role = 'user') over (partition by conv_id) as u from conversations)
    select conv_id, string_agg(case when role = 'assistant' then '1' else '0' end, ',' order by turn) as default_weights,
      string_agg(case when role = 'assistant' and (u is null or turn > u) then '1' else '0' end, ',' order by turn) as last_round
    from c group by 1
    """,
)
def _(spark, d):
    def joined(strategy):
        return F.array_join(F.transform(chat.loss_weights("messages", strategy), lambda w: w.cast("int").cast("string")), ",")

    return conversations(spark, d).select("conv_id", joined("default").alias("default_weights"), joined("last_round").alias("last_round"))


@query(
    "c29_delimiter_weights",
    """select doc_id, md5(string_agg(c || '=' || w, '|' order by k)) as parts from (
         select doc_id, unnest([1, 2, 3]) as k, unnest([lang || ' ', 'Action:', source]) as c, unnest(['1.0', '2.0', '0.5']) as w from documents) group by 1""",
)
def _(spark, d):
    text = F.concat("lang", F.lit(" Action:"), "source")
    parts = chat.delimiter_weights(text, {"Action:": (2.0, 0.5), "Observation:": (2.0, 0.0)})
    shown = F.array_join(F.transform(parts, lambda p: F.concat(p["content"], F.lit("="), p["weight"].cast("string"))), "|")
    return documents(spark, d, "lang", "source").select("doc_id", F.md5(shown).alias("parts"))


# Kept beside the chat queries: the generated table takes its row ids from the documents.
def _draw(salt, *more):
    ident = "doc_id" + "".join(f" || '|' || {x}" for x in more)
    return f"('0x' || substr({q.shuffled(salt, ident)}, 1, 12))::bigint"


@query(
    "s16_char_count_rows",
    f"""
    with d as (select doc_id, {_draw('length')} % 16 + 5 as n, {_draw('target')} % 26 as target, {_draw('hits')} as h from documents),
    e as (select doc_id, n, target, h % n + 1 as hits, unnest(range(1, n + 1)) as i from d),
    p as (select doc_id, target, hits, {q.shuffled('place', "doc_id || '|' || i")} as k,
                 case when i <= hits then target else (target + 1 + {_draw('miss', 'i')} % 25) % 26 end as c from e),
    w as (select doc_id, hits, chr((97 + target)::int) as letter, string_agg(chr((97 + c)::int), '-' order by k, c) as word,
                 string_agg(chr((97 + c)::int) || case when c = target then ' = ' else ' != ' end || chr((97 + target)::int) || '.', chr(10) order by k, c) as lines
          from p group by doc_id, hits, target)
    select doc_id, 'How many ' || letter || ' are there in word ' || word || '?' as prompt,
      lines || chr(10) || '\\boxed{{' || hits || '}} ' || letter || ' in ' || word || '.' as response, hits::int as gold from w
    """,
)
def _(spark, d):
    return corpus.char_count_rows(documents(spark, d), "doc_id", 5, 20)
