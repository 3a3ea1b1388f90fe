"""Corpus building, packing and mixing over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import blend, corpus, examples, packing
from ..operators.ordering import row_total, with_position
from ..session import cut_lineage, spread
from . import sqltext as q
from .registry import query, table

LENGTH = 128


def documents(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns)


def sized(spark, d, *columns):
    """Document lengths only; token arrays are joined when they are needed."""
    return documents(spark, d, "text", *columns).withColumn("n_tokens", F.size(words("text")).cast("bigint")).drop("text")


def tokens(spark, d):
    return corpus.tokenize(documents(spark, d, "text"), "doc_id", ["text"]).select("doc_id", "tokens", "n_tokens")


def ordered(spark, d):
    """Documents in order with running token counts. Lengths are read several times, so they are kept once."""
    texts = spread(documents(spark, d, "text"))
    lengths = texts.select("doc_id", F.size(words("text")).cast("bigint").alias("n_tokens"))
    return with_position(cut_lineage(lengths), "doc_id", "pos", sums=["n_tokens"])


SIZED = f"sized as (select doc_id, source, len({q.words('text')}) as n_tokens from documents)"
ORDERED = f"{SIZED}, ordered as (select *, row_number() over o - 1 as pos, coalesce(sum(n_tokens) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before, count(*) over () as n from sized window o as (order by doc_id))"


@query(
    "c1_tokenize",
    f"select doc_id, 'text' as key, 0 as seq_id, len({q.words('text')}) as n_tokens, md5(array_to_string({q.words('text')}, ' ')) as text from documents where len({q.words('text')}) > 0",
)
def _(spark, d):
    rows = corpus.tokenize(documents(spark, d, "text"), "doc_id", ["text"], words)
    return rows.select("doc_id", "key", "seq_id", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("text"))


@query(
    "c2_sentences",
    f"""
    with s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as s from documents)
    select doc_id, len(s) as n_sentences, md5(array_to_string(s, '|')) as sentences from s
    """,
)
def _(spark, d):
    parts = documents(spark, d, "text").select("doc_id", corpus.sentences("text").alias("s"))
    return parts.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences"))


@query(
    "c3_partition_blocks",
    """
    with p as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)
    select doc_id, pos % 7 as robin, pos // ceil(n / 7)::bigint as block from p
    """,
)
def _(spark, d):
    robin = corpus.partition_blocks(documents(spark, d), "doc_id", 7).withColumnRenamed("part", "robin")
    block = corpus.partition_blocks(documents(spark, d), "doc_id", 7, True).withColumnRenamed("part", "block")
    return robin.join(block, "doc_id").select("doc_id", "robin", "block")


@query("c4_parallel_tokens", f"select item_id, len({q.words('text')}) as n_tokens from benchmark")
def _(spark, d):
    return corpus.parallel_tokens(table(spark, d, "benchmark"), "item_id", "text").select("item_id", "n_tokens")


@query(
    "c5_ratio_split",
    """
    with p as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)
    select doc_id, case when pos < round_even(n * (90.0::double / 100), 0) then 'train'
      when pos < round_even(n * (90.0::double / 100 + 7.0::double / 100), 0) then 'valid' else 'test' end as split from p
    """,
)
def _(spark, d):
    return corpus.ratio_split(documents(spark, d), "doc_id", "90,7,3").select("doc_id", "split")


@query(
    "c6_document_index",
    f"""
    with e as (select doc_id, unnest(range(3)) as epoch from documents)
    select doc_id, epoch::int as epoch, row_number() over (order by epoch = 2, md5('1234|documents|' || epoch || '|' || doc_id), epoch, doc_id) - 1 as pos from e
    """,
)
def _(spark, d):
    return corpus.document_index(documents(spark, d), "doc_id", 3, separate_last=True).select("doc_id", "epoch", "pos")


@query(
    "c7_sample_index",
    f"""
    with {ORDERED}, t as (select sum(n_tokens)::bigint as total from sized),
    s as (select o.*, unnest(range(greatest((before - 1) // {LENGTH}, 0), least((before + n_tokens - 1) // {LENGTH}, (total - 1) // {LENGTH} - 1) + 1)) as sample_id
          from ordered o, t where n_tokens > 0),
    c as (select sample_id, doc_id, greatest(before, sample_id * {LENGTH}) - before as doc_offset,
                 least(before + n_tokens, sample_id * {LENGTH} + {LENGTH} + 1) - greatest(before, sample_id * {LENGTH}) as span from s)
    select * from c where span > 0
    """,
)
def _(spark, d):
    return corpus.sample_index(ordered(spark, d), LENGTH).select("sample_id", "doc_id", "doc_offset", "span")


@query(
    "c8_shuffle_index",
    f"""
    with t as (select (sum(len({q.words('text')})) - 1)::bigint // {LENGTH} as n from documents), s as (select unnest(range(n)) as sample_id, n from t)
    select sample_id, row_number() over (order by sample_id >= n // 2, md5('1234|samples|' || sample_id), sample_id) - 1 as new_pos from s
    """,
)
def _(spark, d):
    samples = corpus.sample_index(ordered(spark, d), LENGTH).select("sample_id").distinct()
    half = F.floor(row_total(samples) / 2)
    return corpus.shuffle_index(samples, half).select("sample_id", "new_pos")


@query(
    "c9_loss_positions",
    f"""
    with w as (select doc_id, {q.words('text')} as w from documents), e as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) - 1 as i from w),
    s as (select *, ends_with(t, '.') as stop, coalesce(max(case when ends_with(t, '.') then i + 1 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from e)
    select doc_id, sum(i - start)::bigint as positions, count(*) filter (not stop) as unmasked, count(distinct start) as segments from s group by 1
    """,
)
def _(spark, d):
    ids = F.transform(words("text"), lambda w: F.when(w.endswith("."), 0).otherwise(1))
    rows = documents(spark, d, "text").select("doc_id", corpus.loss_positions(ids, 0).alias("p")).filter(F.size("p") > 0)

    def total(field):
        return F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x[field])

    return rows.select(
        "doc_id", total("position").alias("positions"), total("mask").alias("unmasked"),
        (F.array_max(F.transform("p", lambda x: x["segment"])) + 1).cast("bigint").alias("segments"),
    )


WEIGHTS = {f"src{i}": float(i + 1) for i in range(20)}


@query(
    "c10_weighted_blend",
    """
    with u as (select 'src' || i as dataset, i, i + 1 as w from range(20) t(i)), n as (select 3 * count(*) as n from documents),
    g as (select dataset, i, w, unnest(range(n * w // 210 + 3)) as item from u, n),
    p as (select dataset, i::int as dataset_index, item, row_number() over (order by (2 * item + 1) / w::double, i) - 1 as pos from g)
    select * from p where pos < (select n from n)
    """,
)
def _(spark, d):
    size = 3 * documents(spark, d).count()
    return blend.weighted_blend(spark, list(WEIGHTS), list(WEIGHTS.values()), size)


@query(
    "c13_blend_list",
    """
    with s as (select source as name, count(*) as w from documents group by 1), t as (select sum(w)::double as total from s)
    select name, round(w / total, 9) as weight, ceil(ceil(1000 * (w / total)) * (1 + 0.005))::bigint as size from s, t
    """,
)
def _(spark, d):
    """A blend list "w1 name1 w2 name2 .." of the sources, parsed and normalised, and the samples to build of each."""
    entries = [str(x) for name, n in source_sizes(spark, d).items() for x in (n, f" {name} ")]
    names, weights = blend.parse_blend(entries)
    found = zip(names, blend.normalise_weights(weights), blend.dataset_sizes(weights, 1000, 0.005))
    made = spark.createDataFrame(list(found), "name string, weight double, size bigint")
    return made.withColumn("weight", F.round("weight", 9))


def source_sizes(spark, d):
    """One config row per source."""
    return {r[0]: r[1] for r in documents(spark, d, "source").groupBy("source").count().orderBy("source").collect()}


@query(
    "c11_exhaustive_blend",
    """
    with s as (select source as dataset, count(*) as n, row_number() over (order by source) - 1 as i from documents group by 1),
    g as (select dataset, i, n, unnest(range(n)) as item from s)
    select dataset, i::int as dataset_index, item, row_number() over (order by (2 * item + 1) / n::double, i) - 1 as pos from g
    """,
)
def _(spark, d):
    sizes = source_sizes(spark, d)
    return blend.exhaustive_blend(spark, list(sizes), list(sizes.values()))


@query(
    "c12_dataset_sizes",
    """
    with s as (select source as dataset, count(*)::double as w from documents group by 1), t as (select sum(w) as total from s)
    select dataset, ceil(ceil(5000 * (w / total)) * (1 + 0.005::double))::bigint as n from s, t
    """,
)
def _(spark, d):
    # Sizes are a pure function of the weights, so they stay columns and the sources may be many.
    counts = documents(spark, d, "source").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    total = counts.agg(F.sum("w")).scalar()
    return counts.select("dataset", F.ceil(F.ceil(5000 * (F.col("w") / total)) * (1 + F.lit(0.005))).alias("n"))


@query(
    "j13_blend_gather",
    """
    with s as (select source as dataset, count(*) as n, row_number() over (order by source) - 1 as i from documents group by 1),
    g as (select dataset, i, n, unnest(range(n)) as item from s),
    b as (select dataset, item, row_number() over (order by (2 * item + 1) / n::double, i) - 1 as pos from g),
    items as (select doc_id, source as dataset, row_number() over (partition by source order by doc_id) - 1 as item from documents)
    select pos, dataset, doc_id from b join items using (dataset, item)
    """,
)
def _(spark, d):
    sizes = source_sizes(spark, d)
    items = with_position(documents(spark, d, "source"), "doc_id", "item", within=["source"]).withColumnRenamed("source", "dataset")
    mix = blend.exhaustive_blend(spark, list(sizes), list(sizes.values()))
    return blend.gather_blend(mix, items, sizes).select("pos", "dataset", "doc_id")


SENTENCES = """sentences as (select doc_id, source, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x) <> '') as s from documents)"""


def windows_sql(goal):
    """``windows``: each document's runs of at least two sentences up to ``goal`` tokens, one recursion step a window."""

    def end(start):
        return f"coalesce(list_filter(range({start} + 2, n - 1), lambda e: before[e] - coalesce(before[{start}], 0) >= goal)[1], n)"

    return f"""{SENTENCES},
    sizes as (select doc_id, {goal} as goal, list_transform(s, lambda x: len({q.words("x")})) as z from sentences),
    summed as (select doc_id, goal, len(z) as n, list_transform(range(1, len(z) + 1), lambda i: list_sum(z[1:i])) as before
      from sizes where len(z) > 1 and list_max(z) <= {examples.LONG_SENTENCE}),
    windows as (select doc_id, goal, n, before, 0::bigint as start, {end("0")}::bigint as stop, 0 as block from summed
      union all select doc_id, goal, n, before, stop, {end("stop")}::bigint, block + 1 from windows where stop < n)"""


def windowed(spark, d):
    """(doc_id, sentences, w): the sentences of every document that has windows, and one window a row."""
    split = corpus.sentences("text")
    rows = documents(spark, d, "text").select("doc_id", split.alias("s"), F.transform(split, lambda x: F.size(words(x))).alias("sizes"))
    return rows.select("doc_id", "s", F.explode(examples.sentence_windows("sizes", "doc_id", LENGTH)).alias("w"))


@query(
    "c14_sentence_windows",
    f'with recursive {windows_sql(LENGTH)} select doc_id, start::int as start, stop::int as "end", goal as target from windows',
)
def _(spark, d):
    return windowed(spark, d).select("doc_id", "w.start", "w.end", "w.target")


@query(
    "c15_block_windows",
    f"""with recursive {windows_sql(f"{LENGTH} - length(source)")} select doc_id, block, start::int as start, stop::int as "end", goal::int as target from windows""",
)
def _(spark, d):
    sizes = F.transform(corpus.sentences("text"), lambda s: F.size(words(s)))
    rows = documents(spark, d, "text", "source").select("doc_id", sizes.alias("sizes"), F.length("source").alias("title"))
    made = rows.select("doc_id", F.posexplode(examples.block_windows("sizes", "doc_id", "title", LENGTH)).alias("block", "w"))
    return made.select("doc_id", "block", "w.start", "w.end", "w.target")


def samples(spark, d):
    spans = corpus.sample_index(ordered(spark, d), LENGTH, overlap=0, keep_partial=True)
    return corpus.gather_samples(spans.drop("n_tokens"), tokens(spark, d), "doc_id", LENGTH)


@query(
    "c16_masked_example",
    f"""
    with {SIZED}, n as (select sum(n_tokens)::bigint as n from sized)
    select i as sample_id, least({LENGTH}, n - i * {LENGTH})::bigint as n_tokens, true as restores, true as within_share
    from n, (select unnest(range((n + {LENGTH} - 1) // {LENGTH})) as i from n) s
    """,
)
def _(spark, d):
    starts = F.transform("tokens", lambda t: F.lit(True))
    made = samples(spark, d).select("sample_id", "tokens", examples.masked_example("tokens", starts, "sample_id", 103, 30000).alias("m"))
    shown = F.transform("m.tokens", lambda t, i: F.coalesce(F.get("m.labels", (F.array_position("m.positions", i) - 1).cast("int")), t))
    n = F.size("tokens")
    return made.select(
        "sample_id", n.cast("bigint").alias("n_tokens"), (shown == F.col("tokens").cast("array<int>")).alias("restores"),
        (F.size("m.positions") <= F.greatest(F.lit(1), F.round(n * 0.15))).alias("within_share"),
    )


def run_of(part, whole):
    """Whether ``part`` is a run of adjacent elements of ``whole``."""
    return F.concat(F.lit(","), F.array_join(whole, ","), F.lit(",")).contains(
        F.concat(F.lit(","), F.array_join(part, ","), F.when(F.size(part) > 0, ",").otherwise(""))
    )


@query(
    "c17_sentence_pair",
    f"""
    with recursive {windows_sql(LENGTH)}
    select doc_id, start::int as start, least(before[stop] - coalesce(before[start], 0) + 3, {LENGTH})::int as n_tokens, true as marked, true as runs
    from windows where stop - start > 1
    """,
)
def _(spark, d):
    # Facts of the pair made of each window: its length, its three special tokens, and two runs of the window's tokens in order.
    lists = F.transform(F.slice("s", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")), corpus.word_ids)
    rows = windowed(spark, d).select("doc_id", "w.start", lists.alias("s"), F.concat_ws("|", "doc_id", "w.start").alias("id")).filter(F.size("s") > 1)
    made = rows.select("doc_id", "start", F.flatten("s").alias("whole"), examples.sentence_pair("s", "id", LENGTH, 101, 102).alias("p"))
    in_first = F.size(F.filter("p.segments", lambda x: x == 0)) - 2
    a = F.slice("p.tokens", 2, in_first)
    b = F.slice("p.tokens", in_first + 3, F.size("p.tokens") - in_first - 3)
    facts = made.select("doc_id", "start", "whole", "p", in_first.alias("n_a"), a.alias("a"), b.alias("b"))
    specials = (F.get("p.tokens", F.lit(0)) == 101) & (F.get("p.tokens", F.col("n_a") + 1) == 102) & (F.element_at("p.tokens", -1) == 102)
    return facts.select(
        "doc_id", "start", F.size("p.tokens").alias("n_tokens"),
        (specials & (F.size("p.segments") == F.size("p.tokens"))).alias("marked"),
        (run_of(F.col("a"), F.col("whole")) & run_of(F.col("b"), F.col("whole"))).alias("runs"),
    )


@query(
    "c18_span_corruption",
    f"""
    with {SIZED}, n as (select sum(n_tokens)::bigint as n from sized)
    select i as sample_id, least({LENGTH}, n - i * {LENGTH})::bigint as n_tokens, true as restores, true as shifted, true as within_share
    from n, (select unnest(range((n + {LENGTH} - 1) // {LENGTH})) as i from n) s
    """,
)
def _(spark, d):
    # Sentinels are -1, -2, ..; putting the decoder's spans back in their places gives the sample again.
    made = samples(spark, d).select("sample_id", "tokens", examples.span_corruption("tokens", "sample_id", list(range(-1, -101, -1)), 1, 2).alias("m"))
    spelled = F.col("m.decoder_output")

    def span(sentinel):
        at = F.array_position(spelled, sentinel)
        until = F.coalesce(F.nullif(F.array_position(spelled, sentinel - 1), F.lit(0)), F.size(spelled).cast("bigint"))
        return F.slice(spelled, (at + 1).cast("int"), (until - at - 1).cast("int"))

    back = F.flatten(F.transform("m.encoder", lambda t: F.when(t < 0, span(t)).otherwise(F.array(t))))
    n = F.size("tokens")
    hidden = n - F.size(F.filter("m.encoder", lambda t: t >= 0))
    shifted = F.concat(F.col("m.decoder_input"), F.array(F.lit(2))) == F.concat(F.array(F.lit(1)), spelled)
    return made.select(
        "sample_id", n.cast("bigint").alias("n_tokens"), (back == F.col("tokens").cast("array<int>")).alias("restores"), shifted.alias("shifted"),
        ((hidden >= 1) & (hidden <= F.greatest(F.lit(1), F.round(n * 0.15)))).alias("within_share"),
    )


@query(
    "c19_query_context",
    f"""
    with {SENTENCES}, n as (select doc_id, s, len(s) as n, ('0x' || substr({q.shuffled("sentence", "doc_id", 1234)}, 1, 12))::bigint % len(s) as place,
      {q.unit("keep", "doc_id", 1234)} < 0.1::double as kept from sentences where len(s) > 1)
    select doc_id, n::int as n, md5(s[place + 1]) as query, case when kept then n else n - 1 end::int as n_context,
      md5(array_to_string(list_filter(s, lambda x, i: kept or i <> place + 1), '|')) as context from n
    """,
)
def _(spark, d):
    rows = documents(spark, d, "text").select("doc_id", corpus.sentences("text").alias("s")).filter(F.size("s") > 1)
    made = rows.select("doc_id", F.size("s").alias("n"), examples.query_context("s", "doc_id").alias("m"))
    context = F.md5(F.array_join("m.context", "|"))
    return made.select("doc_id", "n", F.md5("m.query").alias("query"), F.size("m.context").alias("n_context"), context.alias("context"))


CHUNKS = f"chunks as (select doc_id, source, n_tokens, unnest(range(0, n_tokens, 64)) as token_start from sized)"


@query(
    "c20_chunk_documents",
    f"with {SIZED}, {CHUNKS} select doc_id, (token_start // 64)::int as chunk, token_start, least(token_start + 64, n_tokens) as token_end from chunks",
)
def _(spark, d):
    return corpus.chunk_documents(sized(spark, d), "doc_id", 64)


@query(
    "c21_chunk_partitions",
    f"""
    with {ORDERED}, {CHUNKS}, c as (select c.*, token_start // 64 as chunk, o.pos, o.n from chunks c join ordered o using (doc_id)),
    m as (select doc_id, chunk, case when pos < floor(n * 0.8::double) then 'train' else 'valid' end as part,
      (('0x' || substr(md5('1234|chunks|' || source || '|' || doc_id || '|' || chunk), 1, 12))::bigint::double / 281474976710656.0) as u from c)
    select doc_id, chunk::int as chunk, part, part = 'train' and u < 0.25::double as sampled from m
    """,
)
def _(spark, d):
    placed = with_position(sized(spark, d, "source"), "doc_id", "doc_pos")
    chunks = corpus.chunk_documents(placed, "doc_id", 64, ["source", "doc_pos"])
    n_train = F.floor(row_total(documents(spark, d)) * F.lit(0.8))
    return corpus.chunk_partitions(chunks, "doc_id", "source", n_train, F.lit(0.25)).select("doc_id", "chunk", "part", "sampled")


def pack_facts(packed, capacity):
    """Per document: the packs it is in, whether its pack is within the capacity (or an over-long row alone), and whether there are
    at most twice as many packs as the tokens need, and the over-long rows' own."""
    sums = packed.groupBy("pack").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("rows"))
    fits = (F.col("total") <= capacity) | (F.col("rows") == 1)
    small = F.col("total") <= capacity
    used = sums.agg((F.count_if(small) <= 2 * F.sum(F.when(small, F.col("total"))) / capacity + 1).alias("few_packs"))
    each = packed.join(sums, "pack").withColumn("fits", fits)
    found = each.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("packs"), F.every("fits").alias("fits"))
    return found.withColumn("few_packs", used.scalar())


PACK_FACTS = f"select doc_id, len({q.words('text')})::bigint as n_tokens, 1 as packs, true as fits, true as few_packs from documents"


@query("c24_pack_rows", PACK_FACTS)
def _(spark, d):
    return pack_facts(packing.pack_rows(sized(spark, d), "doc_id", "n_tokens", 8192), 8192)


@query("c25_knapsack_rows", PACK_FACTS)
def _(spark, d):
    return pack_facts(packing.knapsack_rows(sized(spark, d), "doc_id", "n_tokens", 32768), 32768)


@query("c26_length", f"select doc_id, len({q.words('text')}) as n_tokens from documents")
def _(spark, d):
    return sized(spark, d)


@query(
    "c27_limit_length",
    f"""
    with w as (select doc_id, {q.words('text')} as w from documents),
    e as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) - 1 as i, len(w) as n from w)
    select doc_id, (i // 256)::int as piece, count(*) as n, md5(string_agg(t, ' ' order by i)) as text from e group by 1, 2
    """,
)
def _(spark, d):
    rows = documents(spark, d, "text").select("doc_id", words("text").alias("t")).filter(F.size("t") > 0)
    pieces = corpus.limit_length(rows, "t", 256, "split")
    return pieces.select("doc_id", "piece", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("text"))


@query(
    "c27_keep_right",
    f"with w as (select doc_id, {q.words('text')} as w from documents) select doc_id, md5(array_to_string(w[-200:], ' ')) as text from w",
)
def _(spark, d):
    rows = documents(spark, d, "text").select("doc_id", words("text").alias("t"))
    return corpus.limit_length(rows, "t", 200, "right").select("doc_id", F.md5(F.array_join("t", " ")).alias("text"))


@query(
    "c30_fixed_length_row",
    f"""
    with s as (select doc_id, least(len({q.words('text')}), {LENGTH}) as n from documents)
    select doc_id, {LENGTH} as n_input, (case when n = 0 then 0 else n end)::bigint as unmasked, greatest({LENGTH} - n - 1, 0)::bigint as padding from s
    """,
)
def _(spark, d):
    ids = documents(spark, d, "text").select("doc_id", corpus.word_ids(F.col("text")).alias("t"))
    row = ids.select("doc_id", corpus.fixed_length_row("t", "t", LENGTH, -1, -2).alias("r"))
    total = F.aggregate("r.mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    pads = F.size(F.filter("r.input", lambda x: x == -2)).cast("bigint")
    return row.select("doc_id", F.size("r.input").alias("n_input"), total.alias("unmasked"), pads.alias("padding"))


def part_sums(spark, d, split):
    """(batch, part) sums of a split of batches of 64 documents."""
    batched = ordered(spark, d).withColumn("batch", F.floor(F.col("pos") / 64))
    parts = split(batched).withColumn("cost", packing.workload("n_tokens"))
    return parts.groupBy("batch", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"), F.sum("cost").alias("cost"), F.max("cost").alias("dearest")
    )


BATCH_FACTS = f"with {ORDERED} select pos // 64 as batch, count(*) as rows, true as holds from ordered group by 1"


@query("c31_balanced_partitions", BATCH_FACTS)
def _(spark, d):
    sums = part_sums(spark, d, lambda df: packing.balanced_partitions(df, "batch", "doc_id", "n_tokens", 4))
    even = F.max("cost") - F.min("cost") <= F.max("dearest")
    return sums.groupBy("batch").agg(F.sum("rows").alias("rows"), (even & (F.max("part") < 4) & (F.min("part") >= 0)).alias("holds"))


@query("c31_micro_batches", BATCH_FACTS)
def _(spark, d):
    sums = part_sums(spark, d, lambda df: packing.micro_batches(df, "batch", "doc_id", "n_tokens", 32768))
    return sums.groupBy("batch").agg(F.sum("rows").alias("rows"), (F.max("tokens") <= 32768).alias("holds"))


@query(
    "c31_snake_partitions",
    f"""
    with {SIZED}, r as (select doc_id, count(*) over () - row_number() over (order by n_tokens, doc_id) as at from sized)
    select doc_id, case when (at // 8) % 2 = 0 then at % 8 else 7 - at % 8 end as part from r
    """.replace(" as at ", ' as "at" ').replace("(at ", '("at" ').replace("then at", 'then "at"').replace("- at", '- "at"'),
)
def _(spark, d):
    return packing.snake_partitions(sized(spark, d), "doc_id", "n_tokens", 8).select("doc_id", "part")


@query(
    "c32_rank_shards",
    """
    with p as (select doc_id, row_number() over (order by doc_id) - 1 - 20 as k, count(*) over () - 20 as n from documents)
    select doc_id, k // 24 as batch, (k % 24) // 3 as rank from p where k >= 0 and k // 24 < n // 24
    """,
)
def _(spark, d):
    placed = with_position(documents(spark, d), "doc_id")
    return corpus.rank_shards(placed, 8, 3, True, 20).select("doc_id", "batch", "rank")


@query(
    "j14_sample_gather",
    f"""
    with e as (select doc_id, unnest({q.words('text')}) as t, generate_subscripts({q.words('text')}, 1) as i from documents),
    s as (select t, row_number() over (order by doc_id, i) - 1 as k from e),
    x as (select t, k, unnest(case when k % {LENGTH} = 0 and k > 0 then [k // {LENGTH} - 1, k // {LENGTH}] else [k // {LENGTH}] end) as sample_id from s)
    select sample_id, count(*) as n, md5(string_agg(t, ' ' order by k)) as text from x where sample_id < ((select count(*) from s) - 1) // {LENGTH} group by 1
    """,
)
def _(spark, d):
    spans = corpus.sample_index(ordered(spark, d), LENGTH).drop("n_tokens")
    texts = documents(spark, d, "text").select("doc_id", words("text").alias("tokens"))
    made = corpus.gather_samples(spans, texts, "doc_id", LENGTH)
    return made.select("sample_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("text"))


@query(
    "a22_token_totals",
    f"with {SIZED} select source, sum(n_tokens)::bigint as tokens_per_epoch, ceil((1000 * {LENGTH} + 1) / sum(n_tokens))::bigint as epochs from sized group by 1",
)
def _(spark, d):
    return corpus.token_totals(sized(spark, d, "source"), "source", LENGTH, 1000)


@query(
    "k5_corpus_index",
    f"with {ORDERED} select doc_id, n_tokens, before * 4 as pointer, pos as seq_pos, true as opens_document from ordered",
)
def _(spark, d):
    rows = sized(spark, d).withColumn("seq_id", F.col("doc_id"))
    return corpus.corpus_index(rows, "seq_id", "doc_id").drop("seq_id")


@query(
    "k6_merge_corpora",
    """
    select item_id as id, row_number() over (order by item_id) - 1 as merged_doc from benchmark
    union all select doc_id, row_number() over (order by doc_id) - 1 + (select count(*) from benchmark) from documents
    """,
)
def _(spark, d):
    parts = {"b_docs": documents(spark, d).withColumnRenamed("doc_id", "id"), "a_items": table(spark, d, "benchmark").select(F.col("item_id").alias("id"))}
    return corpus.merge_corpora(parts, "id").select("id", "merged_doc")
