"""Sentences by a model of the corpus."""

from millrace.operators import corpus, sentences

NAMES = ["Smith", "Jones", "Brown", "Weber", "Lopez", "Kim", "Novak", "Rossi"]


def texts():
    """Titles always carry a period; ordinary words end sentences now and then."""
    for i in range(160):
        a, b = NAMES[i % 8], NAMES[(i * 3 + 1) % 8]
        yield f"Today Dr. {a} met Mr. {b} at noon. The weather was fine. They spoke about the {i % 7} plans, approx. twelve of them."
        yield "In a fine home they say to them at noon what others went there to hear, some of the plans are empty things."
        yield f"It was late at noon and Mr. {a} went home. The street was empty, they say. We think the house of Dr. {b} is fine."


def rows(spark, extra=()):
    return spark.createDataFrame([*enumerate(texts()), *extra], "doc_id long, text string")


def made(df, model):
    return {r["doc_id"]: list(r["sentences"]) for r in sentences.model_sentences(df, "doc_id", "text", model).collect()}


def test_abbreviations_do_not_end_sentences(spark):
    df = rows(spark)
    model = sentences.sentence_model(df, "text").cache()
    found = {r["form"] for r in model.filter("abbreviation").collect()}
    assert {"dr", "mr", "approx"} <= found and not {"noon", "fine", "home", "them", "say"} & found
    assert "the" in {r["form"] for r in model.filter("starter").collect()}
    got = made(df, model)
    assert got[0] == ["Today Dr. Smith met Mr. Jones at noon.", "The weather was fine.", "They spoke about the 0 plans, approx. twelve of them."]
    # False breaks are those behind a title; the rule has them all, the model none, and no true break is lost.
    rule = {r["doc_id"]: list(r["s"]) for r in df.select("doc_id", corpus.sentences("text").alias("s")).collect()}
    false = [sum(s.endswith(("Dr.", "Mr.", "approx.")) for parts in split.values() for s in parts) for split in (rule, got)]
    assert false == [5 * 160, 0] and [len(got[i]) for i in sorted(got)] == [3, 1, 3] * 160


def test_an_abbreviation_ends_a_sentence_before_a_starter(spark):
    df = rows(spark, [(10**6, "We saw Mr. The street was empty! Dr. Kim\n\nagain?  Yes")])
    model = sentences.sentence_model(df, "text")
    assert made(df, model)[10**6] == ["We saw Mr.", "The street was empty!", "Dr. Kim\n\nagain?", "Yes"]


def test_null_empty_repeated_and_long_texts(spark):
    long = " ".join(["Dr. Kim was late."] * 20_000)
    df = rows(spark, [(None, "Mr. Kim left. They say so."), (10**6, None), (10**6 + 1, " \n"), (10**6 + 2, "... !"), (10**6 + 3, long)])
    got = made(df, sentences.sentence_model(rows(spark), "text"))
    assert got[None] == ["Mr. Kim left.", "They say so."]
    assert got[10**6] == got[10**6 + 1] == [] and got[10**6 + 2] == ["...", "!"]
    assert got[10**6 + 3] == ["Dr. Kim was late."] * 20_000
    empty = df.limit(0)
    model = sentences.sentence_model(empty, "text")
    assert model.count() == 0 and made(empty, model) == {}
    assert made(df, model)[None] == ["Mr.", "Kim left.", "They say so."]
    twice = sentences.sentence_model(df.unionAll(df), "text").filter("form = 'dr'").first()
    assert twice["with_period"] == 2 * sentences.sentence_model(df, "text").filter("form = 'dr'").first()["with_period"]


def test_words_are_looked_into_once(spark):
    rows = spark.createDataFrame([(i, " See etc. Now (etc.) this? Yes! and Mr. Smith.  ") for i in range(50)], "id long, text string")
    pairs = sentences._word_pairs(rows, "text")
    got = {(r["word"], r["before"]): r["n"] for r in pairs.collect()}
    assert set(got.values()) == {50} and len(got) == 9
    assert got[("See", None)] == got[("Now", "etc.")] == got[("this?", "(etc.)")] == got[("and", "Yes!")] == got[("Mr.", "")] == 50
    facts = {(r["form"], r["behind"]): (r["n"], r["period"], r["lower"], r["upper_inside"]) for r in sentences._form_pairs(pairs).collect()}
    assert facts[("etc", None)] == (100, 100, 100, 0) and facts[("now", "etc")] == (50, 0, 0, 0) and facts[("mr", None)] == (50, 50, 0, 50)
    made = sentences.model_sentences(rows, "id", "text", sentences.sentence_model(rows, "text")).collect()
    assert {"".join(r["sentences"]).replace(" ", "") for r in made} == {"Seeetc.Now(etc.)this?Yes!andMr.Smith."}
