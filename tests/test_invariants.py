"""Brute-force comparisons and invariants on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import batch, blend, corpus, dedup, examples, joins, metrics, ordering, packing, sampling, similarity


@pytest.mark.parametrize("within", [(), ("g",)])
def test_positions_follow_any_keys(spark, within):
    rng = random.Random(5)
    keys = rng.sample(range(-(2**45), 2**45), 200) + list(range(100))
    rows = [(k, k % 3, rng.randint(0, 9)) for k in dict.fromkeys(keys)]
    df = spark.createDataFrame(rows, "k long, g int, n long").repartition(7)
    got = {r["k"]: (r["pos"], r["n_before"]) for r in ordering.with_position(df, "k", sums=["n"], within=list(within)).collect()}
    counts, sums = {}, {}
    for k, g, n in sorted(rows):
        g = g if within else 0
        assert got[k] == (counts.get(g, 0), sums.get(g, 0))
        counts[g], sums[g] = counts.get(g, 0) + 1, sums.get(g, 0) + n


def test_positions_by_value_with_a_hot_value(spark):
    rng = random.Random(1)
    rows = [(i, 0.5 if rng.random() < 0.4 else rng.random()) for i in range(500)]
    got = ordering.with_value_position(spark.createDataFrame(rows, "k long, v double"), "v", "k").collect()
    want = {k: p for p, (v, k) in enumerate(sorted((v, k) for k, v in rows))}
    assert {r["k"]: r["pos"] for r in got} == want


def test_value_buckets_hold_few_values_whatever_the_outliers(spark):
    rng = random.Random(8)
    values = [rng.random() for _ in range(4000)] + [1e300, -1e300, 0.0, -0.0, 5e-324, 2.0**-1022, float("inf"), float("-inf"), float("nan")]
    values += [1e9 + 1000 * rng.random() for _ in range(4000)] + [2.0**k for k in range(-60, 60)] + [-(2.0**k) for k in range(-60, 60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(10**6, None)], "k long, v double")
    names, levelled = ordering.value_levels(df, "v")
    assert levelled.groupBy(*names).count().agg(F.max("count")).first()[0] <= len(values) / 1000
    order = sorted(range(len(values)), key=lambda i: (math.isnan(values[i]), values[i], i) if not math.isnan(values[i]) else (True, 0, i))
    got = {r["k"]: r["pos"] for r in ordering.with_value_position(df, "v", "k").collect()}
    assert got == {k: p + 1 for p, k in enumerate(order)} | {10**6: 0}
    big = [(i, 2**62 + rng.randrange(5000)) for i in range(3000)] + [(9999, -5)]
    ints = spark.createDataFrame(big, "k long, v long")
    places = {r["k"]: r["pos"] for r in ordering.with_value_position(ints, "v", "k").collect()}
    assert places == {k: p for p, (v, k) in enumerate(sorted((v, k) for k, v in big))}


def test_shuffle_does_not_depend_on_partitions(spark):
    a = sampling.shuffle_rows(spark.range(300).repartition(2), ["id"]).collect()
    b = sampling.shuffle_rows(spark.range(300).repartition(9), ["id"]).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b} and sorted(r["pos"] for r in a) == list(range(300))


@pytest.mark.parametrize("overlap", [0, 1])
def test_samples_are_slices_of_the_stream(spark, overlap):
    rng = random.Random(3)
    docs = [(i, [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 3, 12, 40]))]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc long, tokens array<int>").withColumn("n_tokens", F.size("tokens").cast("long"))
    placed = ordering.with_position(df.drop("tokens"), "doc", sums=["n_tokens"])
    spans = corpus.sample_index(placed, 7, overlap).drop("n_tokens")
    got = {r["sample_id"]: r["tokens"] for r in corpus.gather_samples(spans, df, "doc", 7).collect()}
    stream = [t for _, ts in docs for t in ts]
    n = (len(stream) - overlap) // 7
    assert got == {j: stream[7 * j : 7 * j + 7 + overlap] for j in range(n)}


def test_blend_prefixes_keep_their_share(spark):
    weights = [0.05, 0.2, 0.31, 0.44]
    rows = blend.weighted_blend(spark, list("abcd"), weights, 2000).collect()
    assert sorted(r["pos"] for r in rows) == list(range(2000))
    order = [r["dataset_index"] for r in sorted(rows, key=lambda r: r["pos"])]
    counts = [0] * 4
    for s, d in enumerate(order, 1):
        counts[d] += 1
        assert all(abs(c - w * s) < 2 for c, w in zip(counts, weights))
    sizes = [1000 * (i + 1) for i in range(5)]
    full = blend.exhaustive_blend(spark, list("abcde"), sizes)
    assert full.agg(F.countDistinct("pos"), F.max("pos")).first()[:] == (sum(sizes), sum(sizes) - 1)
    assert {r["dataset"]: r["count"] for r in full.groupBy("dataset").count().collect()} == dict(zip("abcde", sizes))


def test_blend_places_of_large_sizes(spark):
    # Products beyond 64 bits take the decimal path; compared with Python integers.
    sizes = [10**11, 7 * 10**10 + 1, 3]
    rows = [(i, k, sizes[i]) for i in range(3) for k in (0, 1, 2, sizes[i] // 2, sizes[i] - 1) if k < sizes[i]]
    df = spark.createDataFrame(rows, "dataset_index int, item long, unit long")
    place = blend._place(sizes, sizes, "decimal(38,0)")
    for r in df.withColumn("p", place).collect():
        i, k = r["dataset_index"], r["item"]
        want = k
        for j, u in enumerate(sizes):
            if j != i:
                bound = ((2 * k + 1) * u - (0 if j < i else 1)) // sizes[i]
                want += min((bound + 1) // 2, u)
        assert r["p"] == want


def test_packs(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 90)) for i in range(2500)] + [(9999, 400)]
    df = spark.createDataFrame(rows, "id long, n long")
    packs = packing.pack_rows(df, "id", "n", 100).collect()
    assert sorted(r["id"] for r in packs) == sorted(i for i, _ in rows)
    sums = {}
    for r in packs:
        sums.setdefault(r["pack"], []).append(r["n"])
    assert all(sum(v) <= 100 or v == [400] for v in sums.values())
    assert len(sums) <= 1.1 * sum(n for _, n in rows) / 100 + 3


def test_micro_batches(spark):
    rng = random.Random(4)
    rows = [(b, b * 100 + i, rng.randint(1, 200)) for b in range(3) for i in range(20)]
    out = packing.micro_batches(spark.createDataFrame(rows, "b long, id long, n long"), "b", "id", "n", 300).collect()
    assert sorted((r["b"], r["id"], r["n"]) for r in out) == sorted(rows)
    sums = {}
    for r in out:
        sums[r["b"], r["part"]] = sums.get((r["b"], r["part"]), 0) + r["n"]
    assert max(sums.values()) <= 300


def _grams(s, n=3):
    w = s.lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def _copies_and_variants():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 40))] for _ in range(25)]
    texts = []
    for _ in range(140):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    return texts + [texts[0]] * 70 + ["", "one", "one two"]


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("threshold", [0.5, 0.792])
def test_near_duplicates_by_brute_force(spark, threshold):
    texts = _copies_and_variants()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = {r["id"] for r in similarity.near_duplicates(df, "id", "text", threshold).collect()}
    kept, removed = [], set()
    for i, t in enumerate(texts):
        g = _grams(t)
        if g and any(_jaccard(g, k) > threshold for k in kept):
            removed.add(i)
        elif g:
            kept.append(g)
    assert got == removed


@pytest.mark.parametrize("threshold", [0.792, 0.95])
def test_sets_without_a_similar_one_go_before_their_shingles_are_shuffled(spark, monkeypatch, threshold):
    counted, frequency = [], similarity._frequency
    monkeypatch.setattr(similarity, "_frequency", lambda sets, *a: counted.append(sets) or frequency(sets, *a))
    rng = random.Random(3)
    unlike = [[f"{i}-{k}" for k in range(rng.randint(60, 90))] for i in range(60)]
    shared = [f"s{k}" for k in range(12)]
    texts = [" ".join(shared + t) for t in unlike]  # every set has common shingles, few of them
    texts += [" ".join([*unlike[i][:-1], "end"]) for i in range(4)] + texts[7:9] + ["", "one", "One", "one two", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r["id"] for r in similarity.near_duplicates(df, "id", "text", threshold).collect()}
    kept, removed = [], set()
    for i, t in enumerate(texts):
        g = _grams(t or "")
        if g and any(_jaccard(g, k) > threshold for k in kept):
            removed.add(i)
        elif g:
            kept.append(g)
    assert got == removed and 64 in removed and 68 in removed
    ids = {r["set_id"] for r in counted[0].collect()}
    assert len(ids) <= 20 and (threshold > 0.792 or ids >= {0, 1, 2, 3, 60, 61, 62, 63})


def test_near_duplicates_of_a_key_with_several_texts_and_of_null_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, f"{a} x"), (None, f"{b} y"), (None, a), (3, f"{b} z")]
    got = similarity.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text").distinct().collect()
    assert {r["id"] for r in got} == {2, 3}


@pytest.mark.parametrize("m", [40, 400])
def test_rounds_do_not_grow_with_unlike_sets_of_a_bucket(spark, monkeypatch, m):
    rounds = []
    counted = similarity.top_per_group
    monkeypatch.setattr(similarity, "top_per_group", lambda *a: rounds.append(1) or counted(*a))
    template = [f"t{i}" for i in range(26)]
    texts = [" ".join([*template[:13], f"u{i // 2}", *template[13:], f"e{i % 7}"]) for i in range(m)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"] for r in similarity.near_duplicates(df, "id", "text", 0.9).collect()}
    kept, removed = [], set()
    for i, t in enumerate(texts):
        if any(_jaccard(_grams(t), k) > 0.9 for k in kept):
            removed.add(i)
        else:
            kept.append(_grams(t))
    assert got == removed and len(removed) == m // 2 and len(rounds) <= 4


def test_decontamination_by_brute_force(spark):
    texts = _copies_and_variants()
    mine, theirs = texts[:120], texts[100:150]
    a = spark.createDataFrame(list(enumerate(mine)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(theirs)), "item long, t string")
    got = {r["id"] for r in similarity.contaminated_keys(a, "id", "text", b, "item", "t", 0.6).collect()}
    want = {i for i, s in enumerate(mine) if any(_jaccard(_grams(s), _grams(o)) > 0.6 for o in theirs)}
    assert got == want
    top = {r["id"] for r in similarity.contaminated_keys(a, "id", "text", b, "item", "t", 0.6, top_k=1).collect()}
    best = set()
    for o in theirs:
        scored = sorted((-_jaccard(_grams(s), _grams(o)), i) for i, s in enumerate(mine))
        best |= {i for s, i in scored[:1] if -s > 0.6}
    assert top == best


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_nearest_by_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(40, 6)), rng.normal(size=(80, 6)) * 0.01 + 3])
    rows = [(i, i % 4, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = {}
    for r in similarity.nearest(df, df, "id", "v", 3, group="g", metric=metric).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for i in range(len(v)):
        score = np.linalg.norm(v - v[i], axis=1) if metric == "l2" else -(v @ v[i])
        order = [j for j in np.lexsort((np.arange(len(v)), score)) if j % 4 != i % 4][:3]
        assert [got[i][k] for k in (1, 2, 3)] == order


def test_nearest_visits_few_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    looks, search = [], similarity._search_blocks
    monkeypatch.setattr(similarity, "_search_blocks", lambda visits, *a: looks.append((visits, a[0])) or search(visits, *a))
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=4) * 50 + rng.normal(size=(40, 4)) for _ in range(20)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in similarity.nearest(df, df, "id", "v", 2).collect()}
    for i in range(len(v)):
        order = np.lexsort((np.arange(len(v)), np.linalg.norm(v - v[i], axis=1)))
        assert [got[i, 1], got[i, 2]] == list(order[:2])
    # blocks of queries are blocks of the same rows here
    n_blocks = looks[0][1].count()
    assert n_blocks >= len(v) / 16 and sum(visits.count() for visits, _ in looks) <= 0.2 * n_blocks**2
    assert len({tuple(r) for visits, _ in looks for r in visits.select("chunk", "name").collect()}) == sum(visits.count() for visits, _ in looks)


def test_nearest_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    v = np.concatenate([np.ones((60, 3)), rng.normal(size=(30, 3)), np.zeros((1, 3))]).astype("float32")  # many copies
    rows = [(f"n{i:03d}", None if i % 5 == 0 else f"g{i % 3}", [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id string, g string, v array<float>")
    few = df.filter("id < 'n004' or id > 'n085'")
    got = {}
    for r in similarity.nearest(few, df, "id", "v", 4, group="g").collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["neighbour"], round(r["score"], 5))
    for i, g, x in rows:
        if i < "n004" or i > "n085":
            order = sorted((round(float(np.linalg.norm(np.float64(x) - np.float64(y))), 5), j) for j, h, y in rows if g is None or h != g)[:4]
            assert [got[i][n + 1] for n in range(4)] == [(j, d) for d, j in order]
    assert similarity.nearest(few, df.filter("false"), "id", "v", 4).count() == 0
    assert similarity.nearest(df.filter("false"), few, "id", "v", 4).count() == 0


def test_embedding_blocks_are_made_again_where_damaged(spark, tmp_path):
    folder, calls = str(tmp_path / "e"), tmp_path / "calls"
    calls.mkdir()

    def embedder(texts):
        (calls / str(len(list(calls.iterdir())))).write_text(str(len(texts)))
        return np.array([[len(t), ord(t[0])] for t in texts], dtype="float32")

    items = spark.createDataFrame([(i, chr(97 + i % 26) * (i % 7 + 1)) for i in range(200)], "id long, t string").coalesce(1)
    run = lambda df: similarity.embed_blocks(df, "id", "t", embedder, folder, 6)
    assert run(items) == list(range(6)) and run(items) == []
    rows = lambda: sorted((r.id, list(r.embedding)) for r in similarity.read_blocks(spark, folder, "id", items.schema["id"].dataType).collect())
    want = rows()
    assert len(want) == 200 and want[3] == (3, [4.0, 100.0])
    for part in (tmp_path / "e" / "vectors" / "block=2").glob("*"):
        part.unlink()
    for part in (tmp_path / "e" / "vectors" / "block=4").glob("*.parquet"):
        part.write_bytes(part.read_bytes()[:40])
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert run(items) == [2, 4] and rows() == want and run(items) == []
    more = items.union(spark.createDataFrame([(1000, "zz")], items.schema)).coalesce(1)
    assert len(run(more)) == 1 and len(rows()) == 201


def test_repetition_by_brute_force(spark):
    texts = ["ab" * 40, "".join(chr(97 + i % 26) + str(i) for i in range(60)), "short", "é" * 31]
    got = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.is_repetitive("t").alias("r")).collect()]
    want = []
    for t in texts:
        grams = [t[i : i + 30] for i in range(len(t) - 29)]
        want.append(bool(grams) and len(set(grams)) / len(grams) < 0.5)
    assert got == want


def test_sentence_windows(spark):
    df = spark.createDataFrame([(1, [5, 5, 5, 5, 5, 5]), (2, [600, 5]), (3, [4]), (4, [])], "d long, s array<int>")
    got = {r["d"]: [tuple(w) for w in r["w"]] for r in df.select("d", examples.sentence_windows("s", "d", 10).alias("w")).collect()}
    assert got == {1: [(0, 2, 10), (2, 4, 10), (4, 6, 10)], 2: [], 3: [], 4: []}
    titled = {r["d"]: [tuple(w) for w in r["w"]] for r in df.select("d", examples.block_windows("s", "d", F.lit(5), 10, True).alias("w")).collect()}
    assert titled[1] == [(i, i + 1, 5) for i in range(6)] and titled[3] == [(0, 1, 5)]


def test_examples(spark):
    tokens = [list(range(i, i + 40)) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(tokens)), "id long, t array<int>")
    for r in df.select("id", examples.masked_example("t", F.transform("t", lambda x: F.lit(True)), "id", -1, 1000).alias("m")).collect():
        m, original = r["m"], tokens[r["id"]]
        assert m["labels"] == [original[p] for p in m["positions"]] and 1 <= len(m["positions"]) <= 6
        assert all(m["tokens"][p] == original[p] for p in range(40) if p not in m["positions"])
    for r in df.select("id", examples.span_corruption("t", "id", [-1, -2, -3, -4, -5], 1000, 1001).alias("m")).collect():
        m, spans, current = r["m"], {}, None
        for x in m["decoder_output"][:-1]:
            if x < 0:
                current = spans.setdefault(x, [])
            else:
                current.append(x)
        assert [y for x in m["encoder"] for y in (spans[x] if x < 0 else [x])] == tokens[r["id"]]
    pairs = spark.createDataFrame([(i, [[1] * 10, [2] * 10, [3] * 10]) for i in range(20)], "id long, s array<array<int>>")
    made = [r["p"] for r in pairs.select(examples.sentence_pair("s", "id", 20, 8, 9).alias("p")).collect()]
    assert all(len(p["tokens"]) == 20 == len(p["segments"]) for p in made) and {p["swapped"] for p in made} == {True, False}


def test_pairwise_accuracy_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(g, g * 100 + i, float(rng.randint(0, 4)), rng.randint(0, 1)) for g in range(12) for i in range(rng.randint(1, 9))]
    got = metrics.pairwise_accuracy(spark.createDataFrame(rows, "g long, i long, s double, l int"), "g", "i", "s", "l").first()["accuracy"]
    shares = []
    for g in range(12):
        mine = [r for r in rows if r[0] == g]
        pairs = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :] if a[3] != b[3]]
        right = sum((a[2] > b[2]) == (a[3] > b[3]) for a, b in pairs)
        shares.append(right / len(pairs) if pairs else 0.5)
    assert got == pytest.approx(sum(shares) / 12)


def test_bootstrap_majority_is_repeatable(spark):
    df = spark.createDataFrame([(1, i, "AB"[i % 2], float(i % 2)) for i in range(8)], "g long, i long, vote string, v double")
    a = metrics.bootstrap_majority(df, ["g"], "vote", "v", "i", 3, 200).first()
    assert a == metrics.bootstrap_majority(df.repartition(5), ["g"], "vote", "v", "i", 3, 200).first()
    assert abs(a["mean"] - 0.5) < 4 * 0.5 / math.sqrt(200)


def test_exact_blend_weights(spark):
    assert blend.integer_weights([0.1234564, 0.8765436]) == [308641, 2191359]
    assert blend.integer_weights([30, 70]) == [3, 7] and blend.integer_weights([1.0, 1e-8]) == [100_000_000, 1]
    with pytest.raises(ValueError):
        blend.integer_weights([0.0, 0.0])
    units = blend.integer_weights([0.99999999, 0.00000001])
    assert units == [99_999_999, 1]
    for prefix in (10**9, 10**10):  # the place of an item a share of the way in is within two of that prefix
        turn = prefix // sum(units)
        row = spark.range(1).select(F.lit(turn).cast("bigint").alias("item"), F.lit(1).alias("dataset_index"), F.lit(1).cast("bigint").alias("unit"))
        place = row.select(blend._place(units, None, "decimal(38,0)").cast("bigint").alias("p")).first()["p"]
        assert abs((turn + 0.5) / units[1] * units[0] - (place - turn)) <= 2


def test_nothing_is_lost_to_nulls_and_zero(spark):
    rows = spark.createDataFrame([(None, "a"), (3, None), (1, "b"), (2, None)], "k bigint, g string")
    assert sorted(r["pos"] for r in ordering.with_position(rows, "k").collect()) == [0, 1, 2, 3]
    assert ordering.with_position(rows, "k", within=["g"]).count() == 4
    assert batch.repeat(rows.withColumn("pos", F.lit(0)), 0).count() == 0 and dedup.epochs_union(rows, 0).count() == 0
    with pytest.raises(Exception, match="do not divide"):
        batch.unfold_column(spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>"), "a", 2).collect()
    own = spark.createDataFrame([(1, ["x"]), (2, None)], "k int, p array<string>")
    got = {r["k"]: r["negatives"] for r in joins.sample_negatives(own, "k", "p", 3).collect()}
    assert got == {1: [], 2: ["x"]}
