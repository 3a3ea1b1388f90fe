"""Alignment, clustering and decontamination against brute force, with awkward rows and small bounds."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, clustering, decontamination
from millrace.llm.common import prepared

TEXTS = [
    None, "", " ", "a", "a  b", " x", "x ", "the the the the", "don't 'tis <|endoftext|> <s>x</s> <0x0A>", "tab\tand\nline \n end\r\n", "a▁b c",
    "　wide   space ", "日本語 テキスト é é 👩‍👩‍👧 ​", "the cat sat on the mat", "the cat sat on the mat", "nul\0in it",
    " ".join(f"word{i % 97}" for i in range(4000)), "x" * 5000,
]


def aligned(rows):
    """Facts per row by token positions, one row after another."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    side_a.encode_special_tokens = True
    side_b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment._byte_alphabet()
    counts, made = Counter(), []
    for ident, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)
            bytes_a = [bytes(alphabet[c] for c in side_a.id_to_token(i)) for i in a]
            pieces = [side_b.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if side_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                a, b, bytes_a, bytes_b = [], [], [], []
            owners = [[k for k, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b)]
            links = [(b[j], a[i]) for i, j in sorted(set(zip(*owners)))]
            ends = [{sum(map(len, side[: k + 1])) for k in range(len(side))} if len(side) < 500 else set(_ends(side)) for side in (bytes_a, bytes_b)]
            done = [0, 0]
            for end in sorted(ends[0] & ends[1]):
                part = []
                for s, (side, ids) in enumerate(((bytes_a, a), (bytes_b, b))):
                    size, k = 0, done[s]
                    begin = groups[-1][1] if groups else 0
                    while begin + size < end:
                        size += len(side[k])
                        k += 1
                    part.append(",".join(map(str, ids[done[s] : k])))
                    done[s] = k
                groups.append(("|".join(part), end))
        counts.update(links)
        digest = hashlib.sha256(";".join(g for g, _ in groups).encode()).hexdigest() if groups else ""
        made.append((ident, len(a), len(b), len(groups), links, digest))
    top = defaultdict(int)
    for (b, _), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (ident, n_a, n_b, n, len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), digest)
        for ident, n_a, n_b, n, links, digest in made
    ], counts, top


def _ends(side):
    at = 0
    for x in side:
        at += len(x)
        yield at


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    more = [" ".join(rng.choice(["the", "cat", "naïve", "x1", "re-run", "Ünder"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    return [(i if i % 4 else None, t) for i, t in enumerate(TEXTS + more)]


def table(spark, rows):
    kinds = "doc_id long, text string, run int, part string, pairs long"
    return prepared(spark).createDataFrame([(i, t, 1, "x", 2) for i, t in rows], kinds).repartition(9)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_the_brute_force(spark, rows):
    want, counts, top = aligned(rows)
    docs = table(spark, rows)
    runs = alignment.write_runs(docs, run_bytes=2000)
    assert runs.filter("radix < 0").count() > 4
    totals = alignment.merge_runs(runs, fan_in=2)  # several levels
    got = alignment.contributions(runs, totals, runs_per_task=2).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    pairs = {(r.b_id, r.a_id): (r["count"], r.best) for r in alignment.pair_counts(totals).collect()}
    assert pairs == {x: (n, n == top[x[0]]) for x, n in counts.items()}
    groups = alignment.aligned_groups(docs).select("doc_id", F.expr("size(groups)").alias("n")).collect()
    assert sorted(map(tuple, groups), key=str) == sorted(((w[0], w[3]) for w in want), key=str)


def test_alignment_does_not_depend_on_the_memo(rows):
    import pyarrow as pa
    import public_tokenizers

    small = alignment.Aligner(*(public_tokenizers.path(x) for x in (alignment.A_VOCABULARY, alignment.B_VOCABULARY)))
    small.MEMO_PIECES = 3
    for _ in range(2):
        found = small.texts(pa.array([t for _, t in rows], pa.string()))
        assert [hashlib.sha256(x).hexdigest() if x else "" for x in alignment._group_strings(*found)] == [w[-1] for w in aligned(rows)[0]]


def test_alignment_of_nothing(spark, rows):
    assert alignment.alignment_report(table(spark, rows).filter("false")).count() == 0


def nearest(vectors, k, rounds):
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in vectors)
    centroids = [list(v) for _, v in order[:k]]

    def place(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in vectors:
            held[place(v)[1]].append(v)
        centroids = [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(place(v))) for i, v in vectors]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digests[j]) for i, j, d in found), key=str)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters_are_the_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i if i % 9 else None, [rng.choice([-3.0, -0.01, 0.0, 0.5, 2.25]) for _ in range(3)]) for i in range(30)]
    rows += [(7, [1.0, 1.0, 1.0])] * 3 + [(2, None), (3, [1.0, None, 1.0]), (4, [math.nan, 1.0, 1.0]), (5, [math.inf] * 3), (6, [1.0, 2.0]), (8, [])]
    table = prepared(spark).createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)
    vectors = clustering.integer_vectors(table, dim=3)
    got = clustering.cluster_report(*clustering.cluster(vectors, k, 3)).collect()
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 3 and None not in v and all(map(math.isfinite, v))]
    assert sorted(map(tuple, got), key=str) == nearest(good, k, 3)


def test_clusters_of_few_and_far_vectors(spark):
    none = prepared(spark).createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster_report(*clustering.cluster(clustering.integer_vectors(none))).count() == 0
    edge = float(clustering.limit(2)) / 64
    far = spark.createDataFrame([(1, [edge, -edge]), (2, [-edge, edge])], "vec_id long, embedding array<double>")
    got = clustering.cluster(clustering.integer_vectors(far, dim=2), 1, 0)[0].collect()
    assert sorted(r.distance for r in got) == [0, 2 * (2 * clustering.limit(2)) ** 2]
    with pytest.raises(Exception, match="a component is beyond"):
        clustering.integer_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2).collect()
    with pytest.raises(ValueError):
        clustering.cluster(far, 0)


def contaminated(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return [(m.group().translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    assert word.pattern == decontamination.WORD
    windows = defaultdict(set)
    for item, text in items:
        w = [x[0] for x in words(text)]
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    out = []
    for ident, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                at = windows.get(tuple(x[0] for x in w[i : i + n])) if i + n <= len(w) else None
                if at:
                    hit.update(range(i, i + n))
                    found |= at
        spans = [(w[i][1], i) for i in sorted(hit) if i - 1 not in hit]
        spans = [(s, w[max(j for j in hit if j >= i and set(range(i, j + 1)) <= hit)][2]) for s, i in spans]
        out.append((ident, len(w), len(hit), spans, sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1_000_000, 700])
def test_decontamination_is_the_brute_force(spark, pass_bytes):
    rng = random.Random(6)
    vocabulary = ["a", "b", "Cat", "dog", "Été", "日本", "x1", "İ"]
    items = [(i if i % 7 else None, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(25)]
    items += [(3, "b, a! (Cat)\tDOG\x7fx1"), (4, None), (5, ""), (6, " .,- "), (30, "only-here"), (30, "only-here"), (31, "a")]
    docs = [(i if i % 5 else None, rng.choice([" ", "  ", "-", "\n", "\x00"]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, " .. "), (93, "Only  HERE"), (93, "Only  HERE"), (94, "a " * 300), (95, "nothing ünlike")]
    kinds = prepared(spark).createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, row string").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = decontamination.contamination(kinds, benchmark, window=4, pass_bytes=pass_bytes).collect()
    plain = sorted(((r.doc_id, r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], list(r["items"])) for r in got), key=str)
    assert plain == contaminated(docs, items, 4)


def test_decontamination_of_nothing(spark):
    docs = prepared(spark).createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.spans, r["items"]) for r in decontamination.contamination(docs, none).collect()] == [(2, 0, [], [])]
    assert decontamination.contamination(docs.filter("false"), none).count() == 0
