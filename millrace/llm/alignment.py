"""Cross-tokenizer alignment with corpus-wide pair counts by external spill counting.

Each text is encoded by two tokenizers whose token bytes cover the same byte string. Offsets where tokens of both end cut it into
groups; an A and a B token whose byte ranges overlap are a link. Counting the id pairs of all links of the corpus:

1. Tasks write runs. A run holds the pair-document records (pair, document, times) of about RUN_BYTES of text, sorted in side-major
   order (B id, then A id), cut by a radix of the B id, packed and compressed with zstd. Runs are a stored table, so they
   survive lost executors, and each radix of a run is a row of its own.
2. The pairs of a radix are counted by a k-way heap merge over at most FAN_IN runs a task; the merged runs are merged again until one is
   left. It is sorted by B id, so the highest count of each B id falls out as the merge ends. Its size is bounded by the
   vocabularies, not by the corpus.
3. The counts stream back over the runs, RUNS_PER_TASK a task: every record adds its times, and its times the count, to its document,
   and a run's documents are put together from its radixes.

A frequent pair is one entry of every run, so hot keys do not gather rows. Neither vocabulary has tokens that go on over a space into a word, so a
text is cut at single spaces and each distinct piece is encoded and aligned once a worker memo; texts with other white space around a
space, or with a piece whose bytes do not come back, are encoded whole.

Defined results: null and empty texts, and texts whose bytes do not come back from both tokenizers, have no tokens (zeros and an
empty digest); repeated rows are documents of their own and count again, also with a null doc_id; an empty table gives no rows. Extra columns
are not read. A vocabulary whose tokens go on over a space into a word is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored, worker_cache

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN_BYTES = 4_000_000
RADIX_BITS = 6
FAN_IN, RUNS_PER_TASK = 256, 1024
ID_BITS, DOC_BITS = 17, 24  # a pair and a document of a run fit in 58 bits
BLOCK_PAIRS = 4096


def _dump(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays, each in the smallest type that holds it, as one zstd frame."""
    parts = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max(initial=0)))
        parts += [np.array([kind.itemsize, len(x)], dtype="<i8").tobytes(), x.astype(kind.newbyteorder("<")).tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _load(frame: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(frame), 0, []
    while at < len(raw):
        size, n = np.frombuffer(raw, dtype="<i8", count=2, offset=at).tolist()
        out.append(np.frombuffer(raw, dtype=f"<u{size}", count=n, offset=at + 16).astype(np.int64))
        at += 16 + size * n
    return out


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _exclusive(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. (sizes[i] of them) for every i, one after another."""
    return np.repeat(starts - _exclusive(sizes), sizes) + np.arange(int(sizes.sum()))


class Aligner:
    """Alignment of texts under two tokenizers: per text its group string, its link pairs and the counts of tokens and groups."""

    MEMO_PIECES = 250_000

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if any(re.search(r"[^ ] \S", x.decode(errors="replace")) for x in chain(self.a_bytes, self.b_bytes)):
            raise ValueError("a vocabulary has tokens that go on over a space into a word")
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # group strings are put together from "id," inside and "id|" or "id;" at the end of a group's side
        names = [(b"%d," % i, b"%d|" % i) for i in range(len(tokens))] + [(b"%d," % i, b"%d;" % i) for i in range(len(pieces))]
        self.names = list(chain.from_iterable(names))
        self.name_len = np.array([len(x) for x in self.names], dtype=np.int64)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def whole(self, texts: list[str]) -> list[tuple | None]:
        """(group string, link pairs as int64 bytes, A tokens, B tokens, groups) of non-empty texts after a space.

        None for a text whose bytes do not come back.
        """
        if not texts:
            return []
        a = [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        wanted = [b" " + t.encode() for t in texts]
        a_ids, b_ids = (list(chain.from_iterable(x)) for x in (a, b))
        joined = b"".join(wanted)
        n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(texts)) for x in (a, b))
        ai, bi = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.a_len[ai]), np.cumsum(self.b_len[bi])
        ends = np.cumsum(np.fromiter(map(len, wanted), dtype=np.int64, count=len(texts)))
        same = (
            n_a.all()
            and n_b.all()
            and b"".join(map(self.a_bytes.__getitem__, a_ids)) == joined == b"".join(map(self.b_bytes.__getitem__, b_ids))
            and (ends_a[np.cumsum(n_a) - 1] == ends).all()
            and (ends_b[np.cumsum(n_b) - 1] == ends).all()
        )
        if not same:
            good = [
                b"".join(map(self.a_bytes.__getitem__, x)) == w == b"".join(map(self.b_bytes.__getitem__, y))
                for x, y, w in zip(a, b, wanted)
            ]
            rest = iter(self.whole([t for t, ok in zip(texts, good) if ok]))
            return [next(rest) if ok else None for ok in good]
        # links: B tokens that end behind an A token's start and start before its end
        low = np.searchsorted(ends_b, ends_a - self.a_len[ai], side="right")
        n_links = np.searchsorted(ends_b - self.b_len[bi], ends_a, side="left") - low
        links = (bi[_ranges(low, n_links)] << ID_BITS | np.repeat(ai, n_links)).astype("<i8").tobytes()
        # groups: common ends
        last_a, last_b = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y for x, y in ((ends_b, ends_a), (ends_a, ends_b)))
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(ai) + len(bi), dtype=np.int64)
        codes[np.arange(len(ai)) + _exclusive(np.bincount(group_b))[group_a]] = 2 * ai + last_a
        codes[np.arange(len(bi)) + np.cumsum(np.bincount(group_a))[group_b]] = 2 * (len(self.a_bytes) + bi) + last_b
        written = b"".join(map(self.names.__getitem__, codes.tolist()))
        cut = np.cumsum(self.name_len[codes])[np.cumsum(n_a + n_b) - 1].tolist()
        at_a = _exclusive(n_a)
        link_cut = (8 * np.cumsum(np.add.reduceat(n_links, at_a))).tolist()
        groups = np.add.reduceat(last_a.astype(np.int64), at_a).tolist()
        return [
            (written[s:e], links[x:y], p, q, g)
            for s, e, x, y, p, q, g in zip([0, *cut], cut, [0, *link_cut], link_cut, n_a.tolist(), n_b.tolist(), groups)
        ]

    def pieces(self, pieces: list[str]) -> list[tuple | None]:
        """``whole`` of each piece through the memo; None also for pieces that cannot stand alone."""
        found = {p: self.young[p] for p in pieces if p in self.young}
        known = {p: self.old[p] for p in pieces if p not in found and p in self.old}
        fresh = [p for p in pieces if p not in found and p not in known]
        known.update((p, None) for p in fresh if not p or p[0].isspace())
        fresh = [p for p in fresh if p not in known]
        known.update(zip(fresh, self.whole(fresh)))
        if len(self.young) + len(known) > self.MEMO_PIECES:
            self.old, self.young = self.young, {}
        self.young.update(known)
        found.update(known)
        return [found[p] for p in pieces]

    def texts(self, texts: pa.Array) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(entries, entry, first): text i consists of the entries entry[first[i]], .. up to entry[first[i + 1]]."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, " ")
        first = np.asarray(parts.offsets, dtype=np.int64)
        first = first - first[0]
        coded = parts.flatten().dictionary_encode()
        entry = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        entries = self.pieces(coded.dictionary.to_pylist())
        odd = np.fromiter((e is None for e in entries), dtype=bool, count=len(entries))
        again = np.flatnonzero(np.logical_or.reduceat(odd[entry], first[:-1]))
        wholes = [texts[i].as_py() for i in again.tolist()]
        nothing = (b"", b"", 0, 0, 0)
        rest = iter(self.whole([t for t in wholes if t]))
        entries = [e or nothing for e in entries] + [(next(rest) if t else None) or nothing for t in wholes]
        sizes = np.diff(first)
        sizes[again] = 1
        keep = np.ones(len(entry), dtype=bool)
        for i in again.tolist():
            keep[first[i] + 1 : first[i + 1]] = False
        entry[first[again]] = len(odd) + np.arange(len(again))
        return entries, entry[keep], np.append(0, np.cumsum(sizes))


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """The worker's aligner of two vocabulary files (default: the installed byte-level and piece ones)."""
    import public_tokenizers

    key = (a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY))
    cache = worker_cache("aligner")
    if key not in cache:
        cache[key] = Aligner(*key)
    return cache[key]


def _group_strings(entries: list[tuple], entry: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    strings, numbers, bounds = [e[0] for e in entries], entry.tolist(), first.tolist()
    for s, e in zip(bounds, bounds[1:]):
        yield b"".join([strings[i] for i in numbers[s:e]])[:-1]


def _records(entries: list[tuple], entry: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (radix, pair, document) numbers of a run in ascending order, and how often each occurs."""
    held = np.frombuffer(b"".join([e[1] for e in entries]), dtype="<i8")
    sizes = np.fromiter((len(e[1]) for e in entries), dtype=np.int64, count=len(entries)) // 8
    n_links = sizes[entry]
    links = held[_ranges(_exclusive(sizes)[entry], n_links)]
    docs = np.repeat(np.repeat(np.arange(len(first) - 1), np.diff(first)), n_links)
    records = np.sort(_turned(links) << DOC_BITS | docs)
    opens = np.flatnonzero(np.append(True, records[1:] != records[:-1])) if len(records) else np.zeros(0, dtype=np.int64)
    return records[opens], np.diff(np.append(opens, len(records)))


def _turned(pairs: np.ndarray) -> np.ndarray:
    """The pair with the lowest bits of the B id brought to the front, as its radix."""
    return (pairs >> ID_BITS & (1 << RADIX_BITS) - 1) << 2 * ID_BITS - RADIX_BITS | (pairs >> ID_BITS + RADIX_BITS) << ID_BITS | pairs & (1 << ID_BITS) - 1


def _ids(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(B ids, A ids) of turned pairs."""
    high = turned >> ID_BITS
    return (high & (1 << ID_BITS - RADIX_BITS) - 1) << RADIX_BITS | high >> ID_BITS - RADIX_BITS, turned & (1 << ID_BITS) - 1


FACTS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]


def write_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
               run_bytes: int = RUN_BYTES) -> DataFrame:
    """The stored runs: rows (run, radix, pairs, records), and one row a run with radix -1 and the facts of its documents."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    documents = f"array<struct<doc_id: {kind}, {', '.join(f'{n}: {k}' for n, k in FACTS)}>>"

    def one(run: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = entries, entry, first = aligner(a_path, b_path).texts(batch.column("text"))
        counts = np.array([(*e[2:], len(e[1]) // 8) for e in entries], dtype=np.int64)[entry]
        facts = np.add.reduceat(counts, first[:-1], axis=0)
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in _group_strings(*found)]
        records, times = _records(*found)
        pair = records >> DOC_BITS
        opens = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
        pairs, n_docs = pair[opens], np.diff(np.append(opens, len(pair)))
        totals = np.add.reduceat(times, opens) if len(opens) else times
        radixes = pairs >> 2 * ID_BITS - RADIX_BITS
        rows = []
        for radix in np.unique(radixes).tolist():
            s, e = np.searchsorted(radixes, [radix, radix + 1])
            x, y = opens[s], opens[e] if e < len(opens) else len(pair)
            steps = np.diff(pairs[s:e], prepend=0)
            rows.append((radix, _dump(steps, totals[s:e]), _dump(n_docs[s:e], records[x:y] & (1 << DOC_BITS) - 1, times[x:y])))
        struct = pa.StructArray.from_arrays(
            [batch.column("doc_id"), *(pa.array(facts[:, i]) for i in range(4)), pa.array(digests, pa.string())], ["doc_id", *(n for n, _ in FACTS)]
        )
        lists = pa.ListArray.from_arrays(pa.array([0, len(batch)] + [len(batch)] * len(rows), pa.int32()), struct)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([run] * (len(rows) + 1), pa.int64()),
                pa.array([-1, *(r[0] for r in rows)], pa.int32()),
                pa.array([None, *(r[1] for r in rows)], pa.binary()),
                pa.array([None, *(r[2] for r in rows)], pa.binary()),
                lists,
            ],
            ["run", "radix", "pairs", "records", "documents"],
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= run_bytes:
                yield one(run, pa.concat_batches(held))
                run, held = run + 1, []
        if held and sum(map(len, held)):
            yield one(run, pa.concat_batches(held))

    return stored(texts.mapInArrow(write, f"run long, radix int, pairs binary, records binary, documents {documents}"), "pair-runs")


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """K-way merge of sorted (pairs, counts). The heap holds each run's next block by its first pair; what is held below
    the heap's smallest first pair is complete."""
    heap = [(int(pairs[0]), i, 0) for i, (pairs, _) in enumerate(runs) if len(pairs)]
    heapq.heapify(heap)
    held, done, size = [], [], 0
    while heap:
        _, i, at = heapq.heappop(heap)
        pairs, counts = runs[i]
        held.append((pairs[at : at + BLOCK_PAIRS], counts[at : at + BLOCK_PAIRS]))
        size += len(held[-1][0])
        if at + BLOCK_PAIRS < len(pairs):
            heapq.heappush(heap, (int(pairs[at + BLOCK_PAIRS]), i, at + BLOCK_PAIRS))
        if not heap or size >= 2 * BLOCK_PAIRS * len(runs):
            pairs, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(pairs, kind="stable")
            pairs, counts = pairs[order], counts[order]
            opens = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            pairs, counts = pairs[opens], np.add.reduceat(counts, opens)
            cut = int(np.searchsorted(pairs, heap[0][0])) if heap else len(pairs)
            done.append((pairs[:cut], counts[:cut]))
            held, size = [(pairs[cut:], counts[cut:])], len(pairs) - cut
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, dtype=np.int64),) * 2


def _opened(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _load(frame)
    return np.cumsum(steps), counts


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, totals): all pairs of a radix in side-major order, their counts and whether a count is its B id's highest."""
    level = runs.filter(F.col("radix") >= 0).select("run", "radix", "pairs")
    left = runs.filter(F.col("radix") < 0).count()

    def merge(table: pa.Table) -> pa.Table:
        pairs, counts = _merged([_opened(x) for x in table.column("pairs").to_pylist()])
        made = _dump(np.diff(pairs, prepend=0), counts)
        return pa.table({"run": table.column("part").slice(0, 1).cast(pa.int64()), "radix": table.column("radix").slice(0, 1), "pairs": pa.array([made], pa.binary())})

    while True:
        left = max(1, -(-left // fan_in))
        dealt = level.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(left)))
        level = stored(dealt.groupBy("radix", "part").applyInArrow(merge, "run long, radix int, pairs binary"), "merged")
        if left == 1:
            break

    def highest(batch: pa.RecordBatch):
        out = []
        for frame in batch.column("pairs").to_pylist():
            pairs, counts = _opened(frame)
            opens = np.flatnonzero(np.append(True, np.diff(pairs >> ID_BITS) != 0))
            top = np.repeat(np.maximum.reduceat(counts, opens), np.diff(np.append(opens, len(pairs))))
            out.append(_dump(np.diff(pairs, prepend=0), counts, (counts == top).astype(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("radix"), pa.array(out, pa.binary())], ["radix", "totals"])

    return level.select("radix", "pairs").mapInArrow(per_batch(highest), "radix int, totals binary")


def pair_counts(totals: DataFrame) -> DataFrame:
    """(a_id, b_id, count, best) of every linked id pair of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame in batch.column("totals").to_pylist():
                steps, counts, best = _load(frame)
                b, a = _ids(np.cumsum(steps))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts), pa.array(best.astype(bool))],
                    ["a_id", "b_id", "count", "best"],
                )

    return totals.select("totals").mapInArrow(run, "a_id int, b_id int, count long, best boolean")


def contributions(runs: DataFrame, totals: DataFrame, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """Facts of every document of the runs with n_best and count_sum from the corpus-wide counts."""
    documents = runs.filter(F.col("radix") < 0).select("run", "documents")
    kind = documents.schema["documents"].dataType.elementType["doc_id"].dataType.simpleString()
    parts = max(1, -(-documents.count() // runs_per_task))
    records = runs.filter(F.col("radix") >= 0).select("run", "radix", "pairs", "records", F.pmod(F.xxhash64("run"), F.lit(parts)).alias("part"))
    counted = totals.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))

    def stream_back(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            steps, all_counts, all_best = _load(right.column("totals")[0].as_py())
            all_pairs = np.cumsum(steps)
            for pairs, records in zip(left.column("pairs"), left.column("records")):
                at = np.searchsorted(all_pairs, _opened(pairs.as_py())[0])
                n_docs, docs, times = _load(records.as_py())
                sums = np.zeros((2, int(docs.max()) + 1), dtype=np.int64)
                np.add.at(sums[0], docs, times * np.repeat(all_best[at], n_docs))
                np.add.at(sums[1], docs, times * np.repeat(all_counts[at], n_docs))
                out.append(_dump(*sums))
        return pa.table({"run": left.column("run"), "sums": pa.array(out, pa.binary())})

    sums = records.groupBy("radix", "part").cogroup(counted.groupBy("radix", "part")).applyInArrow(stream_back, "run long, sums binary")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        facts = left.column("documents").combine_chunks().flatten()
        best, count = np.zeros(len(facts), dtype=np.int64), np.zeros(len(facts), dtype=np.int64)
        for frame in right.column("sums"):
            x, y = _load(frame.as_py())
            best[: len(x)] += x
            count[: len(y)] += y
        columns = dict(zip(["doc_id", *(n for n, _ in FACTS)], facts.flatten()))
        return pa.table(columns | {"n_best": pa.array(best), "count_sum": pa.array(count)})

    schema = f"doc_id {kind}, {', '.join(f'{n} {k}' for n, k in FACTS)}, n_best long, count_sum long"
    return documents.groupBy("run").cogroup(sums.groupBy("run")).applyInArrow(together, schema)


def alignment_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, token, group and link counts, the digest of its groups, and the corpus-wide counts over its links."""
    runs = write_runs(docs, **options)
    return contributions(runs, stored(merge_runs(runs), "pair-totals"))


def aligned_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, groups): the token groups of every document in order, as arrays of A ids and B ids."""

    def run(batch: pa.RecordBatch):
        found = aligner(a_path, b_path).texts(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode() for x in _group_strings(*found)])], ["doc_id", "written"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    written = texts.mapInArrow(per_batch(run), f"doc_id {kind}, written string")

    def side(group, i):
        return F.split(F.split(group, "[|]")[i], ",").cast("array<int>")

    groups = F.when(F.col("written") == "", F.array()).otherwise(F.split("written", ";"))
    return written.select("doc_id", F.transform(groups, lambda g: F.struct(side(g, 0).alias("a"), side(g, 1).alias("b"))).alias("groups"))
