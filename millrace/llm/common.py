"""What the operators of this package share: stored tables, Arrow batch sizes, token encoding."""

from __future__ import annotations

import os
import sys
import types
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, configure

WORD = r"[^\x20\x09-\x0D]+"
VOCABULARY = "byte_bpe_50k.json"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """``fn`` over every Arrow batch of a partition, for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return run


def joined_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], size: int):
    """``per_batch`` over neighbouring batches put together until they hold ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= size:
                out = fn(pa.concat_batches(held))
                held = []
                if out is not None:
                    yield out
        out = fn(pa.concat_batches(held)) if held else None
        if out is not None:
            yield out

    return run


def worker_cache(owner: str) -> dict:
    """A dictionary of ``owner`` that lives as long as the Python worker (unpickled functions do not).

    A worker keeps one owner's: what another operator left there is given up first.
    """
    module = sys.modules.setdefault("_millrace_worker", types.ModuleType("_millrace_worker"))
    if module.__dict__.get("owner") != owner:
        module.__dict__.update(owner=owner, held={})
    return module.__dict__["held"]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level vocabularies never merge across a space that a non-space follows, so a text is cut at
    such spaces and each distinct piece is encoded by the library once; a text with runs of white space
    around a space, or with the string of an added token, is encoded in one call. The memo has two generations: when the young one is full it becomes
    the old one, from which pieces in use come back. That bounds memory, not the result.
    """

    MEMO_PIECES = 450_000
    CALL_CHARS = 20_000
    GROUP_BYTES = 8_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learned(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces encoded together, each after a space; the ids are cut where a piece starts."""
        calls, group, size = [], [], 0
        for piece in pieces:
            group.append(piece)
            size += len(piece)
            if size > self.CALL_CHARS:
                calls.append(group)
                group, size = [], 0
        if group:
            calls.append(group)
        found: dict[str, bytes] = {}
        for group, raw in zip(calls, self._whole([" " + " ".join(g) for g in calls])):
            bounds = (np.flatnonzero(self.starts[np.frombuffer(raw, dtype="<u4")]) * 4).tolist()
            if len(bounds) == len(group):
                found.update(zip(group, [raw[a:b] for a, b in zip(bounds, [*bounds[1:], len(raw)])]))
            else:  # a vocabulary with other space rules
                found.update(zip(group, self._whole([" " + p for p in group])))
        return found

    def _entries(self, pieces: list[str]) -> list[bytes | int]:
        """The memo's entry for each distinct piece; 0 marks one that cannot stand alone (empty, or white space first)."""
        found = list(map(self.young.get, pieces))
        wanted = [p for p, v in zip(pieces, found) if v is None]
        known: dict[str, bytes | int] = {p: self.old[p] for p in wanted if p in self.old}
        known.update((p, 0) for p in wanted if not p or p[0].isspace())
        known.update(self._learned([p for p in wanted if p not in known]))
        if len(self.young) + len(known) > self.MEMO_PIECES:
            self.old, self.young = self.young, {}
        self.young.update(known)
        return [known[p] if v is None else v for p, v in zip(pieces, found)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i, with ``end_id`` behind them, are ids[offsets[i] : offsets[i + 1]]."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        groups = np.unique(sizes // self.GROUP_BYTES, return_index=True)[1].tolist() if len(texts) else []
        counts, ids = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype="<u4")]
        for start, end in zip(groups, [*groups[1:], len(texts)]):
            n, found = self._group(texts.slice(start, end - start), end_id)
            counts.append(n)
            ids.append(found)
        return np.cumsum(np.concatenate(counts)), np.concatenate(ids)

    def _group(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids per text and all ids. Pieces are numbered by Arrow; texts are put together from the distinct ones' ids."""
        parts = pc.split_pattern(texts, " ")
        first = np.asarray(parts.offsets, dtype=np.int64)[:-1]
        first -= first[0]
        coded = parts.flatten().dictionary_encode()
        piece = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        heads = [names[i] for i in piece[first].tolist()]
        entries = self._entries(names)
        odd = np.fromiter((e == 0 for e in entries), dtype=bool, count=len(entries)) if 0 in entries else None
        added = np.zeros(len(first), dtype=bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        piece[first] = len(names) + np.arange(len(first))
        if odd is not None or added.any():  # such a text is encoded whole, in place of its head
            if odd is not None:
                rest = np.append(odd, np.zeros(len(first), dtype=bool))[piece]
                added |= np.logical_or.reduceat(rest, first)
            whole = np.flatnonzero(added)
            for i in whole.tolist():
                heads[i] = texts[i].as_py()
                end = first[i + 1] if i + 1 < len(first) else len(piece)
                piece[first[i] + 1 : end] = len(names) + len(first)
            entries = [e or b"" for e in entries]
        entries += [*self._whole(heads), b""]
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        held = np.frombuffer(b"".join(entries), dtype="<u4")
        at = np.cumsum(sizes) - sizes
        lengths = sizes[piece]
        ends = np.cumsum(lengths)
        ids = held[np.repeat(at[piece] - ends + lengths, lengths) + np.arange(ends[-1])]
        counts = np.add.reduceat(lengths, first)
        return counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id))


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for the vocabulary file ``path`` (default: the installed 50k byte-level one)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    cache = worker_cache("encoder")
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]
