"""Byte-level BPE by a global shuffle of distinct words.

Encoding runs in three steps. Each block of documents (a slice of an input
partition, cut by bytes) is split into pre-tokens and keeps, for every
document, the positions of its words as indices into the block's own word
list. The block's distinct words are dealt out by hash, so that all blocks'
copies of one word meet in one task, where it is encoded once. The ids go back
to their block, which puts them in their places. A word is moved once per
block, never once per occurrence: a word that every document uses is as many
rows as there are blocks, and no key can be hot.

Words are packed: one row holds the words of one block in one hash bucket, and
the answer lists their ids in the same order. The positions travel once, as
variable-length integers in which frequent words take one byte.

Decoding joins ids with the token-byte table, whose size is that of the
vocabulary (about 50,000 rows whatever the corpus), by index inside the task.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, text_bytes, tidy, unvarint, varint
from triagelake.llm.hashing import hash_ranges, pieces_of
from triagelake.llm.shared import table

#: Bytes of text in a block.
BLOCK = 6 << 20
#: What decoding gives, to Spark and to Arrow.
DECODED = "doc_id long, ids binary, bytes binary"
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])
#: Marks that end a word and are one of their own.
ENDINGS = (".", ",", ";", ":", "?")
#: White space of another kind, or control characters on whose class libraries differ: the pattern then runs over the whole text.
UNUSUAL = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.lru_cache(2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@functools.lru_cache(2)
def _coded_ids(n: int) -> list[bytes]:
    """The varint of each id below ``n``; made by one call for all, since every task of encoding makes the table again."""
    coded = varint(np.arange(n))
    ends = (np.flatnonzero(np.frombuffer(coded, np.uint8) < 128) + 1).tolist()
    return [coded[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]


@functools.lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, and each id's offset."""
    ranks = _ranks(path)
    rows = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        rows[i] = token
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


#: Bytes of which a doubtful white space or control character has one (in UTF-8); texts with any are looked at more closely.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _chunk_numbers(column: pa.Array, pattern: str) -> tuple[list[str], list[np.ndarray]]:
    """The distinct chunks of a block's texts, in an order that the texts alone decide, and each text's chunk numbers.

    A chunk is a piece that the pattern splits alone as it does in place: blanks
    and what follows them up to the next blank. Chunks are told apart by 64-bit
    hashes within their block. A text with unusual white space is split by the
    pattern itself, and its chunks are its words.
    """
    raw, offsets = text_bytes(column)
    blank = (raw == 32) | (raw == 10)
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    first = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    for a, b in pieces_of(offsets):
        lo, hi, base = first[a], first[b], offsets[a]
        hashes[lo:hi] = hash_ranges(raw[base : offsets[b]], starts[lo:hi] - base, ends[lo:hi] - base)
    number = pd.factorize(hashes)[0]
    where = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))  # each chunk's first use
    data = raw.tobytes()
    chunks = [data[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    texts = [number[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    doubtful = np.unique(np.searchsorted(offsets, np.flatnonzero(_DOUBTFUL[raw]), "right") - 1)
    extra = _Numbers()
    for i in doubtful.tolist():
        text = data[offsets[i] : offsets[i + 1]].decode()
        if UNUSUAL.search(text):
            texts[i] = np.array([len(chunks) + extra[w] for w in _pattern(pattern).findall(text)], np.int64)
    return chunks + list(extra), texts


class _Numbers(dict):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _words_of(chunks: Iterable[str], pattern: str) -> tuple[dict[str, int], list[int], list[int]]:
    """The distinct words of distinct chunks, numbered; all chunks' word numbers, and each chunk's number of words."""
    split, numbers = _pattern(pattern).findall, _Numbers()
    flat: list[int] = []
    sizes: list[int] = []
    for chunk in chunks:
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():  # letters alone, with or without a blank: one word of every such pattern
            words = [chunk]
        elif body[-1:] in ENDINGS and body[:-1].isalpha():
            words = [chunk[:-1], chunk[-1]]
        else:
            words = split(chunk)
        flat += map(numbers.__getitem__, words)
        sizes.append(len(words))
    return numbers, flat, sizes


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(by_bytes(batches, "text", size)):
        yield (part << 24) + k, batch


def _bucket_rows(words: list[str], buckets: int) -> tuple[list[np.ndarray], list[bytes]]:
    raw = [w.encode() for w in words]
    home = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(buckets + 1))
    return [order[cuts[b] : cuts[b + 1]] for b in range(buckets)], raw


def _join(parts: list[bytes]) -> bytes:
    return varint(np.array([len(parts), *map(len, parts)])) + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    # the lengths lead, so read as many numbers as the first one says
    n, at = 0, 0
    while True:
        byte = data[at]
        n |= (byte & 127) << (7 * at)
        at += 1
        if byte < 128:
            break
    raw = np.frombuffer(data, np.uint8, offset=at)
    ends = np.flatnonzero(raw < 128)
    head = int(ends[n - 1]) + 1 if n else 0
    bounds = at + head + np.concatenate(([0], np.cumsum(unvarint(raw[:head].tobytes()))))
    return [data[bounds[i] : bounds[i + 1]] for i in range(n)]


def _emit_words(pattern: str, buckets: int, size: int):
    def words(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        chunks, _ = _chunk_numbers(batch["text"], pattern)
        homes, raw = _bucket_rows(list(_words_of(chunks, pattern)[0]), buckets)
        full = [b for b in range(buckets) if len(homes[b])]
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([_join([raw[i] for i in homes[b]]) for b in full], pa.binary())],
            ["block", "bucket", "packed"],
        )

    def run(batches):
        for block, batch in _blocks(batches, size):
            yield words(block, batch)  # nothing of a block is held when the next one is read
    return run


def _encode_words(path: str, pattern: str):
    """Encodes each distinct word of the task once. A bucket is wholly in one task."""
    def run(batches):
        encoder = _encoder(path, pattern)
        one, known, coded = encoder._encode_single_piece, {}, _coded_ids(encoder.n_vocab)
        for batch in batches:
            answers = []
            for packed in batch["packed"].to_pylist():
                lists = []
                for w in _split(packed):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = b"".join([coded[i] for i in one(w)])
                    lists.append(ids)
                answers.append(_join(lists))
            yield pa.RecordBatch.from_arrays(
                [batch["block"], batch["bucket"], pa.array(answers, pa.binary())], ["block", "bucket", "packed"],
            )
    return run


def _emit_positions(pattern: str, buckets: int, size: int):
    """A row for each document, and one (bucket -2) with the block's word numbers by bucket."""
    def positions(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        chunks, texts = _chunk_numbers(batch["text"], pattern)
        words, flat, sizes = _words_of(chunks, pattern)
        flat, offsets = np.array(flat, np.int32), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        homes, _ = _bucket_rows(list(words), buckets)
        # frequent words get small numbers, which take fewer bytes
        uses = np.bincount(flat, np.repeat(np.bincount(np.concatenate(texts), minlength=len(sizes)), sizes), len(words)) if len(words) else np.empty(0)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(words))
        flat = rank[flat].astype(np.int32)
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n + 1), pa.int64()), pa.array([-1] * n + [-2], pa.int32()),
                pa.concat_arrays([batch["doc_id"].cast(pa.int64()), pa.nulls(1, pa.int64())]),
                pa.array([varint(_flat(flat, offsets, t)) for t in texts] + [varint(rank[np.concatenate(homes)])], pa.binary()),
            ],
            ["block", "bucket", "doc_id", "packed"],
        )

    def run(batches):
        for block, batch in _blocks(batches, size):
            yield positions(block, batch)
    return run


def _flat(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The slices ``offsets[i]:offsets[i+1]`` of ``values`` for each i in ``pick``, one after another."""
    sizes = offsets[pick + 1] - offsets[pick]
    total = int(sizes.sum())
    start = np.repeat(offsets[pick] - (np.cumsum(sizes) - sizes), sizes)
    return values[start + np.arange(total)]


def _reassemble(coded: pa.Table, places: pa.Table) -> pa.Table:
    """Puts the ids of one block's words in their places: doc_id and the ids as unsigned 32-bit integers."""
    bucket, packed = places["bucket"].to_pylist(), places["packed"].to_pylist()
    order = [unvarint(p) for b, p in zip(bucket, packed, strict=True) if b == -2]
    answers = [w for _, p in sorted(zip(coded["bucket"].to_pylist(), coded["packed"].to_pylist(), strict=True)) for w in _split(p)]
    if len(order) != 1 or len(answers) != len(order[0]):
        raise RuntimeError("a block's words differ between two readings: documents must give the same rows each time")
    lists: list[bytes] = [b""] * len(answers)
    for at, ids in zip(order[0].tolist(), answers, strict=True):
        lists[at] = ids
    flat = b"".join(lists)
    done = np.concatenate(([0], np.cumsum(np.frombuffer(flat, np.uint8) < 128)))  # ids ended before each byte
    offsets = done[np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)]
    ids = unvarint(flat)
    docs = [i for i, b in enumerate(bucket) if b == -1]
    out = [_flat(ids, offsets, unvarint(packed[i])).astype("<u4").tobytes() for i in docs]
    return pa.table([places["doc_id"].take(pa.array(docs, pa.int64())), pa.array(out, pa.binary())], names=["doc_id", "ids"])


def _blocks_joined(docs: DataFrame, path: str, pattern: str, block_bytes: int):
    """Each block's coded words with its places, to be put together."""
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(tidy(_emit_words(pattern, buckets, block_bytes)), "block long, bucket int, packed binary")
    coded = words.repartition(buckets, "bucket").mapInArrow(tidy(_encode_words(path, pattern), _encoder, _coded_ids), "block long, bucket int, packed binary")
    places = rows.mapInArrow(tidy(_emit_positions(pattern, buckets, block_bytes)), "block long, bucket int, doc_id long, packed binary")
    return coded.groupBy("block").cogroup(places.groupBy("block"))


def bpe_encode(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit integers) of every document.

    Reads doc_id and text; ``docs`` must give the same rows whenever it is read
    (a table, or a checkpoint), which is verified block by block. A null text
    is an empty one and has no ids; repeated rows and null ids are kept as they
    are; an empty table gives an empty result. Special strings are plain text.
    Smaller blocks take less memory in a task and shuffle more.
    """
    return _blocks_joined(docs, path, pattern, block_bytes).applyInArrow(_reassemble, "doc_id long, ids binary")


def _decode(path: str):
    def run(batches):
        table_bytes, offsets = _token_bytes(path)
        for batch in by_bytes(batches, "ids", 1 << 20):
            out = [None if x is None else _flat(table_bytes, offsets, np.frombuffer(x, "<u4").astype(np.int64)).tobytes() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])
    return run


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``bytes``: each id joined with the token-byte table, in order.

    A null ``ids`` gives null bytes, empty ids give no bytes; an id beyond the table raises.
    """
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decode(path)), DECODED)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK) -> DataFrame:
    """``bpe_decode`` of ``bpe_encode``, each block decoded by the worker that puts its ids together: a task holds one worker, not two."""
    decode = _decode(path)

    def run(coded: pa.Table, places: pa.Table) -> pa.Table:
        return pa.Table.from_batches(decode(_reassemble(coded, places).to_batches()), _DECODED)

    return _blocks_joined(docs, path, pattern, block_bytes).applyInArrow(run, DECODED)


def bpe_digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them; the ids themselves if wanted."""
    return bpe_round_trip(docs, path, pattern, block_bytes).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
