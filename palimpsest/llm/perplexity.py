"""Operator 10: cross-entropy difference of two n-gram models with one vocabulary.

The target model is counted on the documents that a table of labels marks (quality 1), the
background model on all documents. Both use the same vocabulary (every word of the corpus),
counts of their own for every word and every bigram, and the same smoothing; background counts are scaled to
the size of the target, so that smoothing weighs alike in both. Each document is held out of the models that score it: its
own words and bigrams are taken off the background, and off the target too if it is a marked one. A document's score is the
target's mean loss a token less the background's: lower is nearer to the target.

The counts are nowhere in one place and grow with the corpus. Documents are dealt into blocks of about BLOCK
bytes. A block sends its distinct words with their counts to buckets by range of key; a bucket adds up what all
blocks sent and answers each with the sums of the words that it asked for. Bigrams go the same way
in a second round, and then a block has all that its documents need. The driver gets three numbers.

The key of a word is a 64-bit hash of it (SipHash), that of a bigram a 64-bit hash of two such keys: among n distinct
keys n^2 / 2^65 pairs are expected to share one (10^9 bigrams: 0.03 pairs).

Words are lower-cased and parted at ASCII white space; each document starts behind a
boundary and ends with one. A null or empty text has one token, the end. Without target
documents the target model is uniform over the vocabulary. Rows repeat as they come, and in their order (a row is held out, its
repetition is not); rows with the same id are in one block. A long text is a part of its block as others are. An empty table gives
an empty table. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, releasing, text_bytes

MIX = 0.7  # weight of the bigram against the unigram
BLOCK = 10_000_000  # bytes of text
WORDS_OF = 8  # blocks to a bucket of words; bigrams have as many buckets as there are blocks
LABEL, WORD, PAIR = 0, 1, 2  # kinds of mail
_MAIL = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("label_id", pa.int64()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])
_MAIL_SQL = "block int, bucket int, kind int, label_id bigint, keys binary, background binary, target binary"
_SCORES = pa.schema([("pos", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "pos bigint, doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, first all lowest bytes: the shuffle's compression finds the zeros."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if values.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    size = raw[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(size, -1).T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size]).ravel()


def _words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of all texts in a row, with an end (the empty word) before each text and behind the last; tokens by text."""
    words, sizes = [b""], []
    for t in texts:
        found = text_bytes(t.as_py()).lower().split()
        words += found
        words.append(b"")
        sizes.append(len(found) + 1)
    flat = np.empty(len(words), object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False), np.array(sizes, np.int64)


def _pairs(keys: np.ndarray) -> np.ndarray:
    x = keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + (keys[1:] ^ keys[1:] >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _send(kind: int, buckets: int):
    """From the documents of a block and the ids of marked ones: its distinct keys and their counts, by bucket."""
    starts = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def send(docs: pa.Table, labels: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _MAIL.empty_table()
        keys, sizes = _words(docs.column("text"))
        marked = np.repeat(pc.is_in(docs.column("doc_id"), labels.column("label_id").combine_chunks().drop_null()).to_numpy(), sizes)
        keys, at = np.unique(keys[1:] if kind == WORD else _pairs(keys), return_inverse=True)
        background, target = np.bincount(at, minlength=len(keys)), np.bincount(at[marked], minlength=len(keys))
        ends = [*np.searchsorted(keys, starts).tolist(), len(keys)]
        full = [k for k in range(buckets) if ends[k] < ends[k + 1]]
        parts = [slice(ends[k], ends[k + 1]) for k in full]
        n = len(full)
        cols = [pa.array([docs.column("block")[0].as_py()] * n, pa.int32()), pa.array(full, pa.int32()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64())]
        cols += [pa.array([_planes(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()), *[pa.array([_planes(c[p]) for p in parts], pa.binary()) for c in (background, target)]]
        return pa.Table.from_arrays(cols, schema=_MAIL)

    return send


def _answer(kind: int):
    """Adds up the counts that all blocks sent to a bucket; each block gets the sums of the keys that it sent, in their order. Words: one
    more row, of no block, with the number of distinct words and of tokens in all and in marked documents."""

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, keys, counts = [], [], ([], [])
        for b in batches:
            blocks += b.column(0).to_pylist()
            keys += [np.cumsum(_numbers(raw.as_py()), dtype=np.uint64) for raw in b.column(4)]
            for c, column in zip(counts, (5, 6)):
                c += [_numbers(raw.as_py()) for raw in b.column(column)]
        ends = np.cumsum([0, *map(len, keys)])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        keys.clear()
        sums = [np.bincount(at, np.concatenate(c), len(found)).astype(np.int64) for c in counts]
        parts = [at[a:z] for a, z in zip(ends, ends[1:])]
        out = [[_planes(s[p]) for p in parts] for s in sums]
        extra = [None] * len(blocks)
        if kind == WORD:
            blocks, extra = [*blocks, -1], [*extra, _planes(np.array([len(found)]))]
            out = [[*o, _planes(np.array([s.sum()]))] for o, s in zip(out, sums)]
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(extra, pa.binary()), *[pa.array(o, pa.binary()) for o in out]], schema=_MAIL)

    return answer


def _losses(word: np.ndarray, before: np.ndarray, pair: np.ndarray, scale: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """Interpolated bigram model: MIX * c(ab) / c(a) + (1 - MIX) * (c(b) + 1) / (n + V), for each token its c(b), c(a) and c(ab)."""
    floor = (word * scale + 1) / (total * scale + size)
    return -np.log(MIX * np.where(before > 0, pair / np.maximum(before, 1), floor) + (1 - MIX) * floor)


def _own(owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How often each token's key stands in its own document."""
    _, back, counts = np.unique(owner * n + at, return_inverse=True, return_counts=True)
    return counts[back]


def _score(size: int, total: int, marked: int):
    """From the documents of a block and the answers to it: losses. size: of the vocabulary; total, marked: tokens of all and of marked documents."""

    def score(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORES.empty_table()
        keys, sizes = _words(docs.column("text"))
        words, at = np.unique(keys[1:], return_inverse=True)
        pairs, pair_at = np.unique(_pairs(keys), return_inverse=True)
        counts = {}
        for kind, asked in ((WORD, words), (PAIR, pairs)):
            rows = mail.filter(pc.equal(mail.column("kind"), kind)).sort_by("bucket")
            counts[kind] = [np.concatenate([_numbers(raw.as_py()) for raw in rows.column(c)]).astype(np.int64) for c in ("background", "target")]
            if any(len(c) != len(asked) for c in counts[kind]):
                raise ValueError(f"{len(asked)} keys asked for, {len(counts[kind][0])} answered")
        ends, starts = int(np.searchsorted(words, keys[0])), np.cumsum(sizes) - sizes
        labels = mail.filter(pc.equal(mail.column("kind"), LABEL)).column("label_id").combine_chunks()
        mine = pc.is_in(docs.column("doc_id"), labels.drop_null()).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own_word, own_pair = _own(owner, at, len(words)), _own(owner, pair_at, len(pairs))
        own_before = np.concatenate([[1], own_word[:-1]])
        own_before[starts] = 1  # the end, once a document
        before = np.concatenate([[ends], at[:-1]])
        tokens = np.array([total, marked])[:, None] - np.stack([sizes, sizes * mine])  # without the document
        losses = []
        for k, out in enumerate((np.ones_like(mine), mine)):
            off = np.repeat(out, sizes)
            scale = tokens[1] / np.maximum(tokens[0], 1) if marked and not k else np.ones(len(sizes))
            token = _losses(counts[WORD][k][at] - off * own_word, counts[WORD][k][before] - off * own_before, counts[PAIR][k][pair_at] - off * own_pair, np.repeat(scale, sizes), np.repeat(tokens[k], sizes), size)
            losses.append(np.add.reduceat(token, starts) / sizes)
        background, target = losses
        return pa.Table.from_arrays([docs.column("pos"), docs.column("doc_id"), pa.array(sizes), pa.array(target), pa.array(background), pa.array(target - background)], schema=_SCORES)

    return score


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference a token)."""
    known = docs.select(F.octet_length("text").alias("n"), F.spark_partition_id().alias("part")).agg(F.sum("n").alias("bytes"), F.max("part").alias("last")).first()
    blocks = -(-(known["bytes"] or 1) // BLOCK)
    block = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")
    texts = bounded(docs).select(F.monotonically_increasing_id().alias("pos"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.withColumn("block", F.when(F.col("doc_id").isNull(), block("text")).otherwise(block("doc_id"))).groupBy("block")
    marked = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("label_id"))
    empty = [F.lit(None).cast("binary").alias(n) for n in ("keys", "background", "target")]
    marked = marked.select(block("label_id").alias("block"), F.lit(0).alias("bucket"), F.lit(LABEL).alias("kind"), "label_id", *empty)

    def round_of(kind: int, buckets: int, mail: DataFrame) -> DataFrame:
        sent = texts.cogroup(mail.groupBy("block")).applyInArrow(releasing(_send(kind, buckets)), _MAIL_SQL)
        return sent.groupBy("bucket").applyInArrow(releasing(_answer(kind)), _MAIL_SQL)

    words = cut(round_of(WORD, -(-blocks // WORDS_OF), marked))
    sums = [[int(_numbers(bytes(v))[0]) for v in r] for r in words.where("block < 0").select("keys", "background", "target").collect()]
    size, total, of_target = (sum(s) for s in zip(*sums)) if sums else (0, 0, 0)
    answers = words.where("block >= 0").unionByName(round_of(PAIR, blocks, marked)).unionByName(marked)
    scored = texts.cogroup(answers.groupBy("block")).applyInArrow(releasing(_score(size + 1, total, of_target)), _SCORES_SQL)  # and a place for a word never seen
    back = scored.repartitionById((known["last"] or 0) + 1, F.shiftright("pos", 33).cast("int"))
    return back.sortWithinPartitions("pos").drop("pos")
