"""Operator 13: which tokens of two tokenizers cover the same bytes.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (SentencePiece) the text, to which it adds the space itself. The
ends of the tokens of either are bits in a packed bitset over the bytes; the AND of the two has the shared cuts. Selecting its set bits
gives the cuts, and a rank (popcounts of whole words, summed, and of a masked word) of a cut in the bitset of A or B the number of
tokens up to it: so a byte cut becomes a range of tokens. The tokens between two cuts are a group, `a1,a2|b1`. The
two tokens that end at a cut are linked; a pair of ids counts as often as it is linked in the whole table.

Neither tokenizer has a token over the boundary before a single space behind a character that is no white space: A parts texts there by
its pattern, and no piece of B holds U+2581 behind another character (checked at loading). So a text is cut there and each
distinct part encoded and aligned once while a worker remembers it (two generations of CACHE parts). A text with a part
whose bytes a tokenizer does not keep is encoded as a whole instead.

Spark's part: one narrow stage encodes (written once in the shared checkpoint folder), an aggregate counts the pairs, and blocks of counts meet
blocks of documents by (block of pairs, share of documents); there is a block of pairs for each PAIRS distinct ones and a share for
each ENTRIES entries, so what meets in a task is bounded, however often a pair occurs. Nothing but two totals reaches the driver.

Odd cases. A text that is null or empty, or whose bytes A or B changes, has no tokens: zeros and ''. Special tokens in a text are plain
text. Repeated rows are rows of their own, and each counts; a null doc_id stays null. A long text is encoded part by part. An empty table gives
an empty table. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, ddl, ensure_checkpoints, releasing

CACHE = 200_000
PAIRS = 2_000_000
ENTRIES = 4_000_000
SPACE = "▁"
_PART = re.compile(rf"(?<=[^\s{SPACE}]) (?=[^ ])")


def _byte_alphabet() -> dict[str, int]:
    """The signs by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size + 63) // 64 * 64, bool)
        flags[positions] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """The positions of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """Set bits up to each position, itself included."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        word, bit = positions >> 6, (positions & 63).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return before[word] + np.bitwise_count(self.words[word] & mask)


class Aligner:
    """Encodes with both tokenizers and aligns. `parts` gives (groups, tokens of A, tokens of B, links) of texts, None for one whose
    bytes are not kept."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of a space and each text, ids by B of each text."""
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def parts(self, texts: list[str]) -> list[tuple | None]:
        ids_a, ids_b = self.encode(texts)
        out: list[tuple | None] = [None] * len(texts)
        good = []
        for i, (t, x, y) in enumerate(zip(texts, ids_a, ids_b)):
            raw = b" " + t.encode()
            if b"".join([self.bytes_a[k] for k in x]) == raw and b"".join([self.bytes_b[k] for k in y]) == raw:
                good.append(i)
        if not good:
            return out
        # all texts one behind the other: their ends are cuts
        flat_a, flat_b = (np.fromiter((k for i in good for k in ids[i]), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]) - 1, np.cumsum(self.size_b[flat_b]) - 1
        bits_a, bits_b = (Bits.of(e, int(ends_a[-1]) + 1) for e in (ends_a, ends_b))
        cuts = (bits_a & bits_b).select()
        upto_a, upto_b = bits_a.rank(cuts), bits_b.rank(cuts)
        links = (flat_a[upto_a - 1] << 15 | flat_b[upto_b - 1]).astype("<i4")
        at_a, at_b, at = 0, 0, 0
        text_a, text_b, upto_a, upto_b = [str(k) for k in flat_a.tolist()], [str(k) for k in flat_b.tolist()], upto_a.tolist(), upto_b.tolist()
        for i in good:
            end_a, end_b = at_a + len(ids_a[i]), at_b + len(ids_b[i])
            groups, first = [], at
            while at_a < end_a:
                groups.append(",".join(text_a[at_a : upto_a[at]]) + "|" + ",".join(text_b[at_b : upto_b[at]]))
                at_a, at_b, at = upto_a[at], upto_b[at], at + 1
            out[i] = (";".join(groups).encode(), len(ids_a[i]), len(ids_b[i]), links[first:at].tobytes())
        return out

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """The same for whole documents, by their parts."""
        split = [(_PART.split(t) if self.parted else [t]) if t else [] for t in texts]
        missing = [p for p in {p for ps in split for p in ps} if p not in self.new]
        unknown = []
        known: dict[str, tuple | None] = {}
        for p in missing:
            if p in self.old:
                known[p] = self.new[p] = self.old[p]
            else:
                unknown.append(p)
        for k in range(0, len(unknown), 20_000):
            known.update(zip(unknown[k : k + 20_000], self.parts(unknown[k : k + 20_000])))
        for p in unknown:
            if len(p) <= 64:
                self.new[p] = known[p]
        get = lambda p: known[p] if p in known else self.new[p]
        out: list[tuple | None] = []
        for t, ps in zip(texts, split):
            got = [get(p) for p in ps]
            if not got:
                out.append(None)
            elif None in got:
                out.append(self.parts([t])[0] if len(ps) > 1 else None)
            else:
                out.append((b";".join([g[0] for g in got]), sum([g[1] for g in got]), sum([g[2] for g in got]), b"".join([g[3] for g in got])))
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_ALIGNED = [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups_sha256", "string")]


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (distinct linked ids of A and B as a * 2^15 + b, and how often); with
    keep_groups also groups, the alignment itself (`a1,a2|b1;a3|b2`)."""
    fields = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    fields += [("groups", pa.string())] if keep_groups else []
    schema = pa.schema(fields)

    def rows(ids: list, texts: list) -> pa.RecordBatch:
        aligner = _ALIGNERS.get((path_a, path_b)) or _ALIGNERS.setdefault((path_a, path_b), Aligner(path_a, path_b))
        cols: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, got in zip(ids, aligner.align(texts)):
            groups, n_a, n_b, links = got or (b"", 0, 0, b"")
            pairs, times = np.unique(np.frombuffer(links, "<i4"), return_counts=True)
            values = [doc_id, n_a, n_b, len(links) // 4, len(links) // 4, hashlib.sha256(groups).hexdigest() if got else "", pairs, times.astype(np.int32), groups.decode()]
            for f, v in zip(schema, values):
                cols[f.name].append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield rows(part.column(0).to_pylist(), part.column(1).to_pylist())

    kinds = {"doc_id": "bigint", "groups_sha256": "string", "groups": "string", "pairs": "array<int>", "times": "array<int>"}
    return bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(releasing(run), ", ".join(f"{f.name} {kinds.get(f.name, 'bigint')}" for f in schema))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count, best: linked pairs of ids over the whole table, and whether no pair with the same id of B is more frequent."""
    entries = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("count"))
    rivals = Window.partitionBy(F.col("pair").bitwiseAND((1 << 15) - 1))  # at most as many rows as A has ids
    return entries.select("pair", "count", (F.col("count") == F.max("count").over(rivals)).alias("best"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared checkpoint folder: read several times, made once."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_PARTIAL = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _blocks(n: int):
    """Rows of aligned documents -> a row for each block of pairs that one has entries in (block 0 always); only that has the other columns."""

    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("block", "at", "pairs", "times")}
            lists = b.column("pairs"), b.column("times")
            for i in range(b.num_rows):
                pairs, times = (c[i].values.to_numpy() for c in lists)
                block = pairs % n
                for k in [0, *np.unique(block[block > 0]).tolist()]:
                    mine = block == k
                    for name, v in zip(cols, (k, i, pairs[mine], times[mine])):
                        cols[name].append(v)
            at, first = np.array(cols["at"], np.int64), pa.array(np.array(cols["block"], np.int64) > 0)
            rest = [b.column(f) for f, _ in _ALIGNED]
            taken = [pa.compute.if_else(first, pa.scalar(None, c.type), c.take(pa.array(at))) for c in rest]
            arrays = [pa.array(cols["block"], pa.int32()), b.column("row").take(pa.array(at)), *taken, pa.array(cols["pairs"], pa.list_(pa.int32())), pa.array(cols["times"], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "row", *(f for f, _ in _ALIGNED), "pairs", "times"])

    return run


def _meet(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the entries of each document that lie in this block of pairs."""
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, count, best = pair[order], counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    sizes = pa.compute.list_value_length(pairs).to_numpy()
    entries, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    at = np.searchsorted(pair, entries)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edge])
    found = [total(weight * best[at]), total(weight * count[at])] if len(entries) else [np.zeros(len(sizes), np.int64)] * 2
    return pa.table([*(docs.column(f.name) for f in _PARTIAL if f.name in docs.column_names), *(pa.array(v, pa.int64()) for v in found)], schema=_PARTIAL)


def with_counts(aligned: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 from aligned documents: n_best links have a pair that no other pair
    with their id of B exceeds, count_sum adds the counts of all links' pairs."""
    docs = _written(aligned.select(F.monotonically_increasing_id().alias("row"), *(f for f, _ in _ALIGNED), "pairs", "times"), "aligned")
    counts = _written(pair_counts(docs), "pairs")
    entries = docs.agg(F.sum(F.size("pairs").cast("bigint"))).first()[0] or 0
    blocks, shares = -(-counts.count() // PAIRS) or 1, -(-entries // ENTRIES) or 1
    parted = bounded(docs).mapInArrow(releasing(_blocks(blocks)), "block int, row bigint, " + ", ".join(f"{n} {t}" for n, t in _ALIGNED) + ", pairs array<int>, times array<int>")
    left = parted.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int"))
    right = counts.select("pair", "count", "best", (F.col("pair") % blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    met = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(releasing(_meet), ddl(_PARTIAL))
    whole = met.groupBy("row").agg(*(F.max(f).alias(f) for f, _ in _ALIGNED), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def cross_tokenizer(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return with_counts(align_documents(docs, path_a, path_b, keep_groups=False))
