"""Token ids on disk: shards of one concatenated id array with Elias-Fano document boundaries.

A shard file is, little-endian:

    magic "QTOK", version u32, id bytes u32 (2 or 4), rows u64, rows without an id u64, ids u64,
    smallest doc_id i64, section sizes u64 x 2, then the sections
    boundaries (rows + 1 offsets, Elias-Fano), doc_ids (ascending, Elias-Fano over the unsigned doc_id - smallest), ids

An Elias-Fano section holds n ascending values below u in about n (2 + log2(u / n)) bits: the low
``l`` bits of each in an array, the rest as a unary bit vector, and the position of each 256th one of
that vector as u32, from which :meth:`EliasFano.select` counts on. No 64-bit offset is stored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

MAGIC, VERSION, STEP = b"QTOK", 1, 256
HEADER = struct.Struct("<4sIIQQQqQQ")
EF_HEADER = struct.Struct("<QQII")
#: Ids after which a task starts its next shard file; a document is never cut.
SHARD_IDS = 4_000_000


class EliasFano:
    """Ascending unsigned 64-bit values with constant-time access by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n and most >= n else 0
        low = np.packbits(((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low_bits else np.empty(0, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::STEP].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value number ``i``: from the sampled one on, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STEP]), i % STEP
        byte, skip = divmod(at, 8)
        word = int(self.high[byte]) & (0xFF << skip)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit // 8]) >> bit % 8 & 1) << k
        return (one - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """All values, as unsigned numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            values |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return values

    def to_bytes(self) -> bytes:
        return EF_HEADER.pack(self.n, len(self.high), self.low_bits, len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, n_high, low_bits, n_samples = EF_HEADER.unpack_from(data)
        n_low, at = (n * low_bits + 7) // 8, EF_HEADER.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", n_samples, at + n_low + n_high))


def pack(doc_ids: list[int | None], lengths: list[int], ids: bytes, id_bytes: int) -> bytes:
    """A shard of rows in ascending order, those without an id first. ``ids``: their ids, one after another."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds, names = (EliasFano.of(x).to_bytes() for x in (np.cumsum([0, *lengths]), known.view(np.uint64) - np.int64(first).view(np.uint64)))
    return HEADER.pack(MAGIC, VERSION, id_bytes, len(doc_ids), len(doc_ids) - len(known), len(ids) // id_bytes, first, len(bounds), len(names)) + bounds + names + ids


class Shard:
    """A shard file's rows, read from its bytes without copying the ids."""

    def __init__(self, data: bytes):
        magic, version, id_bytes, self.rows, self.unnamed, self.n_ids, self.first, n_bounds, n_names = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        view = memoryview(data)[HEADER.size :]
        self.bounds, self.names = EliasFano.from_bytes(view), EliasFano.from_bytes(view[n_bounds:])
        self.ids = np.frombuffer(view, f"<u{id_bytes}", self.n_ids, n_bounds + n_names)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self.names.all() + np.int64(self.first).view(np.uint64)).view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of row ``i``."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class Encoder:
    """Ids of whole texts as bytes, word by word from a memo.

    A tokenizer that drops white space and never joins words across it gives a text the ids of its
    words in turn; one that lower-cases and cuts letters from ASCII punctuation gives a word of both the
    ids of its lower-case letters and of its punctuation. ``whole_text`` turns that off for other
    tokenizers; texts with one of U+001C-001F, which Python splits at and the tokenizer does not, are
    always encoded whole. Words not seen before are encoded together.
    """

    #: Letters that have one lower-case letter each, then punctuation.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$]*)")
    #: Longer words are not worth a place in the memo.
    LONG = 100

    def __init__(self, path: str, whole_text: bool = False):
        self.tokenizer, self.whole_text = Tokenizer.from_file(path), whole_text
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        #: Ids that end a word, if the tokenizer marks them.
        self.ends = np.zeros(max(vocab.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def texts(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.id_bytes}"
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def simple(self, cores: list[str]) -> list[bytes]:
        """Ids of words that the tokenizer does not cut, encoded as one text and told apart by their last ids."""
        if self.ends is None or not cores:
            return self.texts(cores)
        ids = np.array(self.tokenizer.encode(" ".join(cores), add_special_tokens=False).ids, np.int64)
        cut = (np.flatnonzero(self.ends[ids]) + 1) * self.id_bytes
        if len(cut) != len(cores):
            return self.texts(cores)
        data, cut = ids.astype(f"<u{self.id_bytes}").tobytes(), cut.tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def learn(self, unseen: set[str]) -> None:
        if len(self.words) + len(unseen) > common.MEMO_ENTRIES:
            self.words.clear()
        if len(self.cores) + len(unseen) > 3 * common.MEMO_ENTRIES // 2:
            self.cores.clear()
        known, heads, tails, odd, match = [], [], [], [], self.SIMPLE.fullmatch
        for w in unseen:
            m = match(w)
            if m is None:
                odd.append(w)
            else:
                head, tail = m.groups()
                known.append(w)
                heads.append(head.lower())
                tails.append(tail)
        self.words.update(zip(odd, self.texts(odd)))
        cores = self.cores
        cores.setdefault("", b"")
        new = list(set(heads).union(tails) - cores.keys())
        for at in range(0, len(new), 20_000):
            cores.update(zip(new[at : at + 20_000], self.simple(new[at : at + 20_000])))
        of = cores.__getitem__
        self.words.update(zip(known, map(add, map(of, heads), map(of, tails))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for a null or empty one."""
        made: list[bytes | None] = [None] * len(texts)
        split: list[list[str]] = []
        for i, text in enumerate(texts):
            whole = text and (self.whole_text or any(c in text for c in "\x1c\x1d\x1e\x1f"))
            if whole:
                made[i] = self.texts([text])[0]
            split.append([] if whole or not text else text.split())
        seen = set().union(*split)
        rare = {w for w in seen if len(w) > self.LONG}
        unseen = seen - self.words.keys() - rare
        if len(self.words) + len(unseen) > common.MEMO_ENTRIES:
            unseen = seen - rare  # learn() starts anew
        self.learn(unseen)
        of = self.words.__getitem__
        if rare:
            long = dict(zip(rare, self.texts(list(rare))))
            of = lambda w: long[w] if w in long else self.words[w]
        return [b"".join(map(of, words)) if done is None else done for done, words in zip(made, split)]


@lru_cache(2)
def encoder(path: str, whole_text: bool) -> Encoder:
    return Encoder(path, whole_text)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", shard_ids: int = SHARD_IDS, whole_text: bool = False) -> DataFrame:
    """Writes the ids of ``docs`` as shard files under ``folder`` in ascending doc_id order; returns the manifest.

    Manifest rows are ``part, shard, path, rows, ids, base``; ``base`` is the number of ids before the
    shard. Shards of tasks that failed or ran twice have other names and are in no manifest. Rows
    without an id come first, rows of one id by the first 32 characters of their text (null texts count as
    empty), then by its hash; rows of one id, however many, may be dealt to several tasks. ``end_id`` is
    appended to each row. ``folder`` and ``tokenizer`` are paths that every executor sees. An empty table
    gives an empty manifest; other columns are not read. Ids may be any 64-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, made = encoder(tokenizer, whole_text), TaskContext.get().partitionId(), []
        end = b"" if end_id is None else int(end_id).to_bytes(e.id_bytes, "little")
        names, lengths, parts, n = [], [], [], 0
        files, root = open_fs(folder)

        def flush() -> None:
            path = f"{root}/part-{part:06d}-{len(made):06d}-{uuid.uuid4().hex}.qtok"
            data = pack(names, lengths, b"".join(parts), e.id_bytes)
            with files.open_output_stream(path) as out:
                out.write(data)
            made.append((part, len(made), path, len(names), n))

        for batch in batches:
            for piece in common.slices(batch, 500):
                for name, ids in zip(piece.column(0).to_pylist(), e.encode(piece.column(1).to_pylist())):
                    ids += end
                    names.append(name)
                    lengths.append(len(ids) // e.id_bytes)
                    parts.append(ids)
                    n += lengths[-1]
                    if n >= shard_ids:
                        flush()
                        names, lengths, parts, n = [], [], [], 0
        if names:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["part", "shard", "path", "rows", "ids"])

    files, root = open_fs(folder)
    files.create_dir(root)
    known = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), known.alias("text"), F.left(known, F.lit(32)).alias("head"), F.xxhash64(known).alias("hash"), F.monotonically_increasing_id().alias("row"))
    # ascending partitions of ascending rows; all but the first key only split what one id has
    keys = ("doc_id", "head", "hash", "row")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards = common.written(dealt.mapInArrow(run, "part bigint, shard bigint, path string, rows bigint, ids bigint"), "token-shards")
    # one row a shard, so a window over all of them is small
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return common.written(shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("bigint"))), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of the manifest's shards, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_fs(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(path) as data:
                    shard = Shard(data.read())
                bounds, wide = shard.bounds.all().view(np.int64), memoryview(shard.ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), pa.array(base + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "base").repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
