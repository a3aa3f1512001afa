"""Token ids in files of independent zstandard frames with a trailing seek table.

File format (all integers little-endian).  A file is a row of zstandard frames, each with its content checksum, then two
skippable frames that any zstandard reader passes over:

* the index (magic 0x184D2A50): for each frame the first and last document id (int64), the documents (uint32) and the
  tokens (uint64);
* the seek table of the public seekable format (magic 0x184D2A5E): for each frame its compressed size, its plain size
  and the low 32 bits of the XXH64 of its plain bytes (uint32 each), then the number of frames (uint32), a descriptor
  byte (0x80: with checksums) and the magic 0x8F92EAB1.

A plain frame is: the number of documents (uint32); for each document its id (int64), whether it has one (uint8) and its
tokens (uint32); then all token ids (uint32 each).  Documents stand in ascending order of their ids within and across
files.  A reader fetches the two tables from the end of the file and decompresses only the frames it needs.

Each task writes its own file under a name that no other attempt uses, and the names of the files that count are written
with Spark's commit protocol as the ``manifest`` table.  So a lost executor or a repeated task leaves an unlisted file at
most.  Folders may be any that ``pyarrow.fs`` can open.

Defined results: a null text is an empty one and yields the end id alone; null document ids come first; repeated rows
are all written; an empty table yields an empty manifest.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX_ENTRY, TABLE_ENTRY, FOOTER = struct.Struct("<qqIQ"), struct.Struct("<III"), struct.Struct("<IBI")
FRAME_BYTES = 1 << 18
#: Words whose ids a task remembers.
MEMO_WORDS = 800_000


class CorruptFrame(ValueError):
    """A frame does not have the bytes its checksum was taken of."""


#: A word of Latin letters with marks behind it: two pre-tokens of a byte-level tokenizer.
PLAIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]*)").fullmatch


def byte_characters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


WRITTEN = byte_characters()
SPACE = chr(WRITTEN[32])


class NotByWords(Exception):
    """A text has a word that it cannot be parted before or after."""


class WordMemo(dict):
    """Ids of " " + word by word, as bytes; found when first asked for.

    A plain word goes to the tokenizer's model at once, in the vocabulary's writing; any other to the whole tokenizer.  A
    full memo keeps what it has, as common words come early.  An empty word, one that starts with white space and one
    with an added token in it are never kept.
    """

    def __init__(self, tokenizer, code: str, most: int, added: list[str]) -> None:
        super().__init__()
        self.added = added
        self.encode, self.tokenize, self.code, self.most = tokenizer.encode, tokenizer.model.tokenize, code, most
        self.marks = {"": b""}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN(word)
        if plain is None:
            if not word or word[0].isspace() or any(a in word for a in self.added):
                raise NotByWords
            ids = self.packed(self.encode(" " + word, add_special_tokens=False).ids)
        else:
            letters, marks = plain.groups()
            own = self.get(letters) if marks else None
            if marks not in self.marks:
                if len(self.marks) > 1000:
                    self.marks = {"": b""}
                self.marks[marks] = self.packed([t.id for t in self.tokenize(marks)])
            if own is None:
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(WRITTEN)
                own = self.packed([t.id for t in self.tokenize(SPACE + letters)])
            ids = own + self.marks[marks]
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    """The ids of ``tokenizer.encode(text, add_special_tokens=False)``, by words where that is the same.

    A byte-level tokenizer parts text before a space that a non-space follows, so a text of which all spaces are such is the
    sum of its words.  Any other text, and one with an added token's string in it, is encoded as a whole.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        self.by_words = self.by_words and not self.tokenizer.pre_tokenizer.add_prefix_space
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Added tokens with a space in them are looked for in the whole text, the others in its words.
        self.spaced = [a for a in added if " " in a]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = WordMemo(self.tokenizer, "H" if self.kind.itemsize == 2 else "I", MEMO_WORDS, added)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process, kept over its tasks."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, text: str) -> np.ndarray:
        if self.by_words and not any(a in text for a in self.spaced):
            head, *rest = text.split(" ")
            try:
                ids = b"".join(map(self.memo.__getitem__, rest))
                first = self.tokenizer.encode(head, add_special_tokens=False).ids
                return np.frombuffer(self.memo.packed(first) + ids, self.kind).astype("<u4")
            except NotByWords:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


class FrameWriter:
    """Writes documents to one file, frame by frame."""

    def __init__(self, sink, level: int) -> None:
        self.sink = sink
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = self.n_docs = self.n_tokens = 0
        self.index, self.table = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.size += ids.nbytes + 13
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.docs:
            return
        heads = b"".join(struct.pack("<qBI", d or 0, d is not None, len(i)) for d, i in self.docs)
        plain = struct.pack("<I", len(self.docs)) + heads + b"".join(i.tobytes() for _, i in self.docs)
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        named = [d for d, _ in self.docs if d is not None]
        self.index.append((named[0] if named else 0, named[-1] if named else -1, len(self.docs), sum(len(i) for _, i in self.docs)))
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(INDEX_ENTRY.pack(*x) for x in self.index)
        table = b"".join(TABLE_ENTRY.pack(*x) for x in self.table) + FOOTER.pack(len(self.table), 0x80, FOOTER_MAGIC)
        for magic, body in ((INDEX_MAGIC, index), (TABLE_MAGIC, table)):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)


class FrameReader:
    """Reads the tables at the end of a file, then only the frames asked for."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        n, flags, magic = FOOTER.unpack(source.read_at(FOOTER.size, end - FOOTER.size))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise CorruptFrame("no seek table")
        table_at = end - FOOTER.size - n * TABLE_ENTRY.size
        index_at = table_at - 8 - n * INDEX_ENTRY.size
        self.table = list(TABLE_ENTRY.iter_unpack(source.read_at(n * TABLE_ENTRY.size, table_at)))
        self.index = list(INDEX_ENTRY.iter_unpack(source.read_at(n * INDEX_ENTRY.size, index_at)))
        self.offsets = np.cumsum([0, *(x[0] for x in self.table)]).tolist()
        self.starts = np.cumsum([0, *(x[3] for x in self.index)]).tolist()

    def frames(self, wanted: set[int] | None) -> list[int]:
        if wanted is None:
            return list(range(len(self.table)))
        ids = np.array(sorted(wanted), np.int64)
        return [k for k, (first, last, _, _) in enumerate(self.index) if np.searchsorted(ids, first) < np.searchsorted(ids, last, "right")]

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens of the file before it, ids as little-endian uint32)."""
        unpacker = zstandard.ZstdDecompressor()
        for k in self.frames(wanted):
            packed, size, digest = self.table[k]
            try:
                plain = unpacker.decompress(self.source.read_at(packed, self.offsets[k]), max_output_size=size)
            except zstandard.ZstdError as e:
                raise CorruptFrame(f"frame {k}: {e}") from e
            if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != digest:
                raise CorruptFrame(f"frame {k} does not have its checksum")
            (n,) = struct.unpack_from("<I", plain)
            at, start = 4 + 13 * n, self.starts[k]
            for doc_id, named, tokens in struct.iter_unpack("<qBI", plain[4:at]):
                if wanted is None or named and doc_id in wanted:
                    yield (doc_id if named else None), start, plain[at : at + 4 * tokens]
                at, start = at + 4 * tokens, start + tokens


def opened(folder: str):
    """The file system and the path in it of a URI or a local path."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def _writer(folder: str, tokenizer: str, end_id: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4")
        writer = None
        with_file = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    with_file = fs.open_output_stream(f"{top}/{name}", compression=None)
                    writer = FrameWriter(with_file, level)
                writer.add(doc_id, np.concatenate([encoder.encode(text.as_py() or ""), end]))
        if writer is not None:
            writer.close()
            with_file.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    return run


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, level: int = 1) -> DataFrame:
    """Encode the documents into files under ``folder``; returns the manifest (part, file, n_docs, n_tokens)."""
    fs, top = opened(folder)
    fs.create_dir(top, recursive=True)
    spread = F.xxhash64("text")
    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread)
    files = ordered.mapInArrow(_writer(folder, tokenizer, end_id, level), "part long, file string, n_docs long, n_tokens long")
    files.write.parquet(os.path.join(folder, "manifest"))
    return manifest(documents.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, file string, n_docs long, n_tokens long").parquet(os.path.join(folder, "manifest"))


def _reader(folder: str, wanted: set[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{file}") as source:
                    docs, size = [], 0
                    for doc in FrameReader(source).documents(wanted):
                        docs.append(doc)
                        size += len(doc[2])
                        if size >= 1 << 22:
                            yield _rows(docs, before)
                            docs, size = [], 0
                    yield _rows(docs, before)

    return run


def _rows(docs: list, before: int) -> pa.RecordBatch:
    ids, starts, tokens = zip(*docs, strict=True) if docs else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([before + s for s in starts], pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "start", "ids"]
    )


def read_token_files(spark: SparkSession, folder: str, doc_ids: set[int] | None = None) -> DataFrame:
    """(doc_id, start, ids): the documents, or those of ``doc_ids``; start counts the ids of all documents before.

    ``ids`` are little-endian uint32 bytes.  The running sum is over one row for each file.
    """
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest(spark, folder).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    tasks = files.repartition(max(1, files.count()), "file")
    return tasks.mapInArrow(_reader(folder, doc_ids), "doc_id long, start long, ids binary")
