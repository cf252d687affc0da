"""Token ids as Arrow files of fixed-size-list batches, with random access.

A run writes files in ascending id order.  File k holds the token streams of its
documents, laid end to end and cut into sequences of ``SEQ_LEN`` ids:

* ``tokens-00000-<attempt>.arrow``: Arrow IPC file, columns ``ids`` (fixed_size_list of uint16, or of
  uint32 for a vocabulary above 65,536 ids) and ``mask`` (fixed_size_list of bool, false on
  the padding of the last sequence); every batch but the last has ``BATCH_SEQS`` rows, so
  sequence i is row i % BATCH_SEQS of batch i // BATCH_SEQS: one seek, no copy of the ids;
* ``index-00000-<attempt>.arrow``: doc_id, offset in the file's stream, length (with the end id), in
  batches of ``INDEX_ROWS`` documents.

Each attempt of a task writes files of its own, and the manifest names those that count: a task
that runs again (a lost executor, speculation) neither replaces nor renames a file, which not every
store can do in one step.  Files of lost attempts stay until their folder goes.

Ids come from the tokenizers library.  Texts are cut into the vocabulary's words (texts beyond
Latin-1 at ASCII white space, which no token crosses); the library encodes each distinct word or
chunk, and its ids are remembered.

Scale: texts are range-sorted by id, so each file is one task's documents, ``file_rows`` of them
or so whatever the size of the table; documents stream through the writer and the reader, and
the index does too.  The sort key goes on with a hash of the text and the row's place, so equal
or null ids are cut over files like any others.

Defined results: null text is empty (only the end id); null ids come first; rows with equal
ids are ordered by a hash of their text; very long texts are encoded and written whole; extra
columns are ignored, whatever their names; an empty table writes no file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm.bpe import _ODD_SPACE, _SPACE, CACHE, CACHE_CHARS, WordBpe, public_path
from assayer.llm.common import bounded_batches, exact_id, materialize, scratch_path, table

SEQ_LEN = 2048
BATCH_SEQS = 64
#: Documents per file, and per batch of its index; documents of a file at least, where more files keep more cores busy.
FILE_ROWS, INDEX_ROWS, LEAST_FILE_ROWS = 8192, 8192, 512
INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def _schema(dtype: np.dtype) -> pa.Schema:
    ids = pa.list_(pa.from_numpy_dtype(dtype), SEQ_LEN)
    return pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), SEQ_LEN))])


class LibraryEncoder(WordBpe):
    """The library's ids of whole texts: it encodes each distinct word, or chunk between blanks, once.

    Cutting texts into words and remembering them is :class:`~assayer.llm.bpe.WordBpe`'s; its
    own encoding takes no part.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.chunks: dict[str, bytes] = {}
        self._begin_fast()

    def _of(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]

    def encode_symbols(self, syms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = syms.astype(np.uint8).tobytes()
        ids = self._of([raw[a : b - 1].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])
        bounds = np.cumsum([0, *map(len, ids)])
        return np.fromiter(chain.from_iterable(ids), np.int64, int(bounds[-1])), bounds

    def encode_chunked(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        known = self.chunks
        cut = [_SPACE.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        new = list({c for cs in cut for c in cs if c not in known})
        got = {c: np.array(ids, "<u4").tobytes() for c, ids in zip(new, self._of(new))} if new else {}
        known.update({c: ids for c, ids in got.items() if len(c) <= CACHE_CHARS})
        return [np.frombuffer(b"".join([known[c] if c in known else got[c] for c in cs]), "<u4") for cs in cut]


_LOADED: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def _names(root: str, shard: int, attempt: str) -> list[str]:
    """A file of ids and one of documents.  Each attempt of a task has names of its own, so nothing is renamed or replaced; the manifest names those that count."""
    return [f"{root}/{kind}-{shard:05d}-{attempt}.arrow" for kind in ("tokens", "index")]


class _Writer:
    """One file and its index, written as documents arrive."""

    def __init__(self, uri: str, shard: int, dtype: np.dtype):
        self.fs, root = _open_fs(uri)
        self.fs.create_dir(root)
        self.attempt = uuid.uuid4().hex
        self.schema, self.dtype = _schema(dtype), dtype
        self.sinks = [self.fs.open_output_stream(n) for n in _names(root, shard, self.attempt)]
        self.file, self.index = (pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.schema, INDEX)))
        self.held, self.n_held, self.total, self.docs = [], 0, 0, 0
        self.entries: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.entries.append((doc_id, self.total, len(ids)))
        self.docs += 1
        if len(self.entries) >= INDEX_ROWS:
            self._flush_index()
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= SEQ_LEN * BATCH_SEQS:
            self._flush(False)

    def _flush_index(self) -> None:
        if self.entries:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.entries)], schema=INDEX))
        self.entries = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        step = SEQ_LEN * BATCH_SEQS
        at = 0
        while len(flat) - at >= step or last and at < len(flat):
            part = flat[at : at + step]
            pad = -len(part) % SEQ_LEN
            mask = np.ones(len(part) + pad, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(pad, self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQ_LEN) for x in (part, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            at += step
        self.held = [flat[at:]]
        self.n_held = len(self.held[0])

    def close(self) -> tuple[int, int]:
        self._flush(True)
        self._flush_index()
        for file, sink in zip((self.file, self.index), self.sinks):
            file.close()
            sink.close()
        return self.docs, self.total


class TokenFile:
    """Random access to one file: sequences, masks and documents."""

    def __init__(self, uri: str, shard: int, attempt: str):
        fs, root = _open_fs(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader, self.entries = (pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path)) for path in _names(root, shard, attempt))
        self._at, self._batch = -1, None

    def documents(self):
        """(doc_ids, offsets, lengths) of the documents in order, a batch of the index at a time."""
        for k in range(self.entries.num_record_batches):
            yield tuple(c.to_pylist() for c in self.entries.get_batch(k).columns)

    def _ids(self, k: int) -> np.ndarray:
        if k != self._at:
            self._batch, self._at = self.reader.get_batch(k), k
        return self._batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        return self._ids(i // BATCH_SEQS)[i % BATCH_SEQS * SEQ_LEN :][:SEQ_LEN]

    def mask(self, i: int) -> np.ndarray:
        row = self.reader.get_batch(i // BATCH_SEQS).column(1).slice(i % BATCH_SEQS, 1)
        return row.flatten().to_numpy(zero_copy_only=False)

    def span(self, offset: int, length: int) -> np.ndarray:
        step, parts = SEQ_LEN * BATCH_SEQS, []
        while length > 0:
            part = self._ids(offset // step)[offset % step :][:length]
            parts.append(part)
            offset, length = offset + len(part), length - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, uri: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_rows: int | None = None) -> DataFrame:
    """Writes the files below ``uri``; returns their manifest: shard, attempt, n_docs, n_tokens, base.

    ``file_rows``: documents of a file, about (``FILE_ROWS``, or fewer, so that small tables keep all cores
    busy); a table of billions of documents wants larger files, which take no more memory.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    n = rows.select("doc_id").count()
    files = max(1, -(-n // (file_rows or FILE_ROWS)), 0 if file_rows else min(spark.sparkContext.defaultParallelism, n // LEAST_FILE_ROWS))
    top = max(library_encoder(path).library.get_vocab(with_added_tokens=True).values())
    name = "<u2" if max(top, end_id) < 1 << 16 else "<u4"

    def write(batches):
        writer, bpe = None, library_encoder(path)
        shard = TaskContext.get().partitionId()
        for pdf in batches:
            if len(pdf) and writer is None:
                writer = _Writer(uri, shard, np.dtype(name))
            if len(pdf):
                for doc_id, ids in zip(pdf["doc_id"].tolist(), bpe.encode_ids([t or "" for t in pdf["text"]])):
                    writer.add(None if pd.isna(doc_id) else int(doc_id), np.append(ids, end_id).astype(name))
        if writer:
            n_docs, n_tokens = writer.close()
            yield pd.DataFrame({"shard": [shard], "attempt": [writer.attempt], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    order = ["doc_id", "_hash", "_place"]
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    manifest = materialize(rows.selectExpr(exact_id("doc_id", "doc_id"), "text").mapInPandas(write, "shard int, attempt string, n_docs long, n_tokens long"), "manifest")
    before = W.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    return manifest.withColumn("base", F.sum("n_tokens").over(before) - F.col("n_tokens"))


def read_documents(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def read(batches):
        for pdf in batches:
            for shard, attempt, base in zip(pdf["shard"].tolist(), pdf["attempt"], pdf["base"].tolist()):
                f = TokenFile(uri, shard, attempt)
                for ids, offset, length in f.documents():
                    crc = [zlib.crc32(f.span(o, n).astype("<u4").tobytes()) for o, n in zip(offset, length)]
                    yield pd.DataFrame({
                        "doc_id": pd.array(ids, "Int64"),
                        "start": np.array(offset, np.int64) + base,
                        "n_tokens": np.array(length, np.int64),
                        "ids_crc32": np.array(crc, np.int64),
                    })

    # an explicit number of partitions, which Spark does not coalesce: a file is a task
    spread = manifest.repartition(max(1, manifest.count()), "shard")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(spark, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), uri, public_path())
    return read_documents(manifest, uri)
