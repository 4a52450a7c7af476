"""Token-ID output in the Arrow file format, packed into equal-length sequences.

A *shard* is an Arrow IPC file whose record batches have two fixed-size-list
columns, ``input_ids`` (uint16 or uint32, the narrowest that holds the vocabulary) and
``mask`` (bool), one sequence per row. Batches are
fixed-size and uncompressed, so sequence ``i`` lies at a known place of a memory map
and is read without copying. Documents follow each other without gaps; only the
last sequence of a shard is padded (mask false). ``<shard>.docs`` is a second Arrow
file with doc_id, start (within the shard) and n_tokens of its documents.

Documents are tokenized where they are read; what is shuffled is ids, two bytes
each for vocabularies below 65,536. Shards follow ascending doc_id, by ranges of
doc_id; a task streams its sorted rows and never holds more than one batch.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from siltstone.llm import kernel as K
from siltstone.llm.rows import ROW, append, with_row
from siltstone.llm.scratch import materialize, new_path

#: Ids per sequence, and sequences per record batch.
SEQUENCE = 2048
BATCH = 256
#: Sequences after which a task begins another shard.
SHARD_SEQUENCES = 64 * BATCH
#: Distinct pieces whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED_PIECES = 1_000_000
#: Ids in one range of documents, about.
RANGE_BYTES = 32 << 20
#: Ranges at most: their cuts go with each task (8 bytes each).
MOST_RANGES = 100_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The pre-tokenizer pattern that WordEncoder knows (a fixed value of lower-case word vocabularies).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters beyond ASCII for which lower-casing and composition are plain: Latin-1 and Latin Extended-A.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_PLAIN = re.compile(f"[ \\t-\\r!-~{_LETTERS}]*")
_PIECES = re.compile(f"[a-z{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \\t-\\ra-z0-9{_LETTERS}]+").findall


class Places(dict):
    """Numbers of pieces in the order in which they are first asked for; new ones are kept in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = place = len(self)
        return place


class WordEncoder:
    """Encodes texts piece by piece for tokenizers that split with ``WORD_PATTERN``.

    Such a text's ids are its pieces' ids one after another, and no piece crosses white
    space, so each distinct piece is encoded once. Words with letters outside the plain
    alphabets above go to the tokenizer itself, whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = _tokenizer(path)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self):
        self.places = Places()
        self.store, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.begins, self.counts = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)  # of a piece's ids in the store

    @staticmethod
    def knows(path: str) -> bool:
        spec = json.loads(_tokenizer(path).to_str())
        normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return (
            normal == ["NFC", "Replace", "Lowercase"] and (split.get("pattern") or {}).get("Regex") == WORD_PATTERN and split.get("invert") is True
            and spec["model"].get("end_of_word_suffix") == "</w>" and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )

    def remember(self, places: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while len(self.places) > len(self.begins):
            self.begins, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.counts))
        self.store[self.used : self.used + len(ids)] = ids
        self.begins[places], self.counts[places] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)

    def learn(self):
        """The ids of the pieces that were asked for anew."""
        fresh, self.places.fresh = self.places.fresh, []
        first = len(self.places) - len(fresh)
        odd = np.array([p[0] == "\0" for p in fresh], dtype=bool)
        for at in range(0, len(fresh), 5000):
            part = [p for p in fresh[at : at + 5000] if p[0] != "\0"]
            if part:
                ids = np.array(self.pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                self.remember(first + at + np.flatnonzero(~odd[at : at + 5000]), ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        if odd.any():
            coded = [c.ids for c in self.whole.encode_batch([p[1:] for p in fresh if p[0] == "\0"], add_special_tokens=False)]
            self.remember(first + np.flatnonzero(odd), np.array([i for c in coded for i in c], dtype=np.uint32), np.array([len(c) for c in coded], dtype=np.int64))

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and not any(t in text for t in self.special):
            return _PIECES(text.lower())
        out: list[str] = []
        for word in text.translate(_SPACES).split(" "):
            if word and (not _PLAIN.fullmatch(word) or any(t in word for t in self.special)):
                out.append("\0" + word)
            else:
                out += _PIECES(word.lower())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, equal to the tokenizer's own."""
        if len(self.places) > REMEMBERED_PIECES:
            self.reset()
        look = self.places.__getitem__
        found = [np.fromiter(map(look, pieces), np.int64, len(pieces)) for pieces in map(self.split, texts)]
        if self.places.fresh:
            self.learn()
        return [self.store[K.ragged(self.begins[at], self.counts[at])] for at in found]


_SPACES = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def encode_documents(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, end_id: int | None = 1,
    id_col: str | None = None, cuts: np.ndarray | None = None,
) -> DataFrame:
    """``row`` (struct of the kept columns), ``ids`` (little-endian), ``n_tokens`` and ``range_id``.

    Null texts are empty. ``range_id`` is the place of ``id_col`` among the sorted ``cuts``, else 0.
    """

    def fn(batch):
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordEncoder(tokenizer_path) if WordEncoder.knows(tokenizer_path) else None
        encoder = _encoders[tokenizer_path]
        kind = _id_type(tokenizer_path)
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        column = batch.column("text")
        places = np.zeros(len(column), np.int32)
        if cuts is not None and len(cuts):
            key = batch.column("key")
            places = np.where(key.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(cuts, key.fill_null(0).to_numpy()), 0).astype(np.int32)
        for row, _, offsets in K.slices(column, 1 << 20):
            texts = [t or "" for t in column.slice(row, len(offsets) - 1).to_pylist()]
            coded = encoder.encode(texts) if encoder else [np.array(c.ids, np.uint32) for c in _tokenizer(tokenizer_path).encode_batch(texts, add_special_tokens=False)]
            yield row, len(texts), {
                "ids": K.as_binary([np.concatenate([c, tail]).astype(kind).tobytes() for c in coded]),
                "n_tokens": pa.array([len(c) + len(tail) for c in coded], pa.int64()),
                "range_id": pa.array(places[row : row + len(texts)]),
            }

    fields = [StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("range_id", IntegerType())]
    return append(with_row(docs, {"text": text_col} | ({"key": id_col} if id_col else {}), keep), fn, fields)


def _id_type(tokenizer_path: str) -> np.dtype:
    return np.dtype("<u2" if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4")


_encoders: dict = {}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    """Streams documents into one shard; files appear under their name when complete."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: np.dtype, sequence: int, batch: int):
        self.fs, self.path, self.kind, self.sequence, self.batch = fs, path, kind, sequence, batch
        self.temp = f"{path}.{uuid.uuid4().hex}"
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.docs_sink = fs.open_output_stream(f"{self.temp}.docs")
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs_writer = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = self.n_docs = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.docs.append((doc_id, self.total, len(ids)))
        self.n_docs += 1
        self.total += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.sequence * self.batch:
            flat = np.concatenate(self.pending)
            full = len(flat) // (self.sequence * self.batch) * self.sequence * self.batch
            for at in range(0, full, self.sequence * self.batch):
                self.put(flat[at : at + self.sequence * self.batch], self.batch * self.sequence)
            self.pending, self.waiting = [flat[full:]], len(flat) - full
        if len(self.docs) >= 4096:
            self.put_docs()

    def put(self, flat: np.ndarray, real: int):
        lists = lambda values: pa.FixedSizeListArray.from_arrays(values, self.sequence)
        mask = pa.array(np.arange(len(flat)) < real)
        self.writer.write_batch(pa.RecordBatch.from_arrays([lists(pa.array(flat)), lists(mask)], schema=self.schema))

    def put_docs(self):
        if self.docs:
            self.docs_writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=self.docs_schema))
            self.docs = []

    def close(self) -> tuple[str, int, int]:
        flat = np.concatenate([*self.pending, np.zeros(0, self.kind)])
        if len(flat):
            size = -(-len(flat) // self.sequence) * self.sequence
            self.put(np.concatenate([flat, np.zeros(size - len(flat), self.kind)]), len(flat))
        self.put_docs()
        for x in (self.writer, self.sink, self.docs_writer, self.docs_sink):
            x.close()
        # same rows, same bytes: of a task that runs twice the first whole file stays, so readers always find one
        for end in (".docs", ""):
            if self.fs.get_file_info(self.path + end).type == pafs.FileType.NotFound:
                try:
                    self.fs.move(self.temp + end, self.path + end)
                    continue
                except OSError:  # a rival attempt was faster
                    if self.fs.get_file_info(self.path + end).type == pafs.FileType.NotFound:
                        raise
            self.fs.delete_file(self.temp + end)
        return self.path, self.n_docs, self.total


def read_shard(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the shard, ids) of the documents of a shard, in their order."""
    local = isinstance(fs, pafs.LocalFileSystem)
    source = pa.memory_map(path) if local else fs.open_input_file(path)
    with source, fs.open_input_file(f"{path}.docs") as docs_file:
        reader, docs = pa.ipc.open_file(source), pa.ipc.open_file(docs_file)
        held, base, nxt = np.zeros(0, np.uint16), 0, 0
        for d in range(docs.num_record_batches):
            batch = docs.get_batch(d)
            for doc_id, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while base + len(held) < start + count:
                    piece = reader.get_batch(nxt).column("input_ids").values.to_numpy(zero_copy_only=True)
                    keep = held[start - base :]
                    held, base, nxt = (np.concatenate([keep, piece]) if len(keep) else piece), start, nxt + 1
                yield doc_id, start, held[start - base : start - base + count]


class Shard:
    """Random access to the sequences of a shard: ``shard[i]`` is (ids, mask) of sequence i.

    Ids are a view of NumPy's, the mask (one bit each) a view of Arrow's; on a local file system both lie in the
    memory map of the file and nothing is copied. All batches but the last hold equally many
    sequences, so where sequence i stands is known without reading others.
    """

    def __init__(self, fs: pafs.FileSystem, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        n = self.reader.num_record_batches
        self.batch = self.reader.get_batch(0).num_rows if n else 1
        self.length = (n - 1) * self.batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < self.length:
            raise IndexError(f"sequence {i} of {self.length}")
        held, row = self.reader.get_batch(i // self.batch), i % self.batch
        ids, mask = (held.column(c) for c in ("input_ids", "mask"))
        size = ids.type.list_size
        return ids.values.slice(row * size, size).to_numpy(zero_copy_only=True), mask.values.slice(row * size, size)

    def close(self) -> None:
        self.source.close()


def open_shard(uri: str) -> Shard:
    """A shard of ``write_token_shards`` by its path."""
    return Shard(*open_fs(uri))


SHARD = StructType([StructField("range_id", LongType()), StructField("part", LongType()), StructField("path", StringType()), StructField("n_docs", LongType()), StructField("n_tokens", LongType())])


def write_token_shards(docs: DataFrame, tokenizer_path: str, out_uri: str | None = None, end_id: int | None = 1, sequence: int = SEQUENCE) -> DataFrame:
    """Write the shards of (doc_id, text) and return the manifest: one row per shard.

    Columns: range_id, part, path, n_docs, n_tokens and first_token (ids before the shard).
    Null texts are empty documents; a null doc_id comes first; rows of equal doc_id stand in
    the order of their ids' bytes; no rows give no shard; very long texts are encoded whole. Only
    doc_id and text are read, so other columns may have any names.
    """
    spark = docs.sparkSession
    out_uri = out_uri or new_path(spark, "shards")
    # Ranges of doc_id of about equal text: cuts from a summary, rows are not moved for it.
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n")).first()
    n = max(1, min(MOST_RANGES, round((size["b"] or 0) / RANGE_BYTES)))
    cuts = np.zeros(0, np.int64)
    if n > 1 and size["n"]:
        found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first()["c"]
        cuts = np.array(sorted(set(found)), np.int64)
    coded = encode_documents(docs, tokenizer_path, keep=["doc_id"], end_id=end_id, id_col="doc_id", cuts=cuts)
    coded = coded.select("range_id", F.col(f"{ROW}.doc_id").alias("doc_id"), "ids")
    ranged = coded.repartitionById(n, "range_id").sortWithinPartitions("range_id", F.col("doc_id").asc_nulls_first(), "ids")
    wide = _id_type(tokenizer_path).str

    def write(batches):
        fs, base = open_fs(out_uri)
        fs.create_dir(base, recursive=True)
        writer, key, part = None, None, 0
        
        def row():
            path, n_docs, n_tokens = writer.close()
            values = (key, part, f"{out_uri}/{path.rpartition('/')[2]}", n_docs, n_tokens)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], SHARD.names)

        for batch in batches:
            for r, doc_id, ids in zip(batch.column("range_id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if writer and (r != key or writer.total >= SHARD_SEQUENCES * sequence):
                    yield row()
                    writer, part = None, part + 1 if r == key else 0
                if not writer:
                    key = r
                    writer = ShardWriter(fs, f"{base}/shard-{key:06d}-{part:04d}.arrow", np.dtype(wide), sequence, BATCH)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype=wide))
        if writer:
            yield row()

    manifest = materialize(ranged.mapInArrow(write, SHARD), "manifest")
    before = Window.orderBy("range_id", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 from the files of a manifest."""
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                (fs, place), rows = open_fs(path), []
                for doc_id, start, ids in read_shard(fs, place):
                    rows.append((doc_id, first + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                    if len(rows) >= 8192:
                        yield _rows(rows, schema)
                        rows = []
                if rows:
                    yield _rows(rows, schema)

    spread = manifest.select("path", "first_token").repartition(max(1, min(MOST_RANGES, manifest.count())), "path")
    return spread.mapInArrow(read, schema)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema.names)
