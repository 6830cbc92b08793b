"""Token ids in files: a document's ids are one zstandard frame, all with one trained dictionary, and an index finds each alone.

A file has, between two marks: frames; the index (ids of documents, where frames begin, how many tokens they hold), compressed; and a
footer in JSON with the dictionary's SHA-256, the width of an id and the index's place.  The dictionary lies beside the files, once.
Files are written by ranges of document ids; a manifest table names those that count, in order, with their tokens, so the number of
tokens before a document is a sum over files and a sum inside one.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickmill.llm.byte_pieces import encoder_of
from kickmill.llm.chunks import release
from kickmill.llm.tables import folder, small_batches
from kickmill.llm.warc import file_system

MARK = b"KMTOKEN1"
#: The dictionary is trained on about so many documents (at most twice as many) of at most so many bytes of text each (drawn by a hash), and has at most so many bytes.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 16, 1 << 16
#: A file is closed when it has so many bytes; readers take about so many bytes at once.
FILE_BYTES, READ_BYTES = 256 << 20, 16 << 20
FILES = "place long, part string, docs long, tokens long, bytes long, dictionary string, least long, most long"
ROWS = "id long, start long, n_tokens long, ids binary"


def serialized(ids: np.ndarray, width: int) -> bytes:
    """Ids as little-endian unsigned integers of ``width`` bytes."""
    return ids.astype(f"<u{width}").tobytes()


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for arrays like these; too few to train on are the dictionary themselves."""
    import zstandard

    if sum(map(len, samples)) >= 8 * size and len(samples) >= 32:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # all alike
            pass
    return b"".join(samples)[:size]


def dictionary_of(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class TokenWriter:
    """Documents appended to a file."""

    def __init__(self, out, dictionary: bytes, width: int, level: int = 3):
        import zstandard

        self.out, self.width, self.hash = out, width, hashlib.sha256(dictionary).hexdigest()
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary_of(dictionary))
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.tokens: list[int] = []
        self.size = self.out.write(MARK)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        frame = self.packer.compress(serialized(ids, self.width))
        self.out.write(frame)
        self.docs.append(doc)
        self.sizes.append(len(frame))
        self.tokens.append(len(ids))
        self.size += len(frame)

    def close(self) -> None:
        import zstandard

        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        index = zstandard.ZstdCompressor().compress(docs.tobytes() + np.array(self.sizes, "<i8").tobytes() + np.array(self.tokens, "<i8").tobytes() + null.tobytes())
        footer = json.dumps({"dictionary": self.hash, "width": self.width, "docs": len(self.docs), "index_at": self.size, "index_bytes": len(index)}).encode()
        tail = index + footer + struct.pack("<I", len(footer)) + MARK
        self.out.write(tail)
        self.out.close()
        self.size += len(tail)


class TokenFile:
    """A file's documents, each read alone: ``docs`` (null ids: None), ``tokens``, ``starts`` (tokens before each in the file)."""

    def __init__(self, source, size: int, dictionary: bytes):
        import zstandard

        self.source = source
        source.seek(size - 12)
        (length,), mark = struct.unpack("<I", source.read(4)), source.read(8)
        if mark != MARK:
            raise ValueError("not a token file, or cut off")
        source.seek(size - 12 - length)
        footer = json.loads(source.read(length))
        if hashlib.sha256(dictionary).hexdigest() != footer["dictionary"]:
            raise ValueError("written with another dictionary")
        self.width, n = footer["width"], footer["docs"]
        source.seek(footer["index_at"])
        raw = zstandard.ZstdDecompressor().decompress(source.read(footer["index_bytes"]))
        self.ids, sizes, self.tokens = (np.frombuffer(raw, "<i8", n, 8 * n * k) for k in range(3))
        self.null = np.frombuffer(raw, np.uint8, n, 24 * n).astype(bool)
        self.at = len(MARK) + np.append(0, np.cumsum(sizes))
        self.starts = np.append(0, np.cumsum(self.tokens))
        self.unpacker = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary))

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document: one seek, one frame."""
        self.source.seek(int(self.at[i]))
        return np.frombuffer(self.unpacker.decompress(self.source.read(int(self.at[i + 1] - self.at[i]))), f"<u{self.width}").astype(np.uint32)

    def places(self, doc: int) -> list[int]:
        """Where documents of this id are: ids ascend, null ones first."""
        nulls = int(self.null.sum())
        lo, hi = (nulls + int(np.searchsorted(self.ids[nulls:], doc, side)) for side in ("left", "right"))
        return list(range(lo, hi))


def end_with(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.append(ids, np.uint32(end_id))


def samples(rows: DataFrame, count: int, tokenizer_path: str, end_id: int, width: int) -> list[bytes]:
    """Serialized arrays of about SAMPLE_DOCUMENTS of ``count`` rows (by a hash), which SAMPLE_DOCUMENTS and SAMPLE_BYTES bound."""

    def per_batch(batches):
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            got = encoder.encode([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([serialized(end_with(x, end_id), width) for x in got], pa.binary())], ["ids"])

    share = min(1.0, SAMPLE_DOCUMENTS / max(1, count))
    drawn = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(1 << 40)) < int(share * (1 << 40))
    few = rows.filter(drawn).filter(F.octet_length("text") <= SAMPLE_BYTES).select("text").limit(2 * SAMPLE_DOCUMENTS)
    return sorted(bytes(r.ids) for r in few.mapInArrow(per_batch, "ids binary").collect())


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the token ids of every document, each followed by ``end_id``, to token files in the new folder ``path``, by ascending id.

    Null and empty texts are ``end_id`` alone.  Null ids come first; equal ids are ordered by a hash of the text, then by the place of
    their row, so repeated rows, too, are dealt to several tasks.  Very long texts are encoded in sections and are one frame.  An
    empty table writes a dictionary and an empty manifest.  Other columns are ignored, whatever their names.  ``part_bytes`` is a
    task's share of the text (by default 16 MB or a two-thousandth, up to 512 MB).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total, count = rows.agg(F.sum(F.octet_length("text").cast("long") + 16), F.count("*")).first()
    total = total or 0
    dictionary = trained(samples(rows, count, tokenizer_path, end_id, width))
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary", compression=None) as out:
        out.write(dictionary)
    share = part_bytes or min(512 << 20, max(16 << 20, total // 2000))

    def per_partition(batches) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        fs, root = file_system(path)
        files, writer, name = [], None, None

        def finished():
            writer.close()
            known = [d for d in writer.docs if d is not None]
            files.append(((TaskContext.get().partitionId() << 20) + len(files), name, len(writer.docs), sum(writer.tokens), writer.size, writer.hash, min(known, default=None), max(known, default=None)))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 200):
                texts = batch.column(1).slice(lo, 200).to_pylist()
                for doc, got in zip(ids[lo : lo + 200], encoder.encode([t or "" for t in texts])):
                    if writer is None:
                        name = f"part-{uuid.uuid4().hex}.tokens"
                        writer = TokenWriter(fs.open_output_stream(f"{root}/{name}", compression=None), dictionary, width)
                    writer.add(doc, end_with(got, end_id))
                    if writer.size >= file_bytes:
                        finished()
                        writer = None
            release()
        if writer is not None:
            finished()
        if files:
            names, types = zip(*[c.split() for c in FILES.split(", ")])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(zip(*files), types)], names)

    keys = ["id", "h", "row"]
    ranged = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-total // share)), *keys).sortWithinPartitions(*keys)
    # a file counts if the task that wrote it is one whose row Spark committed
    ranged.select("id", "text").mapInArrow(per_partition, FILES).write.parquet(f"{path}/manifest")
    counted = {r.part for r in spark.read.schema(FILES).parquet(f"{path}/manifest").select("part").toLocalIterator()}
    from pyarrow import fs as pafs

    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.endswith(".tokens") and f.base_name not in counted:
            fs.delete_file(f.path)


def read_token_files(spark: SparkSession, path: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """A row per document: id, start (tokens of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    What goes through the driver is the list of files, as for every data source.  Large files are read by several tasks.
    """
    files = spark.read.schema(FILES).parquet(f"{path}/manifest").orderBy("place").collect()
    starts = np.append(0, np.cumsum([f.tokens for f in files]))
    ranges = []
    for f, start in zip(files, starts.tolist()):
        n = max(1, -(-f.bytes // read_bytes))
        ranges += [(f.part, start, f.bytes, f.docs * k // n, f.docs * (k + 1) // n) for k in range(n)]
    parts = spark.createDataFrame(ranges, "part string, start long, bytes long, lo long, hi long")

    def per_range(batches) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        dictionary = fs.open_input_stream(f"{root}/dictionary", compression=None).read()
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['part']}") as source:
                    file = TokenFile(source, r["bytes"], dictionary)
                    rows, size = [], 0
                    for i in range(r["lo"], r["hi"]):
                        ids = file.document(i)
                        rows.append((None if file.null[i] else int(file.ids[i]), r["start"] + int(file.starts[i]), len(ids), serialized(ids, 4)))
                        size += 4 * len(ids)
                        if size > 4 << 20 or i == r["hi"] - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "start", "n_tokens", "ids"])
                            rows, size = [], 0

    return parts.mapInArrow(per_range, ROWS)


def find_documents(wanted: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows as of ``read_token_files`` for the distinct ids in ``wanted``: of files that may hold one the index is read, and the frames asked for.

    Null ids and ids that no document has find nothing; an id of several documents finds all.
    """
    spark = wanted.sparkSession
    files = spark.read.schema(FILES).parquet(f"{path}/manifest").orderBy("place").collect()
    starts = np.append(0, np.cumsum([f.tokens for f in files])).tolist()
    held = [(f.part, start, f.bytes, f.least, f.most) for f, start in zip(files, starts) if f.most is not None]
    most = np.array([h[4] for h in held], np.int64)

    def per_partition(batches) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        dictionary = fs.open_input_stream(f"{root}/dictionary", compression=None).read()
        open_part, source, file = None, None, None
        for batch in batches:
            for doc in batch.column(0).to_pylist():
                for part, start, size, least, _ in held[int(np.searchsorted(most, doc)) :]:
                    if least > doc:
                        break
                    if part != open_part:
                        if source is not None:
                            source.close()
                        open_part, source = part, fs.open_input_file(f"{root}/{part}")
                        file = TokenFile(source, size, dictionary)
                    for i in file.places(doc):
                        ids = file.document(i)
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (doc, start + int(file.starts[i]), len(ids), serialized(ids, 4))], ["id", "start", "n_tokens", "ids"])

    ids = wanted.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    return ids.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(per_partition, ROWS)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents in ids of ``byte_bpe_50k.json`` and a final 2, written and read back."""
    import public_tokenizers

    path = folder(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
