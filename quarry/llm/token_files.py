"""Token-id files: flat unsigned integers plus 64-bit document offsets, read back by memory map.

A part is three files: NAME.ids (unsigned 16 or 32 bit, little endian), NAME.offsets (uint64, one
more than documents: where each document's ids begin) and NAME.docs (int64 document ids). Parts hold
ascending ranges of document ids; the manifest's bases are prefix sums over the parts' sizes.

Defined cases: a null or empty text is the end id alone; rows with a null document id take no part;
repeated ids keep all their rows, side by side in any order; very long texts are encoded whole, and ids go to
the file every FLUSH_BYTES; an empty table gives no documents; other columns do not matter. The string of a
special token in a text becomes its id, as with the library's default, or with special_as_text is text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, partitions, shared_dir, text_of, texts_of, written
from .wordpieces import piece_ids

MANIFEST = "part int, name string, wide boolean, docs long, tokens long"
#: Bytes of ids gathered before they go to the file.
FLUSH_BYTES = 8 << 20


def write_token_files(docs: DataFrame, out_dir: str, vocabulary_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False, special_as_text: bool = False) -> DataFrame:
    """Encode every text, append end_id, write the parts; returns the manifest with each part's base.

    One shuffle brings ascending ranges of document ids together. A task writes under a name of its
    own and only finished tasks reach the manifest, so a repeated task does no harm.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(out_dir)
        encoder = piece_ids(vocabulary, drops_space, special_as_text)
        wide = max(end_id, encoder.tokenizer.get_vocab_size() - 1) > 0xFFFF
        kind = "<u4" if wide else "<u2"
        end = np.asarray([end_id], "<u4").tobytes()
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        lengths, ids = [], []
        with fs.open_output_stream(f"{folder}/{name}.ids") as out:
            held, size = [], 0
            for batch in batches:
                ids.append(np.asarray(batch.column(0), "<i8"))
                for found in encoder.encode_all(texts_of(batch.column(1))):
                    found += end
                    lengths.append(len(found) // 4)
                    held.append(found)
                    size += len(found)
                    if size >= FLUSH_BYTES:
                        out.write(np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
                        held, size = [], 0
            out.write(np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
        if not lengths:
            fs.delete_file(f"{folder}/{name}.ids")
            return
        offsets = np.zeros(len(lengths) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        for suffix, data in (("offsets", offsets), ("docs", np.concatenate(ids))):
            with fs.open_output_stream(f"{folder}/{name}.{suffix}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "wide": [wide], "docs": [len(lengths)], "tokens": [int(offsets[-1])]})

    own = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).filter("id is not null")
    own = own.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id")
    parts = written(own.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    return parts.withColumns({"base": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "first_doc": F.coalesce(F.sum("docs").over(before), F.lit(0))})


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 (unsigned, of 32-bit ids)."""

    def mapped(fs, path: str, kind: str) -> np.ndarray:
        if fs.type_name == "local":
            with pa.memory_map(path) as f:
                return np.frombuffer(f.read_buffer(), kind)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(out_dir)
        for batch in batches:
            for name, wide, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = mapped(fs, f"{folder}/{name}.ids", "<u4" if wide else "<u2")
                offsets = mapped(fs, f"{folder}/{name}.offsets", "<u8").astype("<i8")
                crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(mapped(fs, f"{folder}/{name}.docs", "<i8")), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("name", "wide", "base").repartition(partitions(spark))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary_path: str, end_id: int = 0) -> DataFrame:
    out_dir = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, out_dir, write_token_files(docs, out_dir, vocabulary_path, end_id))
