"""Postings of texts in blocks: one row per word and batch of texts, so that what is shuffled and stored is mostly numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words that are packed together; a longer text is packed alone.
PACKED_WORDS = 1 << 18


def _lists(starts: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of texts of a bounded number of words, with the number of words of each."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype("int64")
    run = (np.cumsum(lengths) - lengths) // PACKED_WORDS
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
    for start, end in zip(edges[:-1], edges[1:]):
        yield batch.slice(start, end - start), lengths[start:end]


def packed_postings(texts: DataFrame) -> DataFrame:
    """Blocks ``word, ids, lengths, counts, positions`` of texts ``id, words``.

    A block holds a word's texts of one batch: their ids, how many words
    each has and how often it holds this one, and the positions of all of them one
    text after another. The block of no word holds all texts, without positions.
    """
    kind = ArrayType(IntegerType())
    schema = StructType([StructField("word", StringType()), StructField("ids", ArrayType(texts.schema["id"].dataType)),
                         StructField("lengths", kind), StructField("counts", kind), StructField("positions", kind)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, lengths in _pieces(batch) if batch.num_rows else ():
                ids, total = piece.column("id"), int(lengths.sum())
                entry = piece.column("words").flatten().dictionary_encode()
                owner = np.repeat(np.arange(len(lengths)), lengths)
                position = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                key = entry.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(key, kind="stable")  # by word, then by text and position
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if total else np.zeros(0, "int64")
                of_text, counts = owner[first], np.diff(np.r_[first, total])
                head = np.flatnonzero(np.r_[True, np.diff(key[first]) != 0]) if total else np.zeros(0, "int64")
                words, blocks = key[first][head], np.r_[head, len(first)]
                # the last block is that of all texts
                columns = [
                    pa.concat_arrays([entry.dictionary.take(pa.array(words)).cast(pa.string()), pa.nulls(1, pa.string())]),
                    _lists(np.r_[blocks, len(first) + len(lengths)], ids.take(pa.array(np.r_[of_text, np.arange(len(lengths))]))),
                    _lists(np.r_[blocks, len(first) + len(lengths)], pa.array(np.r_[lengths[of_text], lengths], pa.int32())),
                    _lists(np.r_[blocks, len(first)], pa.array(counts, pa.int32())),
                    _lists(np.r_[first[head], total, total], pa.array(position[order], pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.select("id", "words").mapInArrow(pack, schema)


def packed_rows(index: DataFrame, id_col: str) -> DataFrame:
    """Rows ``bucket, word, <id>, hits`` as blocks ``bucket, word, ids, hits``: what follows each other with the same word."""
    fields = {f.name: f.dataType for f in index.schema}
    schema = StructType([StructField("bucket", fields["bucket"]), StructField("word", fields["word"]),
                         StructField("ids", ArrayType(fields[id_col])), StructField("hits", ArrayType(fields["hits"]))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("word").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            starts = np.r_[head, batch.num_rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket").take(pa.array(head)), batch.column("word").take(pa.array(head)),
                 _lists(starts, batch.column("ids")), _lists(starts, batch.column("hits"))], names=schema.names)

    return index.select("bucket", "word", F.col(id_col).alias("ids"), "hits").sortWithinPartitions("bucket", "word").mapInArrow(pack, schema)
