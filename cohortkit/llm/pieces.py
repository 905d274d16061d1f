"""SentencePiece encoding and decoding through distinct-chunk tables.

In a vocabulary where the white-space mark (U+2581) stands only at the front of a
piece, no merge crosses into a mark from the left, so a text falls into chunks
(marks and the run up to the next mark) that are segmented independently.  Each
task keeps a table of the distinct chunks of the rows it reads: a chunk is
segmented once, when first seen, and the ids of all texts are gathered from the
table by position.  The table belongs to the task, as shuffling every
(document, position, chunk) row to one global table would move many times the
text; it is started afresh when it holds ``max_chunks`` chunks, which bounds memory
and changes no result.  The vocabulary is checked for the property; one without
it is encoded text by text.

Defined cases: NULL text counts as empty; an empty text has no ids; literal marks
are spaces, as in the library; repeated rows and ids are independent; an empty table
gives no rows.  Key columns are returned as given, no other column is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import ranges, sha256_hex, text_batches

MARK = "▁"
_MODELS: dict[str, object] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(model: str):
    """The loaded model, once per worker process."""
    if model not in _MODELS:
        import sentencepiece

        _MODELS[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _MODELS[model]


def marks_lead(sp) -> bool:
    """True if no piece has a mark after another character, and a lone mark is a piece."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces) and sp.piece_to_id(MARK) != sp.unk_id()


def chunks(text: str) -> list[str]:
    """Chunks of a text without their first mark (which every chunk has; the text gets one in front)."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    return [c[1:] for c in re.findall(" +[^ ]*", " " + text)]


class ChunkTable:
    """Distinct chunks seen so far, their ids in one flat array."""

    def __init__(self, sp, max_chunks: int):
        self.sp, self.max_chunks = sp, max_chunks
        self.clear()

    def clear(self):
        lone = self.sp.piece_to_id(MARK)
        self.code = {"": 0}  # a mark with nothing after it: the library drops it from an empty text
        self.flat, self.lens = [np.array([lone], np.int32)], [np.array([1], np.int64)]

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = chunks(t)
            counts[i] = len(w)
            words += w
        if len(self.code) > self.max_chunks:
            self.clear()
        code = self.code
        new = list(set(words).difference(code))
        if new:
            enc = self.sp.encode(new, num_threads=1)
            self.lens.append(np.fromiter(map(len, enc), np.int64, len(enc)))
            self.flat.append(np.fromiter((x for e in enc for x in e), np.int32))
            code.update(zip(new, range(len(code), len(code) + len(new))))
            self.flat, self.lens = [np.concatenate(self.flat)], [np.concatenate(self.lens)]
        at = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        lens = self.lens[0]
        starts = np.cumsum(lens) - lens
        got = self.flat[0][ranges(starts[at], lens[at])]
        before = np.concatenate([[0], np.cumsum(lens[at])])
        ends = np.cumsum(counts)
        return got, before[ends] - before[ends - counts]


def _schema(df: DataFrame, keys: Sequence[str], extra: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(extra))


def encode(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text_col: str = "text", model: str | None = None,
           max_chunks: int = 400_000, ids_col: str = "ids") -> DataFrame:
    """Keys and the ids of each whole text, as the library's ``encode`` gives them (no begin or end ids)."""
    model = model or default_model()
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table = ChunkTable(sp, max_chunks) if marks_lead(sp) else None
        for b in text_batches(batches, "__text", 2 << 20):
            texts = [t or "" for t in b.column(len(keys)).to_pylist()]
            if table:
                flat, n = table.ids(texts)
            else:
                enc = sp.encode(texts, num_threads=1)
                n = np.fromiter(map(len, enc), np.int64, len(enc))
                flat = np.fromiter((x for e in enc for x in e), np.int32)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], ids], [*keys, ids_col])

    d = docs.select(*[F.col(k) for k in keys], F.col(text_col).alias("__text"))
    return d.mapInArrow(run, _schema(docs, keys, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids", model: str | None = None,
           text_col: str = "text") -> DataFrame:
    """Kept columns and the text that the library's ``decode`` makes of the ids (NULL ids: empty)."""
    model = model or default_model()
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = [x or [] for x in part.column(len(keep)).to_pylist()]
                texts = pa.array(sp.decode(ids, num_threads=1) if ids else [], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], texts], [*keep, text_col])

    d = coded.select(*[F.col(k) for k in keep], F.col(ids_col).alias("__ids"))
    return d.mapInArrow(run, _schema(coded, keep, [T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, keys: Sequence[str] = ("doc_id",), model: str | None = None) -> DataFrame:
    """Keys, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    ids = encode(docs, keys, model=model)
    digests = ids.select(*keys, F.size("ids").cast("long").alias("n_tokens"),
                         sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), "ids")
    out = decode(digests, [*keys, "n_tokens", "ids_sha256"], model=model, text_col="__decoded")
    return out.select(*keys, "n_tokens", "ids_sha256", sha256_hex(F.col("__decoded")).alias("decoded_sha256"))
