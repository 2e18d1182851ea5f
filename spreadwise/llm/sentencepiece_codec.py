"""Operator 4: SentencePiece encoding and decoding through a table of distinct chunks.

In this kind of model no piece holds a white space marker after another character, so no merge
crosses the start of a run of markers. A text, with its spaces turned to markers and one marker put
in front, therefore splits into chunks (markers, then everything up to the next marker) that are
segmented independently of each other. Each task keeps a table of the distinct chunks it has met,
segments a new one once with the library, and joins ids and surfaces back by position.
``check_model`` verifies the premise on the model's own pieces before any text is read.

The table belongs to the task and is emptied at ``TABLE_ENTRIES``: vocabularies grow with the
corpus, so one table for all texts would be neither broadcast nor shuffled within bounds. A chunk
of over ``LONG_CHUNK`` characters is segmented without being kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field
from .text import slices

MARK = "▁"
TABLE_ENTRIES = 500_000
LONG_CHUNK = 200


def load(model_file: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def check_model(model) -> None:
    """Raise unless chunks are independent under this model."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} holds a marker after another character: chunks are not independent")
    probe = "Åﬁ① x　y  \t\n"
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model rewrites text: only identity normalisation keeps chunks apart")


class Codec:
    """Encode and decode texts chunk by chunk; equal to the library's result on the whole text."""

    def __init__(self, model):
        self.model = model
        self.ids: dict[str, str] = {}          # chunk without its first marker -> ids as text
        self.surface: dict[str, str] = {}      # the same -> decoded text

    def learn(self, chunks: list[str]) -> None:
        """Segment the chunks that the table lacks, each once."""
        if len(self.ids) > TABLE_ENTRIES:
            self.ids, self.surface = {}, {}
        new = [c for c in set(chunks).difference(self.ids) if c]
        if "" not in self.ids:
            # the library puts a marker in front of what it encodes, but encodes nothing as nothing
            self.ids[""], self.surface[""] = str(self.model.piece_to_id(MARK)), " "
        found = self.model.encode(new, num_threads=1)
        for c, i, d in zip(new, found, self.model.decode(found, num_threads=1), strict=True):
            self.ids[c], self.surface[c] = " ".join(map(str, i)), " " + d

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without their first marker. Further markers of a run stay with what follows."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts[:-1]:
            return parts
        out, run = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        out.append(" " * run + parts[-1])
        return out

    def encode(self, texts: list[str], end_id: int) -> tuple[list[str], list[str]]:
        """Ids of each text, the end id included, joined by a space; and the decoded texts."""
        parts = [self.chunks(t) if t else [] for t in texts]
        self.learn([c for p in parts for c in p if len(c) <= LONG_CHUNK])
        ids, decoded = [], []
        for p in parts:
            if any(len(c) > LONG_CHUNK for c in p):
                own = Codec(self.model)
                own.learn(p)
            else:
                own = self
            ids.append(" ".join([*map(own.ids.__getitem__, p), str(end_id)]))
            decoded.append("".join(map(own.surface.__getitem__, p))[1:])
        return ids, decoded


_CODECS: dict[str, Codec] = {}


def codec_of(model_file: str) -> Codec:
    """The worker's codec: its table outlives a task, as the worker does."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(load(model_file))
    return _CODECS[model_file]


def _task(model_file: str, id_name: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        end_id = codec.model.eos_id()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = codec.encode(part.column("text").to_pylist(), end_id)
                sizes = [x.count(" ") + 1 for x in ids]
                if digests:
                    body = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    flat = np.fromstring(" ".join(ids), dtype=np.int32, sep=" ")
                    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    body = [pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), pa.array(texts, pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), *body], names=[id_name, "n_tokens", *names])
    return run


def sentencepiece_round_trip(documents: DataFrame, model_file: str, id_col: str = "doc_id",
                             text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text (end id appended, no sampling) and decode the ids again.

    Returns one row for each input row: the id, ``n_tokens`` (all ids), and ``ids`` (array of int)
    with ``decoded``, or with ``digests`` instead ``ids_sha256`` (decimal ids joined by one space) and
    ``decoded_sha256``. Other columns are not read. Null or empty text gives the end id alone and an
    empty decoded text; repeated rows give repeated results; an empty table gives an empty result.
    """
    check_model(load(model_file))
    schema = [T.StructField(id_col, field(documents, id_col).dataType), T.StructField("n_tokens", T.LongType())]
    if digests:
        schema += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        schema += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_task(model_file, id_col, digests), T.StructType(schema))
