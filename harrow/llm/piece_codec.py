"""SentencePiece encoding and decoding by one Aho-Corasick pass per pre-token.

The automaton holds every ordinary piece.  Running it over a text visits, at
each position, the piece that ends there and then, along the output links, each
shorter piece that ends there too; every visit relaxes the best score of that
position, so one pass gives the Viterbi path.  A character that is no piece by
itself may stand alone at ``UNKNOWN_PENALTY`` below the lowest score and is
written as its UTF-8 byte pieces.  Among equal scores the longest last piece
wins.

No piece holds a space mark behind another character, or a line feed, so paths
break at pre-tokens (checked on load) and each worker keeps the paths of the
pre-tokens it has seen.  Spaces are marked and one is put in front of a text,
as the model's own rules say; decoding undoes that.

Defined results: null and empty texts have no pieces; the mark itself inside a
text comes back as a space, as in the library (``round_trip`` compares with
that); special strings are ordinary text; repeated rows give repeated rows; an
empty table gives an empty result; a column of the input that has the name of a
new one is replaced by ``encode_documents``.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from harrow.llm.common import id_text, ship_code, slices
from harrow.llm.token_counts import DEFAULT_MODEL, SPACE, model_path, pretokens, worker_value

UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
#: Pre-tokens whose paths a worker keeps, and the longest of them.
CACHE_SIZE, MAX_KEY = 250_000, 64


class PieceCodec(dict):
    """Encoder and decoder of one model; as a dict it holds the paths of pre-tokens."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE) -> None:
        super().__init__()
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache_size = cache_size
        self.pieces: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_of: dict[int, int] = {}
        self.unknown = sp.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        lowest = 0.0
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} reaches across pre-tokens")
                score = sp.get_score(i)
                lowest = min(lowest, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.surface = [
            "" if sp.is_control(i) else " \u2047 " if sp.is_unknown(i) else piece.replace(SPACE, " ")
            for i, piece in enumerate(self.pieces)]
        for i, b in self.bytes_of.items():
            self.surface[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.unknown_score = lowest - UNKNOWN_PENALTY

    def fallback(self, char: str) -> list[int]:
        """Byte pieces of a character, or the unknown piece where the model has none."""
        ids = [self.byte_ids.get(b) for b in char.encode()]
        return [self.unknown] if None in ids else ids

    def viterbi(self, marked: str) -> tuple[int, ...]:
        """Ids of the best path over a text whose spaces are marked."""
        n = len(marked)
        best: list[float] = [0.0] + [NEVER] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        alone = [at for at, c in enumerate(marked) if c not in self.single]
        if alone:
            alone.append(n)
        todo = 0
        for last, (length, score, i) in self.automaton.iter(marked):
            while alone and alone[todo] < last:  # earlier positions are final now
                self._stand_alone(best, back, alone[todo])
                todo += 1
            end = last + 1
            score += best[end - length]
            if score > best[end]:
                best[end] = score
                back[end] = (length, i)
        for at in alone[todo:-1]:
            self._stand_alone(best, back, at)
        ids: list[int] = []
        while n:
            length, i = back[n]
            if i < 0:
                ids.extend(reversed(self.fallback(marked[n - 1])))
            else:
                ids.append(i)
            n -= length
        ids.reverse()
        return tuple(ids)

    def _stand_alone(self, best: list[float], back: list[tuple[int, int]], at: int) -> None:
        score = best[at] + self.unknown_score
        if score > best[at + 1]:
            best[at + 1], back[at + 1] = score, (1, -1)

    def __missing__(self, pretoken: str) -> tuple[int, ...]:
        ids = self.viterbi(pretoken.replace(" ", SPACE))
        if len(pretoken) <= MAX_KEY:
            if len(self) >= self.cache_size:
                self.clear()
            self[pretoken] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pretokens(text))))

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        if not text.isascii():  # high byte pieces wait as lone surrogates
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _codec(path: str) -> PieceCodec:
    return worker_value("pieces.codec", path, lambda: PieceCodec(path))


def _int_lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = array("i")
    for r in rows:
        flat.extend(r)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32), pa.int32()))


def encode_documents(docs: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with ``piece_ids`` (array<int>) and ``n_pieces`` of every whole text."""
    ship_code(docs.sparkSession)
    path = model_path(model)
    names = [c for c in docs.columns if c not in ("piece_ids", "n_pieces")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in slices(batches):
            kept = [b.column(i) for i, c in enumerate(b.schema.names) if c in names]
            ids = [codec.encode(t or "") for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*kept, _int_lists(ids), pa.array([len(i) for i in ids], pa.int64())],
                names=[*names, "piece_ids", "n_pieces"])

    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields, StructField("piece_ids", ArrayType(IntegerType())),
                         StructField("n_pieces", LongType())])
    return kept.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "piece_ids",
                     model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and the decoded ``text`` of piece ids (null ids: empty)."""
    ship_code(encoded.sparkSession)
    path = model_path(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in slices(batches):
            texts = [codec.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return (encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
            .mapInArrow(decode, "doc_id long, text string"))


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_pieces, piece_ids, decoded_sha256 and round_trip of every whole text.

    Encodes and decodes in the same pass, so that texts move nowhere.
    """
    ship_code(docs.sparkSession)
    path = model_path(model)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids = [codec.encode(t) for t in texts]
            back = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i in ids], pa.int64()), _int_lists(ids),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                 pa.array([x == t.replace(SPACE, " ") for x, t in zip(back, texts, strict=True)])],
                names=["doc_id", "n_pieces", "piece_ids", "decoded_sha256", "round_trip"])

    return id_text(docs, id_col, text_col).mapInArrow(
        both, "doc_id long, n_pieces long, piece_ids array<int>, decoded_sha256 string, round_trip boolean")
