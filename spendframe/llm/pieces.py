"""Subword encoding that keeps the byte span of every piece in the original text."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from spendframe.llm import common

MARK = "▁"
HELD_IDS = 200_000
DIGESTS = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string, n_spanned: long>"


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 bytes and the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that the text has at a position."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            byte = text[i]
            if byte == 0:
                break
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class Encoder:
    """A model with what it takes to project its pieces to the bytes of a text."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        known = list(range(self.library.get_piece_size()))
        names = [self.library.id_to_piece(i) for i in known]
        self.lengths = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(names[i].encode()) for i in known], dtype=np.int64)
        self.plain = not self.map.units and self.prefix and not self.squeeze and self.escape and not self.suffix
        self.fallback = spec.trainer_spec.byte_fallback
        self.numbers = [str(i) for i in known]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of the text it comes from.

        Replacements are by the longest prefix that the character map knows, other characters stay. White
        space is then marked, put before the text, and squeezed as the model asks for.
        """
        data = text.encode("utf-8", "replace")
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        space = MARK.encode() if self.escape else b" "
        if self.plain:
            buffer = np.frombuffer(data, dtype=np.uint8)
            origin = np.zeros(len(data) + (len(space) - 1) * data.count(b" ") + len(space) + 1, dtype=np.int32)
            origin[len(space) : -1] = np.repeat(np.arange(len(buffer), dtype=np.int32), 1 + (len(space) - 1) * (buffer == 32))
            origin[-1] = len(buffer)
            return space + data.replace(b" ", space), origin
        at, steps = 0, []
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = size, data[at : at + size]
            steps.append((at, found[1]))
            at += found[0]
        return self.assembled(steps, len(data), space)

    def assembled(self, steps: list[tuple[int, bytes]], size: int, space: bytes) -> tuple[bytes, np.ndarray]:
        first = 0
        if self.squeeze:
            while first < len(steps) and steps[first][1] == b" ":
                first += 1
        out, origin = bytearray(), []
        if first == len(steps):
            return b"", np.array([size], dtype=np.int64)
        start = steps[first][0]

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            origin.extend([at] * len(piece))

        if self.prefix and not self.suffix:
            put(space, start)
        after_space = self.squeeze
        for at, piece in steps[first:]:
            if after_space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                if byte == 32:
                    put(space, at)
                else:
                    out.append(byte)
                    origin.append(at)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
        last = size
        if self.squeeze:
            while out.endswith(space):
                last = origin[len(out) - len(space)]
                del out[-len(space) :], origin[-len(space) :]
        if self.prefix and self.suffix:
            put(space, last)
        return bytes(out), np.array([*origin, last], dtype=np.int64)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each piece in the text, by its place in the normalised text."""
        _, origin = self.normalise(text)
        length = self.lengths[np.array(ids, dtype=np.int32)]
        if not self.fallback and self.unknown in ids:
            names = self.library.encode(text, out_type=str)
            length = np.array([len(n.encode()) if i == self.unknown else k for n, i, k in zip(names, ids, length.tolist(), strict=True)], dtype=np.int64)
        ends = np.minimum(np.cumsum(length), len(origin) - 1)
        return origin[ends - np.minimum(length, ends)], origin[ends]


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def read_model(path: str) -> bytes:
    """The model as bytes, to be sent to the executors, which need not have the file."""
    with open(path, "rb") as file:
        return file.read()


def encoded(rows: DataFrame, model: bytes) -> DataFrame:
    """Rows (_row, _text) with ids, their starts and ends; the end id has an empty span at the end of the text.

    Results are given out a few texts at a time, so that a task never holds those of a whole batch.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            first, held, lists = 0, 0, ([], [], [])
            for at, body in enumerate(batch.column(1)):
                text = body.as_py()
                ids = own.ids(text)
                starts, ends = own.spans(text, ids)
                size = len(text.encode("utf-8", "replace"))
                for kept, values, last in zip(lists, (ids, starts, ends), (own.end, size, size), strict=True):
                    kept.append(np.append(np.asarray(values, dtype=np.int32), np.int32(last)))
                held += len(ids)
                if held > HELD_IDS or at == batch.num_rows - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32)
                    columns = [pa.ListArray.from_arrays(offsets, np.concatenate(x)) for x in lists]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at + 1 - first), *columns], ["_row", "ids", "starts", "ends"])
                    first, held, lists = at + 1, 0, ([], [], [])

    schema = T.StructType([rows.schema["_row"], *[T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("ids", "starts", "ends")]])
    return rows.mapInArrow(of_batches, schema)


def digested(text: Column, model: bytes) -> Column:
    """Digests of what ``encoded`` gives and of the decoded text, where the ids themselves are not to be moved."""

    @F.arrow_udf(DIGESTS)
    def of_batch(texts: pa.Array) -> pa.Array:
        own, rows = encoder(model), []
        for body in texts.to_pylist():
            ids = own.ids(body)
            starts, ends = own.spans(body, ids)
            full = [*ids, own.end]
            joined = " ".join(map(own.numbers.__getitem__, full)).encode()
            decoded = own.library.decode(full).encode("utf-8", "replace")
            rows.append(
                {
                    "n_tokens": len(full),
                    "ids_sha256": hashlib.sha256(joined).hexdigest(),
                    "decoded_sha256": hashlib.sha256(decoded).hexdigest(),
                    "n_spanned": int((ends - starts).sum()),
                }
            )
        fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_spanned", pa.int64())]
        return pa.array(rows, pa.struct(fields))

    return of_batch(F.coalesce(text.cast("string"), F.lit("")))


def encode(docs: DataFrame, model: bytes, text: str = "text", digests: bool = False) -> DataFrame:
    """Every row with the ids and byte spans of its whole text, or with their digests.

    Null texts are empty: they have the end id only. Spans are half open, in bytes of the text in UTF-8;
    together they cover it, except what the model's normalisation removes. Equal texts get equal results,
    an empty table gives an empty table, no shuffle is made. Input columns named like a result are replaced.
    """
    names = list(docs.columns)
    fields = ["n_tokens", "ids_sha256", "decoded_sha256", "n_spanned"] if digests else ["ids", "starts", "ends"]
    carried = [name for name in names if name not in fields]
    if not digests:
        body = F.coalesce(docs[text].cast("string"), F.lit(""))
        found = encoded(docs.select(common.packed(docs, carried).alias("_row"), body.alias("_text")), model)
        return found.select(*common.unpacked("_row", carried), *fields)
    rows = docs.select(common.packed(docs, carried).alias("_row"), digested(docs[text], model).alias("_found"))
    return rows.select(*common.unpacked("_row", carried), *[F.col(f"_found.{name}").alias(name) for name in fields])
