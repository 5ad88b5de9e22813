"""SentencePiece encoding with original byte spans, and decoding.

1. Normalisation. The model's compiled character map is a double-array trie
   over UTF-8 bytes; at each position its longest matching prefix is
   replaced, else one character is copied. White-space rules of the model
   (dummy prefix, extra spaces, escaping) follow. Beside the normalised
   bytes goes the original byte offset of each.
2. Segmentation. The sentencepiece library, with its own normaliser set to
   the identity, merges the normalised text into pieces.
3. Projection. Each piece's normalised bytes are mapped back, which gives
   its half-open span of original bytes. Spans ascend and cover the text
   but for what normalisation dropped.

Ids equal the library's ``encode``. Defined results: a null text is the
empty text, which has no ids; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small_batches

MARK = "▁"


class CharacterMap:
    """The compiled map: a trie over bytes whose values point into a blob of replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at ``at``."""
        if not self.units:
            return None
        found, node, unit = None, 0, self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[value:self.texts.index(b"\0", value)])
        return found


class Encoder:
    """Encodes by a model file; ``model`` is its bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        byte = pb.ModelProto.SentencePiece.BYTE
        self.sizes = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.UNKNOWN), -1)
        self.plain = not self.map.units and self.dummy and not self.trim and self.escape and not self.suffix
        spec.precompiled_charsmap, spec.add_dummy_prefix = b"", False
        spec.remove_extra_whitespaces, spec.escape_whitespaces = False, False
        self.library = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.decoder = SentencePieceProcessor(model_proto=model)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, per byte of it and for its end, the original byte offset."""
        data, out, source = text.encode(), bytearray(), []
        mark = MARK.encode() if self.escape else b" "
        at, parts = 0, []
        while at < len(data):
            hit = self.map.prefix(data, at)
            if hit is None:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = (n, data[at:at + n])
            parts.append((at, hit[1]))
            at += hit[0]
        if self.trim:
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)

        def add(piece: bytes, origin: int) -> None:
            out.extend(piece)
            source.extend([origin] * len(piece))

        if parts and self.dummy and not self.suffix:
            add(mark, parts[0][0])
        spaced = self.trim
        for origin, piece in parts:
            if self.trim and spaced:
                piece = piece.lstrip(b" ")
            for i in range(len(piece)):
                add(mark if piece[i] == 0x20 else piece[i:i + 1], origin)
            if piece:
                spaced = piece.endswith(b" ")
        end = len(data)
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark):]
                end = source[len(out)]
                del source[len(out):]
        if parts and self.dummy and self.suffix:
            add(mark, end)
        return out.decode(), np.array([*source, end], np.int64)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """``normalise`` where the map has no rule and a dummy prefix is all that is added."""
        normal = MARK + text.replace(" ", MARK)
        data = np.frombuffer(normal.encode(), np.uint8)
        step = np.ones(len(data), np.int64)
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        step[marks] = step[marks + 1] = 0  # three bytes for one
        step[2] = 0  # and for none
        return normal, np.concatenate(([0], np.cumsum(step)))

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Per text its ids, and the begin and end of each piece in bytes of the original text."""
        normal = [self._plain(t) if self.plain and t and MARK not in t else self.normalise(t) for t in texts]
        out = []
        for (text, source), ids in zip(normal, self.library.encode([n[0] for n in normal], num_threads=1)):
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if self.unknown in ids:  # an unknown piece is as long as its text
                sizes = np.array([len(p.encode()) if i == self.unknown else self.sizes[i]
                                  for i, p in zip(ids, self.library.encode(text, out_type=str))], np.int64)
            ends = np.cumsum(sizes)
            out.append((ids, source[ends - sizes], source[ends]))
        return out

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            rest, at = batch.drop_columns(["_text"]), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1 << 20):
                    size += len(texts[to] or "")
                    to += 1
                found = e.encode_all([t or "" for t in texts[at:to]])
                stops = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([np.asarray(f[k], np.int32) for f in found]), pa.int32()))
                         for k in range(3)]
                decoded = pa.array(e.decoder.decode([f[0] for f in found], num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays([*rest.slice(at, to - at).columns, *lists, decoded],
                                                 names=[*rest.schema.names, "ids", "begins", "ends", "decoded"])
                at = to
    return run


def encode(docs: DataFrame, path: str, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The ``keep`` columns with ids, begins, ends (original byte spans) and the text decoded from the ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], F.col(text).alias("_text"))
    types = "".join(f"`{n}` {t}, " for n, t in rows.drop("_text").dtypes)
    return rows.mapInArrow(_encoded(path), types + "ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the number of original bytes that the spans cover."""
    out = encode(docs, path, text, {"doc_id": F.col(doc_id)})
    covered = F.when(F.size("ends") > 0, F.element_at("ends", -1) - F.element_at("begins", 1)).otherwise(0)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), covered.cast("long").alias("covered_bytes"))
