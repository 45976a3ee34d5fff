"""SentencePiece encoding that keeps the way back to the original bytes.

Method. The normaliser is rebuilt from the model file: at each place the longest key of the
compiled character map (a double-array trie with a pool of replacements) is replaced, else one
character is copied, and every byte of the normalised text records the original byte span it
came from. The model's pieces then cut the normalised text, and each piece is projected to the
original byte span by that record. The library's own segmentation gives the ids; the normalised
text that its pieces spell must be ours byte by byte, or the operator raises.

Defined cases. Null and empty texts have the end id only. Invalid rows can't occur (strings are
UTF-8). Rows may repeat. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches

_SPACE = "▁".encode()


class CharMap:
    """The compiled character map: length of the trie in bytes, the trie's units, zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at` and its replacement."""
        found, units = None, self.units
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        node = offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != text[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & ((1 << 31) - 1)
                found = (i + 1 - at, self.pool[start : self.pool.index(b"\0", start)])
        return found


class Encoder:
    def __init__(self, path: str, end_id: int | None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.map, norm = CharMap(spec.normalizer_spec.precompiled_charsmap), spec.normalizer_spec
        if spec.trainer_spec.treat_whitespace_as_suffix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("models that trim or don't escape white space are not handled")
        self.prefix, self.end_id = norm.add_dummy_prefix, self.sp.eos_id() if end_id is None else end_id
        #: Bytes of normalised text that each id spells; 0: unknown.
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type in (1, 4, 5) else b"" for p in spec.pieces]
        self.spelled = np.array([len(s) for s in self.surface])
        self.decimal = [str(i) for i in range(len(self.surface))]

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and of each the start and end of the original bytes it stands for."""
        if not text:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = len(_SPACE) if self.prefix else 0
        if not self.map.units:  # an empty map: only spaces change
            raw = np.frombuffer(text, np.uint8)
            width = np.where(raw == 32, len(_SPACE), 1)
            start = np.repeat(np.arange(len(raw)), width)
            first = (raw & 0xC0) != 0x80
            begin = np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))
            ends = np.append(np.flatnonzero(first)[1:], len(raw))[np.cumsum(first) - 1]
            out, begin, ends = _SPACE * bool(lead) + text.replace(b" ", _SPACE), begin[start], ends[start]
        else:
            parts, at = [_SPACE] * bool(lead), 0
            spans: list[tuple[int, int, int]] = []
            while at < len(text):
                hit = self.map.longest(text, at)
                if hit is None:
                    n = 1
                    while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                        n += 1
                    hit = (n, text[at : at + n])
                put = hit[1].replace(b" ", _SPACE)
                parts.append(put)
                spans.append((at, at + hit[0], len(put)))
                at += hit[0]
            out = b"".join(parts)
            s = np.array(spans, np.int64).reshape(-1, 3)
            begin, ends = np.repeat(s[:, 0], s[:, 2]), np.repeat(s[:, 1], s[:, 2])
        zero = np.zeros(lead, np.int64)
        return out, np.concatenate([zero, begin]), np.concatenate([zero, ends])

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the end id, and of each the original byte span; the end id's is empty, at the end."""
        raw = text.encode()
        return self._project(raw, self.sp.encode(text))

    def _project(self, raw: bytes, ids: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        norm, begin, end = self.normalise(raw)
        if norm != b"".join([self.surface[i] for i in ids]):
            raise ValueError("the pieces don't spell the normalised text")
        to = np.cumsum(self.spelled[ids]) if ids else np.zeros(0, np.int64)
        at = to - self.spelled[ids] if ids else to
        starts, ends = begin[at] if ids else begin[:0], end[to - 1] if ids else end[:0]
        return [*ids, self.end_id], np.append(starts, len(raw)), np.append(ends, len(raw))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def encode_documents(docs: DataFrame, model: str, end_id: int | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for every row of docs(doc_id, text): byte spans of the original text."""
    return _mapped(docs, model, end_id, _full, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def digest_documents(docs: DataFrame, model: str, end_id: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_covered, ids_sha256, decoded_sha256): encode_documents() digested where it is made.

    n_covered: original bytes inside some piece's span.
    """
    return _mapped(docs, model, end_id, _digest, "doc_id long, n_tokens long, n_covered long, ids_sha256 string, decoded_sha256 string")


def _full(e: Encoder, text: str, ids: list[int], starts: np.ndarray, ends: np.ndarray) -> tuple:
    return ids, starts.tolist(), ends.tolist(), e.sp.decode(ids)


def _digest(e: Encoder, text: str, ids: list[int], starts: np.ndarray, ends: np.ndarray) -> tuple:
    covered = int(np.maximum(ends[1:] - np.maximum(starts[1:], ends[:-1]), 0).sum() + ends[0] - starts[0])
    said = " ".join([e.decimal[i] for i in ids]).encode()
    return len(ids), covered, hashlib.sha256(said).hexdigest(), hashlib.sha256(e.sp.decode(ids).encode()).hexdigest()


def _mapped(docs: DataFrame, model: str, end_id: int | None, of, schema: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model, end_id)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [of(e, t, *e._project(t.encode(), ids)) for t, ids in zip(texts, e.sp.encode(texts, num_threads=1), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "n_tokens": pa.int64(), "n_covered": pa.int64()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names[1:], cols, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
