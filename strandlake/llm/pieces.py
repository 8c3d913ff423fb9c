"""SentencePiece encoding with byte spans, and decoding.

The text is normalised here, by the model's compiled character map: a double-array trie over UTF-8
prefixes, of which the longest match at each place is replaced by its string; other valid characters stay,
and a byte that is not UTF-8 becomes U+FFFD.  With every normalised byte goes the source byte it came
from.  The library splits the text into pieces; these, laid end to end, are the normalised bytes, so their
lengths project every piece through the alignment to a [begin, end) span of the original UTF-8 bytes.

Contract: one row per input row, whole texts; a null counts as the empty text, whose ids are just begin and
end.  Repeated rows encode alike.  The begin and end ids have empty spans at the text's ends.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from .store import project

_MARK = "▁".encode()


class CharsMap:
    """The compiled character map: (length of the trie, trie units, zero-ended replacement strings)."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.pool = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units, self.pool = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]
        self._list = self.units.tolist()

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that is a prefix of text[at:]."""
        units, found = self._list, None
        if not units:
            return None
        place = self._offset(units[0])
        for i in range(at, len(text)):
            place ^= text[i]
            unit = units[place]
            if unit & ((1 << 31) | 0xFF) != text[i]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


@dataclass
class Encoding:
    ids: np.ndarray  # uint32, begin and end ids included
    begin: np.ndarray  # int64: first source byte of each piece
    end: np.ndarray


class Tokenizer:
    """A sentencepiece model with an aligned normaliser."""

    def __init__(self, model_file: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = proto.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        self.spec = model.normalizer_spec
        self.map = CharsMap(self.spec.precompiled_charsmap)
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        # Bytes of normalised text that a piece stands for: a byte piece one, a control piece none.
        self.length = np.array([{6: 1, 3: 0}.get(p.type, len(p.piece.encode())) for p in model.pieces], np.int64)
        self.unknown = model.trainer_spec.unk_id
        self.plain = not len(self.map.units) and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces and self.spec.add_dummy_prefix and not self.suffix

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source byte of each of them and of the end)."""
        src = text.encode("utf-8", "surrogatepass")
        if self.plain:
            return self._normalise_plain(src)
        out, where, at = bytearray(), [], 0
        while at < len(src):
            hit = self.map.longest(src, at)
            if hit:
                n, new = hit
            else:
                n = 1 if src[at] < 0x80 else 2 if src[at] < 0xE0 else 3 if src[at] < 0xF0 else 4
                new = src[at : at + n]
            out += new
            where += [at] * len(new) if hit else range(at, at + n)
            at += n
        where.append(len(src))
        return self._spaces(bytes(out), where, len(src))

    def _spaces(self, text: bytes, where: list[int], total: int) -> tuple[bytes, np.ndarray]:
        """Blank handling: strip and squeeze if asked for, add the dummy prefix, escape."""
        squeeze, mark = self.spec.remove_extra_whitespaces, _MARK if self.spec.escape_whitespaces else b" "
        out, at = bytearray(), []
        # The prefix stands at the first byte that stays, the end after the last one.
        head = len(text) - len(text.lstrip(b" ")) if squeeze else 0
        tail = total
        if self.spec.add_dummy_prefix and text[head:] and not self.suffix:
            out, at = bytearray(mark), [where[head]] * len(mark)
        blank = squeeze  # a blank at the start goes
        for b, w in zip(text, where, strict=False):
            if b == 32:
                if not (squeeze and blank):
                    out += mark
                    at += [w] * len(mark)
                blank = True
            else:
                out.append(b)
                at.append(w)
                blank = False
        if squeeze:
            while out.endswith(mark) and len(out) > len(mark):
                tail = at[-len(mark)]
                del out[-len(mark) :], at[-len(mark) :]
        if self.spec.add_dummy_prefix and text and self.suffix:
            out += mark
            at += [tail] * len(mark)
        return bytes(out), np.array([*at, tail], np.int64)

    @staticmethod
    def _normalise_plain(src: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map: only the dummy prefix and escaped blanks."""
        if not src:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(src, np.uint8)
        times = np.where(raw == 32, 3, 1)
        where = np.concatenate((np.zeros(3, np.int64), np.repeat(np.arange(len(raw)), times), [len(raw)]))
        return _MARK + src.replace(b" ", _MARK), where

    def encode(self, texts: list[str | None]) -> Iterator[Encoding]:
        texts = [t or "" for t in texts]
        for text, ids in zip(texts, self.sp.encode(texts, num_threads=1, add_bos=True, add_eos=True), strict=True):
            ids = np.array(ids, np.uint32)
            normal, where = self.normalise(text)
            stops = np.cumsum(self.length[ids])
            if stops[-1] != len(normal):  # an unknown piece stands for what the others leave
                stops = self._with_unknown(ids, len(normal), text)
            begin, end = where[np.concatenate(([0], stops[:-1]))], where[stops]
            begin[0] = end[0] = 0
            begin[-1] = end[-1] = len(text.encode("utf-8", "surrogatepass"))
            yield Encoding(ids, begin, end)

    def _with_unknown(self, ids: np.ndarray, total: int, text: str) -> np.ndarray:
        """Piece ends in normalised bytes from the library's surfaces, for models without byte pieces."""
        size = self.length[ids].copy()
        at = np.flatnonzero(ids == self.unknown)
        pieces = [p for p in self.sp.encode(text, out_type=str)]
        for k in at:
            size[k] = len(pieces[k - 1].encode())
        stops = np.cumsum(size)
        return np.minimum(stops, total)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(model_file: str) -> Tokenizer:
    if model_file not in _LOADED:
        _LOADED[model_file] = Tokenizer(model_file)
    return _LOADED[model_file]


def _groups(batch: pa.RecordBatch, chars: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``chars`` characters, so that few Python objects live at once."""
    for top in range(0, batch.num_rows, 128):
        texts = batch["text"].slice(top, 128).to_pylist()
        lo, held, size = 0, [], 0
        for i, t in enumerate(texts):
            if held and size + len(t or "") > chars:
                yield top + lo, held
                lo, held, size = i, [], 0
            held.append(t)
            size += len(t or "")
        yield top + lo, held


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begin, end): the ids of every row's text and their spans in its UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model_file)
        for batch in batches:
            for lo, part in _groups(batch):
                got = list(tok.encode(part))
                columns = [pa.array([g.ids.astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g.begin for g in got], pa.list_(pa.int64())), pa.array([g.end for g in got], pa.list_(pa.int64()))]
                yield pa.record_batch([batch["doc_id"].slice(lo, len(part)), *columns], ["doc_id", "ids", "begin", "end"])

    return project(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begin array<long>, end array<long>")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the same encodings; ``span_bytes`` sums the spans, the text's bytes if whole, and
    ``spans_sha256`` is the digest of every piece's first and last byte as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model_file)
        for batch in batches:
            for lo, part in _groups(batch):
                n, ids, decoded, span, spans, lists = [], [], [], [], [], []
                for e in tok.encode(part):
                    n.append(len(e.ids))
                    ids.append(hashlib.sha256(e.ids.astype("<u4").tobytes()).hexdigest())
                    span.append(int((e.end - e.begin).sum()))
                    spans.append(hashlib.sha256(np.stack((e.begin, e.end), axis=1).astype("<i8").tobytes()).hexdigest())
                    lists.append(e.ids.tolist())
                for t in tok.decode(lists):
                    decoded.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.record_batch([batch["doc_id"].slice(lo, len(part)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(span, pa.int64()), pa.array(spans)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256"])

    return project(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_sha256 string")
