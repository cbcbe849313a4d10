"""Byte-level BPE through a sentencepiece model written directly from a rank file.

The model is a serialised ``ModelProto``: one piece per rank, its bytes mapped to one
printable character each, its score the negative rank, so sentencepiece's merge order is
the rank order; normalisation is the identity.  Each pre-token (match of the split
pattern) is mapped and encoded by itself; decoding maps ids back to their bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows
are encoded each; a very long text is encoded whole; an empty table gives no rows;
columns beside id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from claimlens.llm.common import each_batch, id_text, map_arrow

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
"""Unicode white space, as a class body: the meaning of \\s in the libraries' split patterns."""

CACHE_PIECES = 800_000
"""Pieces remembered by a worker process; a full cache is emptied."""

CACHE_WIDTH = 32
"""Characters from which on a piece is not remembered, which bounds the cache in bytes; it is encoded each time."""


def byte_characters() -> list[str]:
    """One printable character for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: int as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i; the unknown piece follows the last."""
    mapped, unknown = byte_characters(), "▁unknown"
    # Field numbers and enums of sentencepiece_model.proto.
    piece, trainer, normalizer = 1, 2, 3
    piece_text, piece_score, piece_type, type_unknown = 1, 2, 3, 2
    model_type, bpe, vocab_size, unk_id, bos_id, eos_id, pad_id, unk_piece = 3, 2, 4, 40, 41, 42, 43, 45
    name, dummy_prefix, remove_spaces, escape_spaces = 1, 3, 4, 5
    none = (1 << 64) - 1  # -1
    out = []
    for rank, token in enumerate(tokens):
        text = "".join(mapped[b] for b in token).encode()
        out.append(_field(piece, _field(piece_text, text) + _field(piece_score, -float(rank))))
    last = _field(piece_text, unknown.encode()) + _field(piece_score, 0.0) + _field(piece_type, type_unknown)
    out.append(_field(piece, last))
    spec = _field(model_type, bpe) + _field(vocab_size, len(tokens) + 1) + _field(unk_id, len(tokens))
    spec += b"".join(_field(k, none) for k in (bos_id, eos_id, pad_id)) + _field(unk_piece, unknown.encode())
    rules = _field(name, b"identity") + b"".join(_field(k, 0) for k in (dummy_prefix, remove_spaces, escape_spaces))
    return b"".join(out) + _field(trainer, spec) + _field(normalizer, rules)


class Pieces(dict):
    """Ids, as little-endian 32-bit bytes, of pieces of text that no token crosses.

    A piece is a run without white space and one blank before it, or a run of white
    space; every split pattern of the byte-level family breaks there.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        # white space of each kind, with a blank after or before it
        self.near = [(c, f"{c} ", f" {c}") for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c)]
        self.split = regex.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.inner = regex.compile(f"[{WHITE}]")

    def __missing__(self, piece: str) -> bytes:
        words = piece.split()  # at least at all white space of the patterns
        plain = len(words) == 1 and len(piece) - len(words[0]) == (piece[0] == " ")
        if not plain and self.inner.search(piece, 1) and len(parts := self.split.findall(piece)) > 1:
            return b"".join(map(self.__getitem__, parts))
        ids = self.encode(piece)
        if len(piece) < CACHE_WIDTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or any(c in text and (a in text or b in text) for c, a, b in self.near):
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        # single blanks only: each belongs to the word after it
        first, *rest = text.split(" ")
        return b"".join([self[first], *map(self.__getitem__, map(" ".__add__, rest))])


def piece_encoder(pattern: str, encode: Callable[[str], list[int]], kind: type[Pieces] = Pieces) -> Pieces:
    """Pieces split into pre-tokens by ``pattern``; ``encode`` has the ids of a byte-mapped pre-token."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    split = regex.compile(pattern)
    to_char = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
    known: dict[str, bytes] = {}

    def one(pre_token: str) -> bytes:
        ids = known.get(pre_token)
        if ids is None:
            ids = array("I", encode(pre_token.encode().decode("latin-1").translate(to_char))).tobytes()
            if len(pre_token) < CACHE_WIDTH:
                if len(known) >= CACHE_PIECES // 2:
                    known.clear()
                known[pre_token] = ids
        return ids

    def piece(text: str) -> bytes:
        found = split.findall(text)
        return one(text) if len(found) == 1 else b"".join(map(one, found))

    return kind(piece)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> tuple[Pieces, list[bytes]]:
    """The encoder, and the bytes of every id; once per worker process."""
    import sentencepiece

    rank = ranks(path)
    tokens = sorted(rank, key=rank.__getitem__)
    if [rank[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
    return piece_encoder(pattern, model.encode), tokens


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _run(path: str, pattern: str, digest: bool):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens = codec(path, pattern)
        for batch in each_batch(batches):
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = [pieces.text(t or "") for t in part.column("text").to_pylist()]
                back = [decode(i, tokens) for i in ids]
                columns = [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if digest:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in (ids, back)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    lists = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
                    columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


def encode_decode(
    docs: DataFrame, path: str, pattern: str, digest: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, and ids with the decoded bytes, or (``digest``) the SHA-256 of both.

    ``path`` must exist on every worker.
    """
    more = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return map_arrow(id_text(docs, doc_id, text), _run(path, pattern, digest), f"doc_id long, n_tokens long, {more}")
