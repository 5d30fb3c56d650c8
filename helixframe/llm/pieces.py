"""A SentencePiece vocabulary as plain arrays, read from a public model file."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: A piece with this score or less is never used to build a text.
UNUSED = -1e8


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; 32 and 64 bit values as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """texts: of the pieces that build texts, with their ids and scores; bytes_: the id of each byte piece."""

    kind: int
    texts: list[str]
    ids: np.ndarray
    scores: np.ndarray
    bytes_: list[int]
    unknown: int
    end: int
    size: int
    surface: list[bytes] = field(repr=False)

    @property
    def inner_space(self) -> bool:
        """Whether some piece has a space after another character, so that words can't be encoded one by one."""
        return any(SPACE in t.lstrip(SPACE) for t in self.texts)


def load_pieces(model_file: str = DEFAULT_MODEL) -> Pieces:
    """The vocabulary file is part of the installation and is read on the driver. Only models that leave texts
    as they are (identity normalization, a dummy space in front) are taken."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind, identity, prefix, squeeze = UNIGRAM, False, True, True
    for number, value in _fields(sp.serialized_model_proto()):
        if number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            identity, prefix, squeeze = spec.get(1) == b"identity", spec.get(3, 1) == 1, spec.get(4, 1) == 1
    if kind not in (UNIGRAM, BPE) or not identity or not prefix or squeeze:
        raise ValueError(f"{model_file}: only unigram or BPE models without normalization are read")
    n = sp.get_piece_size()
    ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    surface = [b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
    surface[sp.unk_id()] = " ⁇ ".encode()
    with_bytes = sp.is_byte(byte_ids[0])
    for b, i in enumerate(byte_ids):
        if with_bytes:
            surface[i] = bytes([b])
    texts = [sp.id_to_piece(i) for i in ids]
    return Pieces(kind, texts, np.array(ids, np.int32), np.array([sp.get_score(i) for i in ids]), byte_ids if with_bytes else [], sp.unk_id(), sp.eos_id(), n, surface)
