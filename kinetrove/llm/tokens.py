"""Whole texts to token ids: what the tokenizer makes of each word is remembered.

A byte-level vocabulary encodes every piece of its pre-tokeniser's split by itself, so the ids of a text are those
of its pieces, one after another. A piece that is not remembered yet goes to the library's BPE model alone, with its
bytes written as the characters that stand for them. Whole texts go through the library's whole pipeline where a special
token's string occurs, and always if the file asks for another split, a normalizer or another model. ``tests/llm``
holds the result against the library on whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

from kinetrove.llm.common import Memory

#: Fixed value: the split of the public byte-level vocabularies, and what it comes to for ASCII texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Pieces in each of the two generations that a worker remembers, and the longest one: they bound its memory.
REMEMBERED, LONGEST = 400_000, 32

#: Fixed value: in byte-level vocabularies these bytes stand for themselves, the others for characters from 256 on.
PLAIN = (*range(33, 127), *range(161, 173), *range(174, 256))
LETTERS = {b: chr(b) for b in PLAIN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PLAIN)}

_encoders: dict[str, Encoder] = {}


def splits_alone(settings: dict) -> bool:
    """Whether a tokenizer file asks for nothing but the usual byte-level split before a plain BPE model."""
    model, split = settings["model"], settings["pre_tokenizer"] or {}
    return (
        not settings["normalizer"] and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in settings["added_tokens"])
    )


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = splits_alone(json.loads(self.tokenizer.to_str()))
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = regex.compile(PIECES).findall
        self.remembered = Memory(self.piece, REMEMBERED, LONGEST).__getitem__

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """One piece of the split."""
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", LETTERS[32])
        else:
            letters = piece.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self.whole(text)
        for special in self.special:
            if special in text:
                return self.whole(text)
        pieces = ASCII_PIECES.findall(text) if text.isascii() else self.pieces(text)
        return b"".join(map(self.remembered, pieces))


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
