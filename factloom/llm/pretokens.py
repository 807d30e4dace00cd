"""Token ids of whole texts under the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import regex

#: Fixed value: how the vocabulary splits a text into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: Characters on whose classes all libraries agree; a text with any other is left to the reference tokenizer library.
PLAIN = regex.compile(r"[^\x09-\x0D\x20-\x7E¡-ǿЀ-џ‐-‧‰-›€]")
SPLIT = regex.compile(PATTERN)
#: How far past its end what decides a pre-token can lie: the rest of a contraction, or the end of a run of white space.
LOOK = 3
#: Characters that are split at once by the reference library: first, and at most.
STRETCH, LONGEST = 512, 1 << 16


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    ``path`` is the vocabulary for the library that defines the ids; ``ranks_path`` the same vocabulary for a faster library,
    used for texts of characters that both split alike.
    """

    def __init__(self, path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cuts(self, text: str, at: int = 0) -> Iterator[tuple[str, int]]:
        """Each pre-token from the boundary ``at`` on, and where it ends, as the library that defines the ids splits the text (without SPECIAL);
        a stretch at a time, leaving out what more text could change."""
        split, size = self.tokenizer.pre_tokenizer.pre_tokenize_str, STRETCH
        while at < len(text):
            stop = min(at + size, len(text))
            begin = at
            for _, (a, b) in split(text[begin:stop]):
                if begin + b + LOOK > stop and stop < len(text):
                    break
                at = begin + b
                yield text[begin + a : at], at
            size = 2 * size if at == begin else min(2 * size, LONGEST)

    def plain(self, text: str) -> bool:
        return not PLAIN.search(text) and SPECIAL not in text

    def ids(self, text: str) -> bytes:
        if self.plain(text):
            return bytes(self.core.encode_to_tiktoken_buffer(text, set()))
        ids = self.slow(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, ranks_path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]
