"""Byte-level BPE token ids from a public tokenizer file; the same ids as the ``tokenizers`` library gives, in less time."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies: printable bytes stand for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """``path``: a byte-level BPE file of ``tokenizers`` whose ids follow the order of merges."""

    def __init__(self, path: str | None = None):
        self.path = path or public_tokenizers.path(DEFAULT)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def slow(self) -> Tokenizer:
        """The library's own form, made only if it is needed."""
        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except (ValueError, BaseException) as e:  # its regex engine gives up on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_made: dict[str | None, Bpe] = {}


def bpe(path: str | None = None) -> Bpe:
    """One per process."""
    if path not in _made:
        _made[path] = Bpe(path)
    return _made[path]
