"""Token ids of whole texts, equal to those of the ``tokenizers`` library.

A byte-level BPE vocabulary whose ids follow the order of its merges gives the
same ids in ``tiktoken``, which is about ten times faster on one core; the order
is checked when the file is read.  Texts with the special token's string, or with
characters whose classes the two libraries' Unicode tables may see differently,
go to ``tokenizers`` itself, and so does everything if the order does not hold.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Anything but old Latin letters and general punctuation.
UNUSUAL = re.compile("[^\x00-ʯ‐-‧‰-⁞€]")


def byte_symbols() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte, and that byte.

    Printable Latin-1 bytes stand for themselves, the others for the characters
    from U+0100 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Encodes whole texts to ids, as ``encode(text, add_special_tokens=False)`` of the tokenizer file does."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        added, model = {t["id"]: t["content"] for t in held["added_tokens"]}, held["model"]
        self.special = list(added.values())
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): n for token, n in model["vocab"].items() if token not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Only this splitting is what PATTERN does.
        plain = not held.get("normalizer") and (held.get("pre_tokenizer") or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        ordered = plain and all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        #: Bytes that each id stands for.
        self.n_bytes = np.zeros(max([*ranks.values(), *added]) + 1, np.int64)
        for token, n in ranks.items():
            self.n_bytes[n] = len(token)
        for n, token in added.items():
            self.n_bytes[n] = len(token.encode())

    @property
    def tokenizer(self):
        """The library's own tokenizer, read when the first text needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def ids(self, text: str) -> np.ndarray:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        usual = self.fast is not None and (text.isascii() or not UNUSUAL.search(text))
        if usual and not any(s in text for s in self.special):
            return np.array(self.fast._core_bpe.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    """The tokenizer file of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
