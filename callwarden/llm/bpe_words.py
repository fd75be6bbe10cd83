"""Words whose byte-pair encodings do not depend on their neighbours.

A byte-level pre-tokenizer attaches at most one space to what follows it and never looks across
"non-space, one space, non-space".  Text can be cut before such spaces, each piece encoded alone,
and the ids joined, with the same result as for the whole text.

Pieces are named by keys: most are one space and a word, named by the word; any other piece is
named by a NUL and itself.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

NUL = "\x00"
#: How a byte-level vocabulary writes a space.
SPACE_PIECE = "\u0120"
_rare_space = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_cut = re.compile(r"(?<=\S)(?= \S)")
#: A word of ASCII or Latin-1 letters, then marks: the pre-tokenizer cuts between them.
_marked = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)")
_odd = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\n\n", NUL)


def load_tokenizer(path: str):
    """The tokenizer file without truncation and padding; threads belong to Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def surface(key: str) -> str:
    """The text that a key names."""
    return key[1:] if key[:1] == NUL else " " + key


def parts(key: str) -> tuple[str, str] | None:
    """A word and the marks after it, where the key names both together."""
    lead = key[:1] == NUL
    match = _marked.fullmatch(key, 1 if lead else 0)
    return (NUL * lead + match[1], NUL + match[2]) if match else None


class Splitter:
    """Cuts texts into such pieces; literal added tokens become pieces of their own."""

    def __init__(self, tokenizer):
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pattern = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def __call__(self, text: str) -> list[str]:
        """The keys of the pieces of a text, in order."""
        if any(a in text for a in self.added):
            return [k for part in self.pattern.split(text) if part for k in self._plain(part)]
        return self._plain(text) if text else []

    @staticmethod
    def _plain(text: str) -> list[str]:
        if any(o in text for o in _odd) or "\n" in (text[0], text[-1]) or not text.isascii() and _rare_space.search(text):
            return [p[1:] if p[0] == " " and p[1:].isalnum() else NUL + p for p in _cut.split(text)]
        # a line feed between other characters is a piece, and so is what follows it
        keys = text.replace("\n", " \x00\n \x00").split(" ")
        if keys[0]:
            keys[0] = NUL + keys[0]
        else:
            del keys[0]
        return keys


class WordEncoder:
    """Ids, as little-endian 32-bit numbers, of many keys at once.

    Words of letters and digits are encoded in one text; ids whose piece begins with a space begin a word.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.begins = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        added = tokenizer.get_added_tokens_decoder()
        for piece, i in tokenizer.get_vocab().items():
            self.begins[i] = piece[:1] == SPACE_PIECE and i not in added

    def many(self, keys: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(keys)
        plain = [i for i, k in enumerate(keys) if k.isalnum()]
        for at in range(0, len(plain), 2000):
            group = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" " + " ".join([keys[i] for i in group]), add_special_tokens=False).ids, "<u4")
            edges = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
            packed = ids.tobytes()
            for i, a, z in zip(group, edges[:-1], edges[1:], strict=True):
                out[i] = packed[4 * a : 4 * z]
        for i, k in enumerate(keys):
            if not k.isalnum():
                ids = self.tokenizer.encode(surface(k), add_special_tokens=False).ids
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out
