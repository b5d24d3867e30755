"""Encoding with the tokenizers library, with a bounded memo of what single pretokens encode to."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Entries of the memo; each takes some 200 bytes. A full memo is emptied and filled again.
MEMO = 300_000

# Characters whose class (letter, number, other) all Unicode versions agree on, and
# that neither NFC nor lower case joins to their neighbours.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t\n\r "
OTHERS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷–—‘’“”…"
PLAIN = re.compile(f"[{LETTERS}{NUMBERS}{SPACES}{OTHERS}]*")
#: Pretokens of the two public pre-tokenizers, over plain characters only.
BYTE_LEVEL = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_LEVEL = re.compile(f"'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others get the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        found = self[pretoken] = self.encode(pretoken)
        return found


class Encoder:
    """Ids of whole texts, as little-endian bytes of ``width`` bytes an id.

    Texts of plain characters are cut at the vocabulary's own pretoken borders and each distinct
    pretoken is encoded once by the library's model; any other text, or another pre-tokenizer,
    goes to the library whole. Added tokens in a text get their own ids, as the library's default
    is: texts that hold one's content in any case go to the library whole.
    """

    def __init__(self, path: str, extra_id: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, extra_id) < 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps(spec.get("pre_tokenizer") or {})
        self.pattern, fold = None, None
        if not spec.get("normalizer") and '"ByteLevel"' in steps and '"Split"' not in steps:
            self.pattern, fold = BYTE_LEVEL, str
        elif "Lowercase" in json.dumps(spec.get("normalizer")) and '"Split"' in steps and "[\\\\p{N}]|" in steps:
            self.pattern, fold = WORD_LEVEL, str.lower
        alphabet, model = byte_alphabet(), self.tokenizer.model

        def one(pretoken: str) -> bytes:
            return self.pack([t.id for t in model.tokenize(fold(pretoken).encode().decode("latin-1").translate(alphabet))])

        self.memo = _Memo(one)

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        low = text.lower()
        if self.pattern and PLAIN.fullmatch(text) and not any(c in low for c in self.added):
            return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
