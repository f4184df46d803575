"""Token ids of whole texts by a public vocabulary file, with a cache of words.

The vocabulary splits a text into runs of letters, single digits and runs of other signs, and
encodes each run by itself. A run's ids are therefore the same wherever it stands, so a worker asks
the library once for each different run and joins the answers. Texts with anything whose treatment
could depend on the Unicode tables of a library, or with the vocabulary's special tokens, go to the
library whole; so do all texts if the file normalises or splits in any other way.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Texts of these signs only are split here: printable Latin, tab, line feed and carriage return.
#: All of them are stable under NFC and have one-to-one lower-case forms but for U+0130.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
#: The split pattern of the vocabulary file, for lower-cased texts of those signs (fixed values).
_LETTER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
_DIGIT = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_RUNS = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^\t\n\r\x20{_LETTER}{_DIGIT}]+")
_ASCII_RUNS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t\n\r a-z0-9]+")


def _byte_signs() -> dict[int, str]:
    """Byte -> the sign that stands for it in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Run -> its ids as little-endian unsigned 32-bit bytes; emptied when it holds too many."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[run] = self.encode(run)
        return ids


#: What a file's parts are to be for its texts to be split here (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _splits_here(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    return parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _SPLITTER and parts["model"]["type"] == "BPE" and not any(parts.get(k) for k in ("truncation", "padding"))


class Encoder:
    """encode(text): the text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cached_runs: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.signs = self.library.model, _byte_signs()
        self.words = _Words(self._run, cached_runs)
        self.splits = _splits_here(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _by_library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """A run needs no normalising or splitting any more, only its bytes' signs and the model."""
        signs = run if run.isascii() else run.encode().decode("latin-1").translate(self.signs)
        return array("I", [token.id for token in self.model.tokenize(signs)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.splits or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._by_library(text)
        runs = _ASCII_RUNS if text.isascii() else _RUNS
        return b"".join(map(self.words.__getitem__, runs.findall(text.lower())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)
