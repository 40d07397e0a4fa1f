"""Token ids of the tokenizers library, with each distinct word encoded once per worker.

``TextEncoder.encode`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``. For plain
texts (printable ASCII, Latin letters, blanks and line ends; no special-token strings) the text is
cut where the library's own pre-tokenizer cuts, and only words not met before go through the
library's model. Any other text is encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np

_OTHER = re.compile("[^\x20-\x7e\n¡-ɏ]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space of two or more characters belongs to other chunks than a single blank.
_PAIRS = ("  ", "\n\n", " \n", "\n ")


class _Cache(dict):
    """Values by key, made when first asked for. When ``most`` are held they become the older half,
    from which those still in use come back; the rest go with the next change."""

    def __init__(self, make, most):
        super().__init__()
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: byte value (as a code point) to the character that stands for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TextEncoder:
    """``encode`` returns the ids as little-endian 32-bit numbers."""

    def __init__(self, path: str, cache: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            cfg = json.load(f)
        self.special = [t["content"] for t in cfg["added_tokens"]]
        self.by_word = bool(cfg["model"].get("end_of_word_suffix"))  # lower-cased words, white space dropped
        pattern = cfg["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.by_word else public_tokenizers.PATTERN
        self.split = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.model = self.tok.model
        self.ids, self.after = _Cache(self._ids, cache if self.by_word else cache // 6), _Cache(self._after, cache // 6 * 5)

    def _word(self, word: str) -> bytes:
        if word.isascii() and "\n" not in word:  # its bytes stand for themselves, but for the blank
            mapped = word.replace(" ", self.letters[32])
        else:
            mapped = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return pack(f"<{len(ids)}I", *ids)

    def _ids(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # one piece by either pattern
            return self._word(chunk)
        pieces = self.split(chunk)
        if len(pieces) == 1:
            return self._word(chunk)
        return b"".join([self.after[p[1:]] if p[0] == " " and len(p) > 1 and not self.by_word else self.ids[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # the only white space of a plain text is the blank and the line end
        if self.by_word:
            return b"".join(map(self.ids.__getitem__, text.lower().split()))
        if not text or text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS):
            return b"".join(map(self.ids.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.ids[first] + b"".join(map(self.after.__getitem__, rest))

    def _after(self, chunk: str) -> bytes:
        """Ids of a chunk that follows a line end (its first character) or else a blank."""
        return self._ids(chunk if chunk[0] == "\n" else " " + chunk)

    def encode_batch(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after the other, each followed by ``end``, and the
        number of ids of each text."""
        tail = pack("<I", end)
        coded = [self.encode(t.as_py() or "") + tail for t in texts]
        return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """The worker process's encoder: tasks that follow each other share its bounded caches."""
    return TextEncoder(path)
