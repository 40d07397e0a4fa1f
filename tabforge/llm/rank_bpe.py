"""BPE encoding and decoding of a tokenizers file, merged on contiguous rank arrays.

A word's parts lie between boundaries; beside them stands the rank of each adjacent pair. The
array is scanned for its smallest rank, that boundary is deleted and the ranks on both sides are
looked up again, until no pair has one. Words of more than ``LONG`` parts take a heap with the same
order of merges. Each distinct word is merged once per worker (bounded cache).

Defined results: null text is the empty text, which has no ids; repeated rows each get a row;
special-token strings inside a text get their own id, as in the library; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .token_library import _Cache, byte_letters

LONG = 200
_NONE = 1 << 60


class RankBpe:
    """Encoder and decoder of a word-end BPE file (lower case, white space dropped)."""

    def __init__(self, path: str, cache: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            cfg = json.load(f)
        model = cfg["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if not self.suffix or cfg.get("decoder"):
            raise ValueError("a BPE file with word ends and without a decoder is expected")
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in cfg["added_tokens"]}
        self.tokens = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        #: rank of a pair, and by rank the id it becomes
        self.rank = {pair: r for pair, (r, _) in self.ranks.items()}
        self.made = {r: new for r, new in self.ranks.values()}
        self.letters = byte_letters()
        self.split = regex.compile(cfg["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.space = regex.compile(r"\s+")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = _Cache(self._word, cache)
        self.chunks = _Cache(self._chunk, cache)
        self.packed = _Cache(self._packed, cache)

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > LONG:
            return self._merge_long(ids)
        look, made = self.rank.get, self.made
        ids = list(ids)
        ranks = [look(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = look((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = look((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        look, n = self.ranks.get, len(ids)
        ids, nxt, prev = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := look((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if r := look((new, ids[nxt[i]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[nxt[i]]))
            if prev[i] >= 0 and (r := look((ids[prev[i]], new))):
                heapq.heappush(heap, (r[0], prev[i], r[1], ids[prev[i]], new))
        return [x for x in ids if x != -1]

    def _pair(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.tokens.__getitem__, ids))

    def _word(self, word: str) -> list[int]:
        s = word.encode().decode("latin-1").translate(self.letters)
        parts = [*s[:-1], s[-1] + self.suffix]
        return self.merge([self.vocab[p] for p in parts if p in self.vocab])

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        return self._pair([i for w in self.split(chunk) for i in self.words[w]])

    def _packed(self, chunk: str) -> bytes:
        words = self.split(chunk)
        ids = self.words[words[0]] if len(words) == 1 else [i for w in words for i in self.words[w]]
        return pack(f"<{len(ids)}I", *ids)

    def normalise(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # a capital sigma is lower-cased without regard to its place in the word
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def pairs(self, text: str) -> list[tuple[bytes, str]]:
        """(ids, tokens joined by blanks) of the text's pieces in order."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._plain(text[at : m.start()])
            out.append(self._pair([self.added[m[0]]]))
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        return [self.chunks[c] for c in self.normalise(text).split(" ") if c]

    def encode(self, text: str) -> bytes:
        """The ids of ``pairs`` alone."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._plain_ids(text[at : m.start()])
            out.append(pack("<I", self.added[m[0]]))
            at = m.end()
        return b"".join(out + self._plain_ids(text[at:]))

    def _plain_ids(self, text: str) -> list[bytes]:
        return [self.packed[c] for c in self.normalise(text).split(" ") if c]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def rank_bpe(path: str) -> RankBpe:
    """The worker process's encoder: tasks that follow each other share its bounded caches."""
    return RankBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded, for every whole text."""

    def rows(batches):
        bpe = rank_bpe(path)
        for b in batches:
            ids, decoded = [], []
            for t in b.column(1):
                pairs = [p for p in bpe.pairs(t.as_py() or "") if p[0]]
                ids.append(b"".join(p[0] for p in pairs))
                decoded.append(" ".join(p[1] for p in pairs))
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(rows, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the decoded text is made from the ids."""

    def rows(batches):
        bpe = rank_bpe(path)
        for b in batches:
            n, h, d = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                h.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(rows, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
