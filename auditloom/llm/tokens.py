"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

Texts are cut before every single space between two non-spaces.  The pre-tokenizer
always ends a piece there, so each unit's ids do not depend on its surroundings:
distinct units are encoded once per worker and texts are put together from them by
array gathers.  Texts with other white space next to such a cut, or with the
vocabulary's special strings, are encoded piece by piece instead.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .runtime import Words, new_key, text_buffer

#: Pattern of the byte-level pre-tokenizer (fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct units that a worker remembers; beyond it the table starts anew.
MOST_UNITS = 400_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_PROBE = "It's 12 o'clock,\n\n  naïve – “quoted” words'll don't  x\ttab 你好 "
_FIRST = np.uint64(0x5851F42D4C957F2D)
_NO_SPACE20 = np.ones(256, dtype=bool)
_NO_SPACE20[32] = False
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = True


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids for batches of texts; one per worker."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)
        self.key = new_key()  # units are told apart by a hash that no text can be made for
        self._clear()

    def _ranks(self, spec: dict):
        """The same vocabulary as merge ranks, if it gives the same ids on a probe text; else None."""
        try:
            import tiktoken
        except ImportError:
            return None
        alphabet, added = _byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
        try:
            ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None
        return fast if fast.encode_ordinary(_PROBE) == self.slow.encode(_PROBE, add_special_tokens=False).ids else None

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.n = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def unit(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        ids = [np.array(self.unit(u), dtype=np.uint32) for u in units]
        n = np.array([len(x) for x in ids], dtype=np.int64)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, *ids])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(a, place, b) for a, b in ((self.keys, keys), (self.at, at), (self.n, n)))

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of each."""
        buf, offsets = text_buffer(column)
        words = Words(buf, offsets, _NO_SPACE20)
        odd = self._odd(buf, offsets, words)
        keys = words.hashes(key=self.key)
        firsts = words.doc[:-1][words.counts > 0]
        keys[firsts] ^= _FIRST
        own = np.repeat(~odd, words.counts)
        keys, starts, ends = keys[own], words.starts[own], words.ends[own]
        if len(self.keys) > MOST_UNITS:
            self._clear()
        distinct, where = np.unique(keys, return_index=True)
        slot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == distinct[inside]
        if not known.all():
            begins = np.isin(starts[where[~known]], offsets[:-1])
            raw = buf.tobytes()
            units = [("" if b else " ") + raw[s:e].decode("utf-8") for b, s, e in zip(begins, starts[where[~known]], ends[where[~known]], strict=True)]
            self._learn(distinct[~known], units)
        slot = np.searchsorted(self.keys, keys)
        n = self.n[slot]
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.at[slot] - before, n) + np.arange(int(n.sum()))]
        counts = np.zeros(len(column), dtype=np.int64)
        doc = np.repeat(np.arange(len(column)), words.counts)[own]
        counts += np.bincount(doc, weights=n, minlength=len(column)).astype(np.int64)
        if odd.any():
            ids, counts = self._with_odd(column, odd, ids, counts)
        return ids, counts

    def _odd(self, buf: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
        """Texts in which a cut would not be safe: other white space at a unit's edge, or special strings."""
        n_docs = len(offsets) - 1
        odd = np.zeros(n_docs, dtype=bool)
        doc = np.repeat(np.arange(n_docs), words.counts)
        if len(doc):
            edge = _EDGE[buf[words.starts]] | _EDGE[buf[words.ends - 1]]
            odd[doc[edge]] = True
            same = doc[1:] == doc[:-1]
            odd[doc[1:][same & (words.starts[1:] != words.ends[:-1] + 1)]] = True
            full = words.counts > 0
            odd[full] |= words.starts[words.doc[:-1][full]] != offsets[:-1][full]
            odd[full] |= words.ends[words.doc[1:][full] - 1] != offsets[1:][full]
        odd |= (words.counts == 0) & (np.diff(offsets) > 0)
        a, b, c = buf[:-2], buf[1:-1], buf[2:]
        wide = ((a == 0xC2) & ((b == 0xA0) | (b == 0x85))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        places = list(np.flatnonzero(wide)) + ([len(buf) - 2] if len(buf) > 1 and buf[-2] == 0xC2 else [])
        if self.special:
            raw = buf.tobytes()
            for s in self.special:
                places += [m.start() for m in re.finditer(re.escape(s.encode()), raw)]
        if places:
            odd[np.searchsorted(offsets, np.array(places), "right") - 1] = True
        return odd

    def _with_odd(self, column: pa.Array, odd: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        parts, at = [], 0
        texts = {i: column[i].as_py() or "" for i in np.flatnonzero(odd)}
        for i in range(len(column)):
            if odd[i]:
                own = [np.array(self.unit(u), dtype=np.uint32) for u in _CUT.split(texts[i])]
                own = np.concatenate(own) if own else np.empty(0, dtype=np.uint32)
                counts[i] = len(own)
                parts.append(own)
            else:
                parts.append(ids[at : at + counts[i]])
                at += counts[i]
        return np.concatenate(parts), counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def default_path() -> str:
    """Vocabulary file of the byte-level BPE that queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
