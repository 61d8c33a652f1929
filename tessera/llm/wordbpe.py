"""Cached encoding with a lower-casing, white-space-dropping word BPE of the `tokenizers` library."""

from __future__ import annotations

import array
import re

#: Entries of a worker's caches before they are emptied.
CACHE_ENTRIES = 400_000


def default_path() -> str:
    """The public vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable, else the next free code point from 256."""
    out, free = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordBpe:
    """Encodes text chunk by white-space chunk, remembering the ids of each chunk.

    The vocabulary's pre-tokenizer never joins characters over white space, so a text's ids are its
    chunks' ids in order.  A chunk of Latin letters with ASCII marks behind it is looked up by its
    lower-case letters and its marks, straight in the library's BPE model; any other chunk goes through
    the library's full encoder, and so does a whole text with control characters on whose class Python
    and the library differ.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
    _odd = re.compile("[\x1c-\x1f]").search

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = special_as_text
        self._chars = _byte_chars()
        self._special = () if special_as_text else tuple(t.content for t in self._tok.get_added_tokens_decoder().values())
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) > CACHE_ENTRIES:
                    self.clear()
                    outer._parts.clear()
                ids = self[chunk] = outer._chunk(chunk)
                return ids

        self._parts: dict[str, bytes] = {}
        self._chunks = Chunks()

    def _whole(self, text: str) -> bytes:
        return array.array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            mapped = part if part.isascii() else "".join(self._chars[b] for b in part.encode())
            ids = self._parts[part] = array.array("I", [t.id for t in self._tok.model.tokenize(mapped)]).tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        m = self._plain(chunk)
        if m is None:
            return self._whole(chunk)
        letters, marks = m.groups()
        if marks and any(s in chunk for s in self._special):
            return self._whole(chunk)
        return self._part(letters.lower()) + (self._part(marks) if marks else b"")

    def encode(self, text: str | None) -> bytes:
        """The ids as native (little-endian) unsigned 32-bit integers."""
        if not text:
            return b""
        if self._odd(text):
            return self._whole(text)
        return b"".join(map(self._chunks.__getitem__, text.split()))


_LOADED: dict[tuple[str, bool], WordBpe] = {}


def load(path: str, special_as_text: bool = False) -> WordBpe:
    """One encoder a worker and path; its cache outlives tasks.

    With special_as_text the special tokens' strings in a text are ordinary text.
    """
    key = (path, special_as_text)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(*key)
    return _LOADED[key]
