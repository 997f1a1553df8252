"""Public tokenizers by the file's path, with bounded caches of what distinct words encode to."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import regex

#: White space as the tokenizers' patterns know it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{SPACE}]+")
#: The byte-level tokenizer's pattern, spelt out for all of Unicode and, with the same pre-tokens, for texts of Latin-1.
_REST = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_PATTERN = _REST.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{S}", SPACE)
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
BYTE_LEVEL = regex.compile(_PATTERN)
LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+".encode("latin-1"))
LATIN_BYTE_LEVEL = re.compile(_REST.replace("{L}", _L).replace("{N}", _N).replace("{S}", _S))
#: Tables over the bytes of Latin-1: lower case with blanks for white space, the letters and the blank, and marks of one kind with numbers of another.
_ALL = bytes(range(256)).decode("latin-1")
_LOWER = re.sub(f"[{_S}]", " ", "".join(c.lower() if re.match(f"[{_L}]", c) else c for c in _ALL)).encode("latin-1")
_LETTERS = re.sub(f"[^{_L} ]", "", _ALL).encode("latin-1")
_KINDS = re.sub(f"[^{_S}{_L}{_N}]", ".", re.sub(f"[{_N}]", "0", _ALL)).encode("latin-1")


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(1)
def _newer():
    """A pattern of the letters and numbers that Python's own tables don't know: the tokenizer may not know them either."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ranges: list[list[int]] = []
    for c in new:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]") if ranges else re.compile("(?!)")


def byte_level_tokens(text: str) -> list[str] | None:
    """Pre-tokens of byte-level BPE; None for a text with letters or numbers so new that the tokenizer has to be asked."""
    if latin(text):
        return LATIN_BYTE_LEVEL.findall(text)
    return None if _newer().search(text) else BYTE_LEVEL.findall(text)


def word_tokens(text: str) -> list[bytes] | list[str]:
    """Pre-tokens of lower-casing word BPE, which drops white space, as bytes of Latin-1; beyond it what lies between white space, as it is, for the library to take apart."""
    try:
        b = text.encode("latin-1").translate(_LOWER)
    except UnicodeEncodeError:
        return WORD.findall(text)
    others = b.translate(None, _LETTERS)
    # where no two marks meet, each stands for itself, as numbers always do; only runs of marks and what an apostrophe cuts off need the pattern
    if others:
        if b"'" in others or b".." in b.translate(_KINDS):
            return LATIN_WORD.findall(b)
        for c in set(others):
            b = b.replace(bytes((c,)), b" %c " % c)
    return b.split()


def _alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level models: a byte that prints is itself, the others follow from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + k) for k, b in enumerate(others)}}


_BYTES = _alphabet()


def as_bytes(token: str) -> str:
    """A pre-token in the alphabet of byte-level models."""
    if token.isascii() and token.isprintable():
        return token.replace(" ", _BYTES[32])
    return token.encode().decode("latin-1").translate(_BYTES)


#: Entries of one generation of a cache, of which two are held, the longest word that is, and marks of words met once.
GENERATION, LONGEST, SEEN = 60_000, 64, 1 << 20
#: Counts are small, so a generation of them is larger and words are held from their first occurrence on.
COUNTS = 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_caches: list[Cache] = []


class Cache(dict):
    """word -> what ``encode`` gives for it, in two generations: the older one is forgotten when the younger is full.

    With ``twice``, a word is held from its second occurrence on (SEEN marks by hash tell of the first), as most are met
    once; else from its first on. Words over ``longest`` code points are encoded each time, so the bytes are bounded as
    the entries are, whatever the texts.
    """

    def __init__(self, encode, size: int = GENERATION, longest: int = LONGEST, twice: bool = True):
        super().__init__()
        self.encode, self.size, self.longest, self.old = encode, size, longest, {}
        self.seen = bytearray(SEEN if twice else 0)
        _caches.append(self)

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.encode(word)
            if len(word) > self.longest:
                return value
            if self.seen:
                at = hash(word) & SEEN - 1
                if not self.seen[at]:
                    self.seen[at] = 1
                    return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
            self.seen = bytearray(len(self.seen))
        self[word] = value
        return value


_loaded: dict[tuple[str, str], tuple] = {}


def load(path: str, kind: str = "ids") -> tuple:
    """(tokenizer, cache) of a .json file, once per process; the cache holds ids as bytes, or counts."""
    if (path, kind) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        pieces, whole = t.model.tokenize, t.encode
        plain = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch

        def ids(word: bytes | str) -> bytes:
            # lower-case letters are a pre-token that nothing normalises; all else goes through the whole tokenizer
            if isinstance(word, bytes):
                if word.isalpha():  # of ASCII, whose letters stand for themselves
                    return id_bytes([x.id for x in pieces(word.decode())])
                word = word.decode("latin-1")
            return id_bytes([x.id for x in pieces(as_bytes(word))] if plain(word) else whole(word, add_special_tokens=False).ids)

        def count(token: str) -> int:
            return len(pieces(as_bytes(token)))

        _loaded[path, kind] = (t, Cache(ids) if kind == "ids" else Cache(count, COUNTS, twice=False))
    return _loaded[path, kind]


def empty() -> bool:
    """Forgets all words; whether there were any."""
    held = any(c or c.old for c in _caches)
    for c in _caches:
        c.clear()
        c.old = {}
    return held


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    a = array("I", ids)
    return a.tobytes()
