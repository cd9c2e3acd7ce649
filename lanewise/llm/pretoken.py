"""Words of a text as a byte-level BPE vocabulary file codes them, with caches.

A byte-level BPE codes each pre-token on its own, and a pre-token always begins
at a space that precedes something else than white space. So a text is cut at
these spaces, and its ids are those of its words in order: a word is a pre-token
with whatever is written to it without a space. A word is coded once while a
cache holds it.

Words are coded by the ranks of the file's own vocabulary, which is faster than by
its list of merges. Both give the same ids if the merges' results have rising ids
and the file's model gives each result as one id: until the result of a merge is
due, nothing has crossed its ends, so the parts inside are those that it has on its
own, which the merge names. Both conditions are checked when a file is opened.

Texts for which that shortcut isn't exact are given to the tokenizer whole: files
of another kind, texts that hold a special token's string, and texts with code
points that aren't assigned in every Unicode version in use.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

from .common import worker_cache

#: Fixed value: the pre-token pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a cache's generation; two generations are held at most.
GENERATION = 300_000
#: Bytes of a generation's words and values, with what an entry costs.
GENERATION_BYTES = 48 << 20
_ENTRY = 100
#: Longer words (whole texts, where no spaces are written) are coded anew each time.
LONGEST = 128
#: Words of one text that are looked up before the cache's size is checked.
SLICE = 1 << 14

#: Whatever any library in use takes for white space.
_SPACES = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_UNEVEN = re.compile(f" (?:[{_SPACES}]|\\Z)")
_CUT = re.compile(f" (?=[^{_SPACES}])")
_HIGH = re.compile("[\u0558-\U0010ffff]")


@lru_cache(1)
def _unassigned() -> re.Pattern:
    ranges, start = [], None
    for c in range(0x558, sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile("[" + "".join(ranges) + "]")


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}


def words(text: str) -> list[str]:
    """The words of a text; the first is marked by a space, all others follow one."""
    found = _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")
    found[0] = " " + found[0]
    return found


class Vocabulary:
    """One vocabulary file, opened once per worker process."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_rank = ranked_coder(self.tokenizer, spec["model"]) if self.plain else None

    def exact(self, text: str) -> bool:
        """Whether the ids of a text are those of its words."""
        if self.by_rank is None or any(s in text for s in self.special):
            return False
        return text.isascii() or not (_HIGH.search(text) and _unassigned().search(text))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word as :func:`words` gives it."""
        return self.by_rank(word[1:] if word[:1] == " " else " " + word)


def ranked_coder(tokenizer: Tokenizer, model: dict) -> Callable[[str], list[int]] | None:
    """A coder of words by the ranks of a file's vocabulary, if it is exact for the file."""
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    ids, letters = model["vocab"], {c: b for b, c in _byte_letters().items()}
    results = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made = [ids[r] for r in results]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    if any([t.id for t in tokenizer.model.tokenize(r)] != [n] for r, n in zip(results, made, strict=True)):
        return None
    singles = [c for c in letters if c in ids]
    if len(singles) < len(letters):
        return None
    ranks = {bytes(letters[c] for c in t): ids[t] for t in (*singles, *results)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(4)
def opened(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Generation(dict):
    """Values of words; a missing one is taken from the generation before or made."""

    def __init__(self, first: dict, before: dict, make: Callable[[str], object]):
        super().__init__(first)
        self.before, self.make, self.size = before, make, 0

    def __missing__(self, word: str):
        value = self.before.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST:
            self[word] = value
            self.size += sys.getsizeof(word) + sys.getsizeof(value) + _ENTRY
        return value


class Lookup:
    """The value of each word: a first tier that stays, then this worker's own finds.

    A full generation becomes the one before, and what is still in use moves on
    from there; so frequent words survive, and two generations bound the memory, in
    entries and in bytes.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], first: dict | None = None, most: int = GENERATION, most_bytes: int = GENERATION_BYTES):
        self.vocabulary, self.value, self.first, self.most, self.most_bytes = opened(path), value, first or {}, most, most_bytes
        self.held = _Generation(self.first, {}, self._make)

    def _make(self, word: str):
        return self.value(self.vocabulary.word_ids(word))

    def of(self, text: str, join: Callable[[Iterable], object]):
        """``join`` of the values of the text's words, in order."""
        if not self.vocabulary.exact(text):
            return join([self.value(self.vocabulary.ids(text))])
        cut = words(text)
        if len(cut) <= SLICE:
            whole = join(map(self.held.__getitem__, cut))
            self._turn()
            return whole
        parts = []
        for at in range(0, len(cut), SLICE):
            parts.append(join(map(self.held.__getitem__, cut[at : at + SLICE])))
            self._turn()
        return join(parts)

    def _turn(self) -> None:
        if len(self.held) > self.most + len(self.first) or self.held.size > self.most_bytes:
            before = dict(self.held)
            self.held = _Generation(self.first, before, self._make)


def lookup(path: str, kind: str, value: Callable[[list[int]], object], tier: str = "", first: Callable[[], dict] = dict) -> Lookup:
    """This worker process's lookup, kept between tasks; ``tier`` names what ``first`` gives."""
    held = worker_cache(f"tokens {kind}")
    if (path, tier) not in held:
        held.clear()
        held[path, tier] = Lookup(path, value, first())
    return held[path, tier]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()
