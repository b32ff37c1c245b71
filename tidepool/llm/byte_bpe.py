"""Byte-level BPE vocabularies: loading, pre-token splitting, and a piece cache.

The vocabulary file is a parameter: its path must exist on every executor
(an installed package, or shipped with ``spark.files``).  Loading happens once
per Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import regex

# Character classes of the split pattern below U+0250, where almost all Latin
# text lives: the standard ``re`` module is twice as fast as ``regex``.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(letters: str, numbers: str, space: str) -> str:
    # The public split pattern of the byte-level vocabularies; its letter branch
    # goes first, which changes nothing (no contraction starts with a letter).
    return (f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")


_LATIN = re.compile(_pattern(_L, _N, _S))
_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}", _SPACE))
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteBpe:
    """A byte-level BPE vocabulary.

    ``pair_rank``: (left id, right id) -> rank of the merge; ``merged[rank]``: the
    id it makes; ``byte_id[b]``: the id of a single byte; ``token_bytes[id]``.
    """

    pair_rank: dict[tuple[int, int], int]
    merged: list[int]
    byte_id: list[int]
    token_bytes: list[bytes]
    specials: dict[str, int]
    #: ids below this are ordinary tokens, made of bytes by merges.
    ordinary: int

    @cached_property
    def _special_split(self):
        if not self.specials:
            return None
        longest_first = sorted(self.specials, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text in order.  A special string stands as a piece of
        its own (no ordinary piece can equal it: pieces never mix punctuation
        and letters)."""
        find = (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall
        if self._special_split is None or not any(s in text for s in self.specials):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(self._special_split.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out.extend(find(part))
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load_byte_bpe(path: str) -> ByteBpe:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *specials.values()]) + 1
    token_bytes = [b""] * size
    for token, i in vocab.items():
        token_bytes[i] = bytes(symbols[c] for c in token)
    for token, i in specials.items():
        token_bytes[i] = token.encode()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    made = {c: -1 for c in symbols}
    for rank, (a, b) in enumerate(merges):
        # Each part exists before the merge that uses it.  Merging all places of
        # the lowest rank at once is then the same as merging one by one.
        if made.get(a, rank) >= rank or made.get(b, rank) >= rank:
            raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
        made.setdefault(a + b, rank)
    return ByteBpe(
        pair_rank={(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)},
        merged=[vocab[a + b] for a, b in merges],
        byte_id=[vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])],
        token_bytes=token_bytes, specials=specials, ordinary=len(vocab))


class PieceCache(dict):
    """piece -> value, filled by ``make`` on a miss and bounded: when ``limit``
    new pieces are held they become the old generation and the previous old one
    goes, so frequent pieces stay."""

    def __init__(self, make: Callable[[str], object], limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) < 100:  # long pieces hardly repeat
            self[piece] = value
        return value
