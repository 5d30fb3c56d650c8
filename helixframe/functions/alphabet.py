"""Alphabets: which characters mean the same symbol, their order and their complements, as column expressions.

Texts are kept as strings of canonical characters, never as code arrays, so Spark's own string
functions do all the work. A symbol's code is its place in the alphabet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between sequences; sorts before every symbol.
SEPARATOR = "$"


@dataclass(frozen=True)
class Alphabet:
    """groups: for each symbol its characters, the canonical one first. complements: pairs "AT" (A becomes T), one way each.

    Characters of no group become the symbol `default`. A symbol without a complement is its own.
    """

    groups: tuple[str, ...]
    complements: tuple[str, ...] = ()
    default: int = 0
    unknown: str | None = None
    _map: dict[str, int] = field(init=False, repr=False, compare=False, hash=False, default_factory=dict)

    def __post_init__(self) -> None:
        if not 2 <= len(self.groups) < 255:
            raise ValueError("an alphabet has 2 to 254 symbols")
        if any(not g for g in self.groups):
            raise ValueError("a symbol needs a character")
        letters = "".join(self.groups)
        if len(set(letters)) != len(letters):
            raise ValueError("a character stands for two symbols")
        if SEPARATOR in letters:
            raise ValueError(f"{SEPARATOR} separates sequences")
        if not 0 <= self.default < len(self.groups):
            raise ValueError("the default is no symbol")
        for pair in self.complements:
            if len(pair) != 2 or any(c not in self.canonical for c in pair):
                raise ValueError(f"a complement is two canonical characters, not {pair!r}")
        if self.unknown is not None and self.unknown not in self.canonical:
            raise ValueError("the unknown symbol is not canonical")
        self._map.update({c: i for i, g in enumerate(self.groups) for c in g})

    @property
    def canonical(self) -> str:
        return "".join(g[0] for g in self.groups)

    @property
    def size(self) -> int:
        return len(self.groups)

    def code(self, character: str) -> int:
        return self._map.get(character, self.default)

    def character(self, code: int) -> str:
        if not 0 <= code < self.size:
            raise ValueError(f"no symbol has the code {code}")
        return self.canonical[code]

    def complement(self, code: int) -> int:
        return self.canonical.index(dict(map(tuple, self.complements)).get(self.character(code), self.character(code)))

    def is_canonical(self, character: str) -> bool:
        return character in self.canonical

    # columns

    def encode(self, text: Column | str) -> Column:
        """The text in canonical characters. translate() keeps lengths, which upper() doesn't.

        One pass settles the characters of ASCII and Latin-1; the expression after it finds the rest, mostly nothing.
        """
        text = F.col(text) if isinstance(text, str) else text
        default = self.canonical[self.default]
        pairs = [(c, g[0]) for g in self.groups for c in g[1:]]
        pairs += [(chr(i), default) for i in range(1, 256) if chr(i) not in self._map]
        text = F.translate(text, *("".join(x) for x in zip(*pairs)))
        allowed = "".join(re.escape(c) for c in self.canonical)
        return F.regexp_replace(text, f"(?s)[^{allowed}]", re.sub(r"([\\$])", r"\\\1", default))

    def only_known(self, text: Column | str) -> Column:
        """The text without characters of no group or of the unknown symbol."""
        text = F.col(text) if isinstance(text, str) else text
        kept = [g for g in self.groups if g[0] != self.unknown]
        letters = "".join(c for g in kept for c in g)
        variants = [(c, g[0]) for g in kept for c in g[1:]]
        text = F.regexp_replace(text, "(?s)[^" + re.escape(letters) + "]+", "")  # a run at once, before what looks up each character
        if variants and all(c.isascii() and c.upper() == g[0] for g in kept for c in g):
            return F.upper(text)  # of ASCII it looks at bytes; translate() makes an object of each character
        return F.translate(text, *("".join(x) for x in zip(*variants))) if variants else text

    def has_known(self, text: Column | str) -> Column:
        """Whether only_known leaves anything; it stops at the first such character, so filters need not make the text."""
        text = F.col(text) if isinstance(text, str) else text
        letters = "".join(c for g in self.groups if g[0] != self.unknown for c in g)
        return F.rlike(text, F.lit(f"[{re.escape(letters)}]"))

    def codes(self, text: Column | str) -> Column:
        """The codes of an encoded text, an array."""
        text = F.col(text) if isinstance(text, str) else text
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), self.code_of)

    def code_of(self, character: Column | str) -> Column:
        """The code of one canonical character."""
        character = F.col(character) if isinstance(character, str) else character
        return F.position(character, F.lit(self.canonical)) - 1

    def character_of(self, code: Column | str) -> Column:
        """The canonical character of a code; null outside the alphabet."""
        code = F.col(code) if isinstance(code, str) else code
        return F.when((code >= 0) & (code < self.size), F.substring(F.lit(self.canonical), code + 1, F.lit(1)))

    def complemented(self, text: Column | str) -> Column:
        """Each symbol of an encoded text as its complement."""
        text = F.col(text) if isinstance(text, str) else text
        return F.translate(text, "".join(p[0] for p in self.complements), "".join(p[1] for p in self.complements)) if self.complements else text

    def reverse_complement(self, text: Column | str) -> Column:
        return F.reverse(self.complemented(text))

    def canonical_flag(self, character: Column | str) -> Column:
        """1 if the character is the first of its symbol."""
        character = F.col(character) if isinstance(character, str) else character
        return (F.position(character, F.lit(self.canonical)) > 0).cast("int")

    def sort_key(self, text: Column | str) -> Column:
        """A text whose binary order is the alphabet's: the separator first, then symbols by code."""
        text = F.col(text) if isinstance(text, str) else text
        return F.translate(text, self.canonical, "".join(chr(0x41 + i) for i in range(self.size)))

    def from_sort_key(self, key: Column | str) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        return F.translate(key, "".join(chr(0x41 + i) for i in range(self.size)), self.canonical)


DNA = Alphabet(("Aa", "Cc", "Gg", "Tt", "Nn"), ("AT", "TA", "CG", "GC"), 4, "N")
