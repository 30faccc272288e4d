"""Byte-level pre-tokens, cut in two steps so that equal strings are cut only once.

A text is first cut before every space that no white space follows. The byte-level
pattern always starts a new pre-token there (white-space runs give back their last space to
the word after it), so each cut piece can be pre-tokenised by itself, and a piece seen before
needs no second look.
"""

from __future__ import annotations

import re

import regex

#: The white space of the Unicode property, and the byte-level pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|"
    "[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)

_pattern = regex.compile(PATTERN)
_cut = re.compile(" (?=[^" + SPACE + "])")
#: The characters of SPACE.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match("[" + SPACE + "]", c))


def pieces(text: str) -> list[str]:
    """The text's pieces; all but the first stand after a space that is not in them."""
    return _cut.split(text)


def pretokens(piece: str) -> list[str]:
    return _pattern.findall(piece)
