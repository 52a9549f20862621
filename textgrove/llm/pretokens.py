"""Pre-tokens: the pieces a byte-level tokenizer merges separately.

The pattern is that of the public tokenizer files (contractions, letters, numbers, other symbols,
white space). Texts below U+0250 take an equal pattern with spelled-out classes, which the standard
``re`` module matches about twice as fast; all others use the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# Letters, numbers and white space below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\\t-\\r \\x85\\xa0"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str = PATTERN) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens, which joined give the text back."""
    # White space by the Unicode property, without the separators U+001C to U+001F.
    space = r"\p{White_Space}"
    full = regex.compile(pattern.replace(r"[^\s", rf"[^{space}").replace(r"\s", space).replace(r"\S", rf"\P{{White_Space}}"))
    if pattern != PATTERN:
        return full.findall
    low = re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d"
        f"| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
        f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    ).findall
    beyond = re.compile("[^\x00-ɏ]").search

    def split(text: str) -> list[str]:
        return full.findall(text) if beyond(text) else low(text)

    return split
