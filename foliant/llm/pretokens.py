"""Pre-tokens of the two tokenizer files used here, by a fast pattern where it provably agrees with the library."""

from __future__ import annotations

import os
import re
from functools import cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters and numerals of the characters up to U+024F (Unicode categories L and N).
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
NUMERALS = "0-9²³¹¼-¾"
#: Characters whose class, case and normal form are settled; a text with any other goes to the library.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ]")

BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMERALS}]+| ?[^\s{LETTERS}{NUMERALS}]+|\s+(?!\S)|\s+")
WORD_END_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMERALS}]|[^\s{LETTERS}{NUMERALS}]+")


def usual(text: str) -> bool:
    return _UNUSUAL.search(text) is None


@cache
def tokenizer(name: str):
    """The library's tokenizer of a file in the tokenizer folder, without truncation or padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path(name) if os.sep not in name else name)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def special_strings(name: str) -> tuple[str, ...]:
    """The strings that the library takes out of a text before it cuts pre-tokens."""
    return tuple(t.content for t in tokenizer(name).get_added_tokens_decoder().values())


@cache
def _special_pattern(name: str) -> re.Pattern | None:
    found = special_strings(name)
    return re.compile("|".join(map(re.escape, found))) if found else None


def byte_pretokens(text: str, name: str) -> tuple[list[str], int]:
    """The pre-tokens of a text for a byte-level file, and the number of special strings, each one token."""
    special = _special_pattern(name)
    parts = special.split(text) if special and special.search(text) else [text]
    out: list[str] = []
    for part in parts:
        if usual(part):
            out += BYTE_PATTERN.findall(part)
        else:
            out += [part[a:b] for _, (a, b) in tokenizer(name).pre_tokenizer.pre_tokenize_str(part)]
    return out, len(parts) - 1
