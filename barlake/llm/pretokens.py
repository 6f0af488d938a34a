"""Byte-level pre-tokens: cutting whole texts into pieces that a byte-level BPE treats independently."""

from __future__ import annotations

import json
import re

import numpy as np
import regex

# The public pre-token pattern of byte-level BPE vocabularies, and the
# characters with the Unicode White_Space property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

#: A unit is an optional blank and a run without white space, or a white-space run cut as
#: PATTERN cuts it; plain letters before a mark are a unit of their own. No pre-token crosses
#: a unit, so a unit's tokens do not depend on its text.
UNIT = re.compile(f" ?(?:[{LETTERS}]++(?![^.,;:!?{WHITE}])|[^{WHITE}]+)|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A unit that is one pre-token at sight.
PLAIN = re.compile(f" ?[{LETTERS}]+").fullmatch
PRETOKEN = regex.compile(PATTERN)

#: Classes of bytes for :func:`unit_cuts`: ASCII white space, marks, first bytes of wider white space.
_BLANK, _MARK, _WIDE = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[list(b".,;:!?")] = _MARK
_WIDER = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]
_CLASS[[c[0] for c in _WIDER]] = _WIDE
_TWO, _THREE = ([int.from_bytes(c, "big") for c in _WIDER if len(c) == n] for n in (2, 3))
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in UTF-8 texts that stand one behind another, and the end of the last.

    ``starts``: where each text begins, and the end of the last. Units are those of UNIT, but any
    letter before a mark ends one: no pre-token holds both.
    """
    n = len(data)
    kinds = _CLASS[data]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    white, wide = at[kinds == _BLANK], at[kinds == _WIDE]
    size = np.ones(len(white), np.int64)
    if len(wide):
        code = data[wide].astype(np.int64) << 8 | data[np.minimum(wide + 1, n - 1)]
        two, three = np.isin(code, _TWO), np.isin(code << 8 | data[np.minimum(wide + 2, n - 1)], _THREE)
        white = np.concatenate([white, wide[two], wide[three]])
        size = np.repeat([1, 2, 3], [len(size), two.sum(), three.sum()])
        order = np.argsort(white)
        white, size = white[order], size[order]
    stop = white + size
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    cut = edge.copy()
    joined = (white[1:] == stop[:-1]) & ~edge[stop[:-1]]
    cut[white[np.append(True, ~joined)[:len(white)]]] = True        # a run of white space begins
    last = np.append(~joined, True)[:len(white)] & ~edge[stop]      # its last character, before another
    cut[white[last]] = True
    cut[stop[last & (data[white] != 32)]] = True                    # only a blank joins what follows
    marks = at[kinds == _MARK]
    marks = marks[marks > 0]
    before = data[marks - 1]
    latin = (data[marks - 2] == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
    cut[marks[_ASCII_LETTER[before] | latin]] = True
    return np.flatnonzero(cut)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the other bytes from U+0100 upward in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """The vocabulary file, refused unless it is the kind these operators implement."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = (model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
             and spec["normalizer"] is None and not model.get("ignore_merges") and model.get("dropout") is None)
    odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if not plain or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    return spec
