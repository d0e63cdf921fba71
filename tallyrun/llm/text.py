"""Folding of written text to comparable words: encoding damage, markup, look-alikes, accents and case."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ї": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "г": "r", "п": "n", "ё": "e",
        "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "þ": "th", "ð": "d",
    }
)
#: Invisible characters: soft hyphen, zero-width ones, direction marks, byte order mark.
INVISIBLE = re.compile("[­​-‏⁠-⁤‪-‮﻿]")
#: Runs of the characters that UTF-8 read as a one-byte encoding turns into.
BROKEN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{2,}")
TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,300}>|<!--.*?-->", re.S)
LINE_HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")


def _repair(m: re.Match[str]) -> str:
    try:
        raw = b"".join(c.encode("cp1252") if ord(c) > 255 or not 0x80 <= ord(c) < 0xA0 else c.encode("latin-1") for c in m.group())
        return raw.decode("utf-8")
    except UnicodeError:
        return m.group()


def readable(text: str) -> str:
    """The text without encoding damage, entities, tags, invisible characters and hyphens at line ends."""
    if not text.isascii():
        text = INVISIBLE.sub("", BROKEN.sub(_repair, text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    return LINE_HYPHEN.sub("", text) if "\n" in text else text


def plain(text: str) -> str:
    """Readable text in lower case, without accents and look-alike letters."""
    text = readable(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOK_ALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOK_ALIKES)
    return text.lower()


def words(text: str | None) -> list[str]:
    """The text's words, folded; none for NULL."""
    return WORD.findall(plain(text)) if text else []
