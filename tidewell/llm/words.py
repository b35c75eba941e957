"""Words of a text, robust to layout, case, accents, ligatures and invisible characters."""

from __future__ import annotations

import re
import unicodedata

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(rb"(?<=[a-z])-[ \t]*\r?\n[ \t]*(?=[a-z])")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower-case letters, digits and blanks; accents, invisible characters and line-end hyphens are gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).replace("–", " ").replace("—", " "))
    raw = text.encode("ascii", "ignore").translate(_LOWER)
    if b"-\n" in raw or b"-\r" in raw or b"- " in raw:
        raw = _BROKEN.sub(b"", raw)
    return raw.replace(b"%", b" percent ").translate(_SPACED)


def words(text: str | None) -> list[bytes]:
    return folded(text).split() if text else []
