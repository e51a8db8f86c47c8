"""Code points of many texts at once as arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

PLANE = 1 << 16


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _lower_letters() -> np.ndarray:
    """For each code point of the first plane its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(PLANE, np.uint32)
    for i in range(PLANE):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def lower_letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters of the code points, 0 for what is no letter."""
    out = _lower_letters()[np.minimum(points, PLANE - 1)]
    for p in np.unique(points[points >= PLANE]).tolist():
        low = chr(p).lower()
        out[points == p] = (ord(low) if len(low) == 1 else p) if chr(p).isalpha() else 0
    return out


#: Classes of code points.
LOWER, UPPER, LETTER, DIGIT, SPACE, STOP, COMMA, BANG, BAR, SYMBOL, OTHER = range(11)
CLASSES = 11


@cache
def _classes() -> np.ndarray:
    out = np.full(PLANE, OTHER, np.uint8)
    for i in range(PLANE):
        c = chr(i)
        if c.isspace():
            out[i] = SPACE
        elif c.isdigit():
            out[i] = DIGIT
        elif c.isalpha():
            out[i] = LOWER if c.islower() else UPPER if c.isupper() else LETTER
    for kind, chars in ((STOP, ".?…。"), (COMMA, ",;:'\"-()"), (BANG, "!"), (BAR, "|"), (SYMBOL, "#$%&*@^~=+_<>\\{}[]/`")):
        for c in chars:
            out[ord(c)] = kind
    return out


def classes(points: np.ndarray) -> np.ndarray:
    return _classes()[np.minimum(points, PLANE - 1)]
