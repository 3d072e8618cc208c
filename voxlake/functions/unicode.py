"""Character classes as regular-expression bodies that Java and RE2 read alike.

The larger classes are built from Unicode properties, once, on the driver.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Fixed values that results depend on: the Arabic blocks, the marks that are dropped, the elongation
# character, and the white space that separates tokens.
ARABIC_BLOCKS = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
MARK_RANGES = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED))
TATWEEL = 0x0640
SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)


def body(ranges) -> str:
    """Ranges as the inside of a bracket expression."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _runs(points) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return tuple((a, b) for a, b in out)


def _within(point: int, ranges) -> bool:
    return any(a <= point <= b for a, b in ranges)


@lru_cache(maxsize=1)
def arabic_ranges() -> tuple[tuple[int, int], ...]:
    """Letters of the Arabic blocks, without marks and tatweel."""
    return _runs(
        p for a, b in ARABIC_BLOCKS for p in range(a, b + 1)
        if unicodedata.category(chr(p)).startswith("L") and p != TATWEEL and not _within(p, MARK_RANGES)
    )


@lru_cache(maxsize=1)
def digit_ranges() -> tuple[tuple[int, int], ...]:
    """Digits of every script."""
    return _runs(p for p in range(0x110000) if unicodedata.category(chr(p)) == "Nd")


def arabic_letters() -> str:
    return body(arabic_ranges())


def decimal_digits() -> str:
    return body(digit_ranges())


@lru_cache(maxsize=1)
def letters_and_numbers() -> str:
    """Word characters without the underscore."""
    return body(_runs(p for p in range(0x110000) if unicodedata.category(chr(p))[0] in "LN"))


#: Last code point of the short classes: through the Arabic block.
SHORT_LAST = 0x6FF


@lru_cache(maxsize=1)
def arabic_letters_short() -> str:
    a, b = ARABIC_BLOCKS[0]
    return body(_runs(p for p in range(a, b + 1) if unicodedata.category(chr(p)).startswith("L") and p != TATWEEL and not _within(p, MARK_RANGES)))


@lru_cache(maxsize=1)
def decimal_digits_short() -> str:
    return body(_runs(p for p in range(SHORT_LAST + 1) if unicodedata.category(chr(p)) == "Nd"))


#: Surely stable under NFKC: ASCII, the letters of Latin-1 and the Arabic block's basic letters and digits.
STABLE_RANGES = ((0x00, 0x7F), (0xC0, 0xFF), (0x621, 0x63A), (0x640, 0x64A), (0x660, 0x669))
PERHAPS_UNSTABLE = r"[^\x00-\x7F\x{C0}-\x{FF}\x{621}-\x{63A}\x{640}-\x{64A}\x{660}-\x{669}]"
UNSTABLE_RANGES = tuple((a[1] + 1, b - 1) for a, b in zip(STABLE_RANGES, [r[0] for r in STABLE_RANGES[1:]] + [0x110000], strict=True))

MARKS = body((*MARK_RANGES, (TATWEEL, TATWEEL)))
SPACE = body(SPACE_RANGES)
