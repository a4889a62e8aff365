"""Words of UTF-8 texts by a translation table of 256 bytes and ``bytes.split``, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: A text is cut into words so many bytes at a time.
PIECE = 1 << 20


def byte_table(separators: bytes) -> bytes:
    """A-Z become a-z, the separators (ASCII) become blanks, all other bytes stay as they are.

    The bytes of a code point beyond ASCII are all 0x80 or more, so none of them is touched.
    """
    return bytes(0x20 if b in separators else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a translated text, in order, in lists of about ``piece`` bytes; at least one list."""
    at = 0
    while len(data) - at > piece:
        to = data.find(b" ", at + piece)
        if to < 0:
            break
        yield data[at:to].split()
        at = to
    yield data[at:].split()
