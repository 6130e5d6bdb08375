"""Terms of texts as UTF-8 bytes: runs of letters (or letters and digits) and of anything outside ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20


def table(digits: bool) -> bytes:
    """For ``bytes.translate``: what is no part of a term becomes a space; ``digits`` tells whether 0-9 are part of one."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    out[97:123] = out[65:91] = bytes(range(97, 123))
    if digits:
        out[48:58] = bytes(range(48, 58))
    return bytes(out)


def words(text: bytes | None, by: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in lists, one for about ``PIECE`` bytes; no term is cut, null has none."""
    at = 0
    text = text or b""
    while at < len(text):
        piece = text[at : at + PIECE].translate(by)
        at += len(piece)
        if at < len(text) and piece[-1:] != b" ":  # a term may go on: look for its end
            more = [piece]
            while at < len(text):
                step = text[at : at + 4096].translate(by)
                end = step.find(b" ")
                more.append(step if end < 0 else step[:end])
                at += len(step) if end < 0 else end
                if end >= 0:
                    break
            piece = b"".join(more)
        yield piece.split()
