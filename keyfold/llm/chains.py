"""Wrong-decoding chains: which bytes a text may have come from, and how to undo it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

# Names of the encodings that are tried. The byte ones map every
# byte; the wide ones take several bytes for a character.
BYTE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "koi8-u", "cp1253", "iso8859-7", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "iso8859-15")
WIDE = ("cp932", "euc_jp", "gbk", "euc_kr", "big5")
UTF16 = ("utf-16-le", "utf-16-be")
LOSSY = "lossy"

#: A word that holds a character outside ASCII, with its ASCII letters.
WORD = re.compile(r"[A-Za-z'?]*[^\x00-\x7f]+(?:[A-Za-z'?]+[^\x00-\x7f]+)*[A-Za-z'?]*")
#: The last and the first run of letters of a piece of plain text.
_LEFT = re.compile(r"(?:.*[^A-Za-z])?([A-Za-z]+)[^A-Za-z]*$", re.S)
_RIGHT = re.compile(r"[^A-Za-z]*([A-Za-z]+)")
_LETTER = re.compile("[A-Za-z]")
#: What no text has of itself: replaced characters and control codes above ASCII (but next line).
_LOST = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
_PLAIN = re.compile("[a-z ]")

#: Weight, in nats, of a decoded character that random bytes would seldom form.
UTF8_WEIGHT, WIDE_WEIGHT, BYTE_WEIGHT, UTF16_WEIGHT, LOSSY_WEIGHT = 3.0, 0.7, 0.5, 4.0, 10.0
#: Shortest run that is taken for misread UTF-16.
UTF16_RUN = 6
#: Nats that a lower-case letter or space of misread UTF-16 tells for it (any other character as much
#: against it), a character that text holds and one that it seldom holds, and what a run with bytes outside ASCII costs.
UTF16_PLAIN, UTF16_TEXT, UTF16_ODD, UTF16_COST = 0.85, 0.33, 2.3, 8.0


#: Context of a short word that fills a pair of quotes.
QUOTED = '"'
#: Longest such word whose context is the quotes.
QUOTED_LENGTH = 3


def words(text: str) -> Iterator[tuple[str, str, int, int, tuple[str, ...] | None]]:
    """(word, context, start, end, beside) of every word outside ASCII.

    ``beside`` is None unless the word alone fills a pair of quotes; then it holds the
    other such words of the line.

    A lone symbol or letter says little by itself; its context is the ASCII word before
    it on the line, back to the next word outside ASCII, or else the one after it. In
    quotes it is counted by itself, since there it may stand for itself.
    """
    at = 0
    for line in text.split("\n"):
        if not line.isascii():
            found = []
            for m in WORD.finditer(line):
                a, b = m.span()
                while a < b and line[a] in "'?":
                    a += 1
                while b > a and line[b - 1] in "'?":
                    b -= 1
                quoted = 0 < a and b < len(line) and line[a - 1] == line[b] and line[b] in "\"'`"
                found.append((a, b, quoted))
            alone = {line[a:b] for a, b, quoted in found if quoted}
            for i, (a, b, quoted) in enumerate(found):
                w = line[a:b]
                context = ""
                if quoted and b - a <= QUOTED_LENGTH:
                    context = QUOTED
                elif len(w) == 1 or (len(w) <= 3 and not w.isalpha() and not _LETTER.search(w)):
                    left = _LEFT.match(line[found[i - 1][1] if i else 0 : a])
                    right = None if left else _RIGHT.match(line[b : found[i + 1][0] if i + 1 < len(found) else len(line)])
                    context = left[1] + "<" if left else ">" + right[1] if right else "-"
                yield w, context, at + a, at + b, tuple(sorted(alone - {w})) if quoted else None
        at += len(line) + 1


@cache
def _back(encoding: str) -> dict[str, int]:
    """Byte of every character that decoding gives, undefined bytes standing for themselves."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _bytes(text: str, encoding: str) -> bytes | None:
    if encoding in WIDE:
        try:
            return text.encode(encoding)
        except UnicodeError:
            return None
    back = _back(encoding)
    try:
        return bytes(ord(c) if c < "\x80" else back[c] for c in text)
    except KeyError:
        return None


def _decoded(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeError:
        return None


def _utf16(word: str, encoding: str) -> tuple[str, float] | None:
    """(text, weight) of a run that may be text whose bytes were read as UTF-16.

    Bytes outside ASCII are UTF-8 or else cp1252. They lower the weight, but a
    run is judged by the share of its characters that text usually holds.
    """
    raw = [x.encode(encoding, "ignore") for x in word.split("\ufffd")]
    text = "\ufffd".encode().join(raw).decode("utf-8", "replace")
    lost = text.count("\ufffd")
    utf8 = sum(c > "\x7f" for c in text) - lost > 2 * lost
    if not utf8:
        text = "\ufffd".join(_decoded(x, "cp1252") or x.decode("latin-1") for x in raw)
    n, plain = len(text), len(_PLAIN.findall(text))
    usual = sum(" " <= c < "\x7f" or c in "\t\n\r" for c in text)
    if usual == n:
        return (text, UTF16_WEIGHT * len(word)) if 2 * plain > n else None
    if utf8:
        letters = sum(c > "\x7f" and c.isalpha() for c in text)
        plain, usual = plain + letters, usual + letters
    weight = UTF16_PLAIN * (2 * plain - n) + UTF16_TEXT * usual - UTF16_ODD * (n - usual) - UTF16_COST
    return (text, weight) if 2 * plain > n and weight > 0 else None


@lru_cache(1 << 14)
def may_be_garbled(word: str, chain: str) -> bool:
    """Whether a word that was left as it is may be garbled: lost characters, or something to restore by ``chain`` or as UTF-8."""
    return any(r is None or ((c == chain or c.startswith("utf-8<")) and r != word) for c, r, _ in candidates(word))


def candidates(word: str) -> list[tuple[str, str | None, float]]:
    """(chain, restored word, structural weight) of all ways in which ``word`` may be garbled.

    A chain reads "true encoding<wrong encoding"; UTF-8 is undone as often as it
    was applied. ``LOSSY`` has no restored word.
    """
    out: list[tuple[str, str | None, float]] = []
    if _LOST.search(word):
        out.append((LOSSY, None, LOSSY_WEIGHT))
    wide_word = word.rstrip("\ufffd")
    if len(wide_word) >= UTF16_RUN:
        for e in UTF16:
            if read := _utf16(wide_word, e):
                # What is lost at the end stays marked.
                out.append((e, read[0] + word[len(wide_word):], read[1]))
    foreign = len(word) >= 3 and not _LETTER.search(word) and any(c.isalpha() for c in word)
    for wrong in BYTE + WIDE:
        raw = _bytes(word, wrong)
        if raw is None:
            continue
        restored, weight, now = None, 0.0, raw
        while True:  # each time the text gets shorter
            text = _decoded(now, "utf-8") if now is not None else None
            if text is None or text == (restored or word):
                break
            restored = text
            weight += UTF8_WEIGHT * sum(c > "\x7f" for c in text)
            now = _bytes(text, wrong) if not text.isascii() else None
        if restored is None and not raw.isascii():
            # Some bytes were dropped or replaced: most of the rest must still be UTF-8.
            text = raw.decode("utf-8", "replace")
            lost = text.count("\ufffd")
            good = sum(c > "\x7f" for c in text) - lost
            if good > 2 * lost:
                restored, weight = text, UTF8_WEIGHT * (good - 2 * lost)
        if restored is not None:
            out.append((f"utf-8<{wrong}", restored, weight))
        for true in BYTE + WIDE:
            if true == wrong:
                continue
            text = _decoded(raw, true)
            if text is None or text == word or text.isascii() or any("\x80" <= c < "\xa0" for c in text):
                continue
            weight = 0.0
            if wrong in WIDE:
                pass  # a multi-byte reading of other legacy bytes: letters and counts decide alone
            elif foreign and text.isalpha():
                weight = WIDE_WEIGHT * len(text) if true in WIDE else BYTE_WEIGHT * (len(text) - 2)
            elif foreign and true in WIDE and len(text) >= 3:
                weight = WIDE_WEIGHT * (len(text) - 1)
            out.append((f"{true}<{wrong}", text, weight))
    return out
