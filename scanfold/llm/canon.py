"""One form for text that looks the same.

A transducer over grapheme clusters: a cluster (a character with the marks and invisible
characters that follow it) is looked up in a compiled table and replaced by what it shows.
The table is made once, from Unicode's own data for widths, ligatures, styled letters and
spaces, and from a list of look-alike letters, and it is checked for conflicts before use:
no source may have two targets and no target may be a source again. Printable ASCII is no
source. Accents that can be seen stay, composed. The text is passed over
once, and runs of printable ASCII are skipped as a whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲⅽᴄ", "d": "ԁⅾ", "e": "еҽ℮", "f": "ẝꬵ", "g": "ɡց", "h": "һհ", "i": "іıι", "j": "јϳ", "k": "κ",
    "l": "ӏⅼ∣ǀ", "m": "ⅿ", "n": "ոռ", "o": "оοօഠᴏ", "p": "рρ⍴", "q": "ԛգ", "r": "ꭇ", "s": "ѕ", "u": "υսʋ", "v": "νѵⅴᴠ", "w": "ԝѡᴡ", "x": "хⅹ", "y": "уүγỿ", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟⅭ", "D": "ᎠⅮ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦK", "L": "ᏞⅬ",
    "M": "МΜᎷⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Սᑌ", "V": "ѴᏙⅤ", "W": "ԜᎳ", "X": "ХΧⅩ", "Y": "ҮΥᎩ", "Z": "ΖᏃ",
    "-": "‐‑‒–−﹣", "'": "‘’ʼ′", '"': "“”″", ".": "․", ",": "‚", ":": "։∶", ";": ";", "/": "⁄∕", "!": "ǃ",
}
# Marks and fillers that show nothing, beside the format characters (category Cf).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠏" + "".join(map(chr, range(0xFE00, 0xFE10)))

_ASCII = re.compile(r"[\x20-\x7e]+")


def is_invisible(ch: str) -> bool:
    return ch in INVISIBLE or unicodedata.category(ch) == "Cf" or 0xE0100 <= ord(ch) <= 0xE01EF


def build_table() -> dict[str, str]:
    """Every single character that changes -> what it shows. Made from Unicode data, then checked."""
    alike = {s: t for t, sources in LOOK_ALIKES.items() for s in sources}
    if len(alike) != sum(map(len, LOOK_ALIKES.values())):
        raise ValueError("a look-alike has two targets")
    table: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3 or 0x3400 <= code <= 0x9FFF or 0x20000 <= code <= 0x2A6DF:
            continue
        ch = chr(code)
        if ch in alike:
            table[ch] = alike[ch]
            continue
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            continue
        if is_invisible(ch):
            table[ch] = ""
        elif cat == "Zs":
            table[ch] = " "
        elif cat in ("Zl", "Zp"):
            table[ch] = "\n"
        elif cat[0] != "M":
            kind = unicodedata.decomposition(ch).partition(">")[0]
            if kind.startswith("<") and kind not in ("<super", "<sub", "<fraction", "<circle", "<square"):
                shown = "".join(alike.get(x, x) for x in unicodedata.normalize("NFKC", ch))
                if shown != ch:
                    table[ch] = shown
            elif (base := unicodedata.normalize("NFD", ch))[0] in alike:
                table[ch] = unicodedata.normalize("NFC", alike[base[0]] + base[1:])
            elif len(base) == 1 and base != ch:
                table[ch] = alike.get(base, base)
    for ch, shown in table.items():
        again = "".join(table.get(x, x) for x in shown)
        if again != shown:
            table[ch] = again
            if any(x in table for x in again):
                raise ValueError(f"{ch!r} has no fixed form")
    return table


class Transducer:
    """Maps clusters to their one form; clusters met are kept, up to ``MEMORY`` of them."""

    MEMORY = 200_000

    def __init__(self) -> None:
        self.table = build_table()
        is_mark = lambda c: unicodedata.category(c)[0] == "M" or unicodedata.category(self.table.get(c, c)[:1] or "a")[0] == "M"
        marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(is_mark))
        hidden = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(is_invisible))
        tail = f"[{marks}{hidden}]"
        # the longest match: marks and hidden characters belong to the character before them
        self._cluster = re.compile(rf"[^{marks}{hidden}]{tail}+|[^\x00-\x7e]{tail}*|\r\n?|\t|\x0b|\x0c")
        self._forms: dict[str, str] = {}

    def _form(self, m: re.Match) -> str:
        c = m.group()
        got = self._forms.get(c)
        if got is None:
            if len(self._forms) >= self.MEMORY:
                self._forms.clear()
            got, last = self._show(c), c
            while got != last:  # marks that compose anew may show something else again
                got, last = self._cluster.sub(lambda x: self._show(x.group()), got), got
            self._forms[c] = got
        return got

    def _show(self, c: str) -> str:
        if c[0] == "\r":
            return "\n"
        if c in ("\t", "\x0b", "\x0c"):
            return " "
        get = self.table.get
        return unicodedata.normalize("NFC", "".join(get(x, x) for x in unicodedata.normalize("NFC", "".join(x for x in c if get(x, x) != ""))))

    def apply(self, text: str) -> str:
        """The text's one form. Applying it again changes nothing."""
        return self._cluster.sub(self._form, text)


def _ranges(test) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or not test(chr(code)):
            continue
        if out and out[-1][1] == code - 1:
            out[-1] = (out[-1][0], code)
        else:
            out.append((code, code))
    return out


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The compiled transducer of this process."""
    return Transducer()
