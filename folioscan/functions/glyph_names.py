"""Names of glyphs: the standard strings of compact fonts, encodings of single bytes, and names to Unicode."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

_UPPER, _LOWER = [chr(k) for k in range(65, 91)], [chr(k) for k in range(97, 123)]
_DIGITS = "zero one two three four five six seven eight nine".split()




_CAPITALS = "Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis Igrave Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute Ydieresis Zcaron".split()
#: By number, the strings that every compact font knows.
STANDARD_STRINGS = [
    ".notdef", *"space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash".split(), *_DIGITS,
    *"colon semicolon less equal greater question at".split(), *_UPPER, *"bracketleft backslash bracketright asciicircum underscore quoteleft".split(), *_LOWER, *"braceleft bar braceright asciitilde".split(),
    *"exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet".split(),
    *"quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash".split(),
    *"AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn".split(),
    *"threequarters twosuperior registered minus eth multiply threesuperior copyright".split(), *_CAPITALS, *[x[0].lower() + x[1:] for x in _CAPITALS],
    *"exclamsmall Hungarumlautsmall dollaroldstyle dollarsuperior ampersandsmall Acutesmall parenleftsuperior parenrightsuperior twodotenleader onedotenleader".split(), *[d + "oldstyle" for d in _DIGITS],
    *"commasuperior threequartersemdash periodsuperior questionsmall asuperior bsuperior centsuperior dsuperior esuperior isuperior lsuperior msuperior nsuperior osuperior rsuperior ssuperior tsuperior".split(),
    *"ff ffi ffl parenleftinferior parenrightinferior Circumflexsmall hyphensuperior Gravesmall".split(), *[x + "small" for x in _UPPER],
    *"colonmonetary onefitted rupiah Tildesmall exclamdownsmall centoldstyle Lslashsmall Scaronsmall Zcaronsmall Dieresissmall Brevesmall Caronsmall Dotaccentsmall Macronsmall figuredash hypheninferior".split(),
    *"Ogoneksmall Ringsmall Cedillasmall questiondownsmall oneeighth threeeighths fiveeighths seveneighths onethird twothirds zerosuperior".split(), *[d + "superior" for d in _DIGITS[4:]], *[d + "inferior" for d in _DIGITS],
    *"centinferior dollarinferior periodinferior commainferior Agravesmall Aacutesmall Acircumflexsmall Atildesmall Adieresissmall Aringsmall AEsmall Ccedillasmall Egravesmall Eacutesmall Ecircumflexsmall".split(),
    *"Edieresissmall Igravesmall Iacutesmall Icircumflexsmall Idieresissmall Ethsmall Ntildesmall Ogravesmall Oacutesmall Ocircumflexsmall Otildesmall Odieresissmall OEsmall Oslashsmall Ugravesmall Uacutesmall".split(),
    *"Ucircumflexsmall Udieresissmall Yacutesmall Thornsmall Ydieresissmall 001.000 001.001 001.002 001.003 Black Bold Book Light Medium Regular Roman Semibold".split(),
]

#: Characters whose names aren't built from a letter and an accent.
_SPECIAL = {
    "space": 32, "exclam": 33, "quotedbl": 34, "numbersign": 35, "dollar": 36, "percent": 37, "ampersand": 38, "quotesingle": 39, "parenleft": 40, "parenright": 41, "asterisk": 42, "plus": 43, "comma": 44, "hyphen": 45,
    "period": 46, "slash": 47, "colon": 58, "semicolon": 59, "less": 60, "equal": 61, "greater": 62, "question": 63, "at": 64, "bracketleft": 91, "backslash": 92, "bracketright": 93, "asciicircum": 94, "underscore": 95,
    "grave": 96, "braceleft": 123, "bar": 124, "braceright": 125, "asciitilde": 126, "quoteleft": 0x2018, "quoteright": 0x2019, "quotesinglbase": 0x201A, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E,
    "Euro": 0x20AC, "florin": 0x192, "ellipsis": 0x2026, "dagger": 0x2020, "daggerdbl": 0x2021, "circumflex": 0x2C6, "perthousand": 0x2030, "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "OE": 0x152, "oe": 0x153,
    "bullet": 0x2022, "endash": 0x2013, "emdash": 0x2014, "tilde": 0x2DC, "trademark": 0x2122, "exclamdown": 0xA1, "cent": 0xA2, "sterling": 0xA3, "currency": 0xA4, "yen": 0xA5, "brokenbar": 0xA6, "section": 0xA7,
    "dieresis": 0xA8, "copyright": 0xA9, "ordfeminine": 0xAA, "guillemotleft": 0xAB, "logicalnot": 0xAC, "registered": 0xAE, "macron": 0xAF, "degree": 0xB0, "plusminus": 0xB1, "twosuperior": 0xB2, "threesuperior": 0xB3,
    "acute": 0xB4, "mu": 0xB5, "paragraph": 0xB6, "periodcentered": 0xB7, "cedilla": 0xB8, "onesuperior": 0xB9, "ordmasculine": 0xBA, "guillemotright": 0xBB, "onequarter": 0xBC, "onehalf": 0xBD, "threequarters": 0xBE,
    "questiondown": 0xBF, "AE": 0xC6, "Eth": 0xD0, "multiply": 0xD7, "Oslash": 0xD8, "Thorn": 0xDE, "germandbls": 0xDF, "ae": 0xE6, "eth": 0xF0, "divide": 0xF7, "oslash": 0xF8, "thorn": 0xFE, "fi": 0xFB01, "fl": 0xFB02,
    "fraction": 0x2044, "dotlessi": 0x131, "Lslash": 0x141, "lslash": 0x142, "minus": 0x2212, "breve": 0x2D8, "dotaccent": 0x2D9, "ring": 0x2DA, "hungarumlaut": 0x2DD, "ogonek": 0x2DB, "caron": 0x2C7, "notequal": 0x2260,
    "infinity": 0x221E, "lessequal": 0x2264, "greaterequal": 0x2265, "partialdiff": 0x2202, "summation": 0x2211, "product": 0x220F, "pi": 0x3C0, "integral": 0x222B, "Omega": 0x3A9, "radical": 0x221A, "approxequal": 0x2248,
    "Delta": 0x2206, "lozenge": 0x25CA, "apple": 0xF8FF,
}
_MARKS = {"acute": "́", "circumflex": "̂", "dieresis": "̈", "grave": "̀", "ring": "̊", "tilde": "̃", "cedilla": "̧", "caron": "̌"}


@cache
def _unicode() -> dict[str, int]:
    out = dict(_SPECIAL) | {n: 48 + k for k, n in enumerate(_DIGITS)} | {x: ord(x) for x in _UPPER + _LOWER}
    for letter in _UPPER + _LOWER:
        for name, mark in _MARKS.items():
            if len(c := unicodedata.normalize("NFC", letter + mark)) == 1 and ord(c) < 0x180:
                out[letter + name] = ord(c)
    return out


def to_unicode(name: str) -> int | None:
    """The character of a glyph name, also of uniXXXX and uXXXX forms and before a suffix."""
    if (found := _unicode().get(name)) is not None:
        return found
    base = name.partition(".")[0]
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", base):
        return int(m[1] or m[2], 16)
    return _unicode().get(base) if base != name and base else None


@cache
def _names() -> dict[int, str]:
    return {u: n for n, u in reversed(_unicode().items())}


def _table(codec: str, extra: dict[int, str]) -> tuple[str, ...]:
    out = [""] * 256
    for code in range(32, 256):
        try:
            out[code] = _names().get(ord(bytes([code]).decode(codec)), "")
        except UnicodeDecodeError:
            pass
    for code, name in extra.items():
        out[code] = name
    return tuple(out)


@cache
def encoding(name: str | None) -> tuple[str, ...] | None:
    """256 glyph names of WinAnsiEncoding, MacRomanEncoding or StandardEncoding, '' for none; None of another."""
    if name == "WinAnsiEncoding":  # codes without a sign of their own show a bullet
        return _table("cp1252", {0x7F: "bullet", 0x81: "bullet", 0x8D: "bullet", 0x8F: "bullet", 0x90: "bullet", 0x9D: "bullet", 0xA0: "space", 0xAD: "hyphen"})
    if name == "MacRomanEncoding":
        return _table("mac_roman", {0x7F: "", 0xCA: "space", 0xDB: "currency"})
    if name == "StandardEncoding":
        out = [""] * 256
        for k in range(1, 96):
            out[31 + k] = STANDARD_STRINGS[k]
        at = [*range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, *range(0xE8, 0xEC), 0xF1, 0xF5, *range(0xF8, 0xFC)]
        for code, k in zip(at, range(96, 150)):
            out[code] = STANDARD_STRINGS[k]
        return tuple(out)
    return None
