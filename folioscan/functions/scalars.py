"""Scalar functions as columns: strings, dates, numbers, matrices, colours and simple functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.xmp import ISO_DATE, ISO_PARTS


def is_hex_string(c: Column) -> Column:
    """Only hexadecimal digits and white space."""
    return c.rlike("^[0-9A-Fa-f \\t\\r\\n\\f]*$")


def hex_odd(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[ \\t\\r\\n\\f]", "")) % 2 == 1


def fix_hex(c: Column) -> Column:
    """Drops what is no digit; an odd number of digits gets a zero at the end."""
    d = F.regexp_replace(c, "[^0-9A-Fa-f]", "")
    return F.when(F.length(d) % 2 == 1, F.concat(d, F.lit("0"))).otherwise(d)


def decode_hex(c: Column) -> Column:
    return F.unhex(fix_hex(c))


def text_string(c: Column) -> Column:
    """The text of bytes: UTF-16 behind its mark, else one byte a character."""
    return F.when(F.substring(F.hex(c), 1, 4) == "FEFF", F.decode(F.unhex(F.substring(F.hex(c), 5, 1 << 30)), "UTF-16BE")).otherwise(F.decode(c, "ISO-8859-1"))


def unescape_name(c: Column) -> Column:
    """#XX of printable ASCII; other escapes stay for the reader of bytes."""
    parts = F.split(c, "#(?=[2-7][0-9A-Fa-f])")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.substring(p, 3, 1 << 30)))
    return F.concat(parts[0], F.array_join(rest, ""))


def escape_literal(c: Column) -> Column:
    c = F.regexp_replace(c, "([()\\\\])", "\\\\$1")
    return F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def pdf_date(ts: Column) -> Column:
    """A timestamp as D:YYYYMMDDHHmmSSZ."""
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Z"))


def pdf_date_to_iso(c: Column) -> Column:
    """At the precision it has; with a time, in UTC unless it states a zone."""
    g = lambda k: F.regexp_extract(c, r"^D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([+-])(\d\d)'?(\d\d)?'?|Z.*)?$", k)
    zone = F.when(g(7) != "", F.concat(g(7), g(8), F.lit(":"), F.when(g(9) == "", "00").otherwise(g(9)))).otherwise("Z")
    date = F.concat(g(1), F.when(g(2) != "", F.concat(F.lit("-"), g(2))).otherwise(""), F.when(g(3) != "", F.concat(F.lit("-"), g(3))).otherwise(""))
    time = F.when(g(4) != "", F.concat(F.lit("T"), g(4), F.lit(":"), F.when(g(5) == "", "00").otherwise(g(5)), F.when(g(6) != "", F.concat(F.lit(":"), g(6))).otherwise(""), zone)).otherwise("")
    return F.when(g(1) != "", F.concat(date, time))


def iso_to_pdf_date(c: Column) -> Column:
    g = lambda k: F.regexp_extract(c, f"^{ISO_PARTS}$", k)
    zone = F.when(g(7).isin("", "Z"), g(7)).otherwise(F.concat(F.substring(g(7), 1, 3), F.lit("'"), F.substring(g(7), 5, 2), F.lit("'")))
    return F.when(g(1) != "", F.concat(F.lit("D:"), g(1), g(2), g(3), g(4), g(5), g(6), zone))


def is_iso_date(c: Column) -> Column:
    return c.rlike(f"^{ISO_DATE}$")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column) -> Column:
    """The five entities, the ampersand first."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def single_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\x00-\\x1f\\x7f]+", " "))


def truncate_name(c: Column, most: int = 127) -> Column:
    """The longest beginning of at most so many bytes of UTF-8, for texts in ASCII; others are cut at characters."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(c, 1, most))


def matrix_apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def matrix_multiply(m: list[Column], n: list[Column]) -> list[Column]:
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o]


def matrix_invert(m: list[Column]) -> list[Column]:
    """Null where there is no inverse."""
    a, b, c, d, e, f = m
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return [d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det]


def exponential(x: Column, c0: float, c1: float, n: float, low: float = 0.0, high: float = 1.0) -> Column:
    """Function type 2 over its domain."""
    return F.lit(c0) + F.pow(clamp(x, low, high), F.lit(n)) * F.lit(c1 - c0)


def stitching(x: Column, bounds: list[float], parts: list, encode: list[tuple[float, float]], low: float = 0.0, high: float = 1.0) -> Column:
    """Function type 3: the part of the first bound above x, on the part's own range."""
    x = clamp(x, low, high)
    edges = [low, *bounds, high]
    out = None
    for k in range(len(parts) - 1, -1, -1):
        (e0, e1), width = encode[k], edges[k + 1] - edges[k]
        v = parts[k](F.lit(e0) + (x - edges[k]) * ((e1 - e0) / width))
        out = v if out is None else F.when(x < edges[k + 1], v).otherwise(out)
    return out


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [F.lit(1.0) - F.least(F.lit(1.0), x + k) for x in (c, m, y)]


def claimed_conformance(packet: Column) -> list[Column]:
    return [F.regexp_extract(packet, rf"pdfaid:{p}(?:>|=\")([^<\"]*)", 1) for p in ("part", "conformance")]


def too_long(length: Column, most: int) -> Column:
    return length > most


def integer_out_of_range(n: Column, low: int = -(1 << 31), high: int = (1 << 31) - 1) -> Column:
    return (n > high) | (n < low)


def real_out_of_range(n: Column, most: float = 32767.0) -> Column:
    """By its value in single precision."""
    return F.abs(n.cast("float")) > most


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, '' without one."""
    return F.regexp_extract(text, pattern, 1)


def namespace_bindings(text: Column) -> Column:
    """An array of (prefix, uri) that the tags of a packet bind."""
    found = F.regexp_extract_all(text, F.lit("xmlns:([\\w.-]+)\\s*=\\s*[\"'][^\"']*[\"']"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "xmlns:([\\w.-]+)", 1).alias("prefix"), F.regexp_extract(x, "[\"']([^\"']*)[\"']", 1).alias("uri")))


def same_text(info: Column, packet: Column) -> Column:
    """Whether an information entry and a packet's value agree but for white space around them; null is the empty text."""
    return F.trim(F.coalesce(info, F.lit(""))) == F.trim(F.coalesce(packet, F.lit("")))


def float_array(texts: Column) -> Column:
    """An array of numbers from one of texts; null if any of them is no number."""
    numbers = F.transform(texts, lambda x: x.try_cast("double"))
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)


def is_integer(c: Column) -> Column:
    return c.rlike("^[+-]?[0-9]+$")


def default_appearance(c: Column) -> tuple[Column, Column]:
    """The size of the font that an appearance string sets, 0 without, and its operators of colour in order."""
    number = "[-+]?[0-9]*[.]?[0-9]+"
    size = F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"/[^\s/]+\s+({number})\s+Tf(?![^\s])"), F.lit(1)), F.lit(-1)).try_cast("double"), F.lit(0.0))
    return size, F.regexp_extract_all(c, F.lit(rf"((?:{number}\s+)+(?:g|rg|k))(?![^\s])"), F.lit(1))
