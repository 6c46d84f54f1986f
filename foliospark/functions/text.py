"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.let import let

CJK = "㐀-䶿一-鿿豈-﫿"
#: Ideographs with their punctuation and full-width forms.
CJK_WIDE = CJK + "　-〿＀-￯"
CJK_MARKS = "‘’“”、。〈-」！（），．：；？"
BLANK = r"[^\S\n]+"
SENTENCE_END = "[.;?!。！；？]"
#: Where Python's str.splitlines() parts lines.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Whether there is any: single characters are looked up, ranges and alternatives are tried at each place.
_BROKEN = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Control characters one by one: a set of them is looked up.
_CONTROL = "[" + "".join(f"\\x{k:02x}" for k in (*range(32), 127)) + "]"
#: What \\s takes for white space with (?U).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_C1 = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_C1 = {chr(b): c for b, c in _C1.items() if c}
#: Full-width letters, digits and signs with an ASCII twin, but for the punctuation that Chinese text keeps.
_KEPT_WIDE = set('!"#$%&\'()*,:;?@|')
_WIDE = {chr(a + 0xFEE0): chr(a) for a in range(0x21, 0x7F) if chr(a) not in _KEPT_WIDE}


def ends_with(c: Column, signs: str) -> Column:
    """Whether the last character is one of signs; a pattern would try every position before."""
    return F.right(c, F.lit(1)).isin(*signs)


def py_strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included. A pattern would try every position between them."""
    return F.trim(c, F.lit(WHITE))


def replace_where(c: Column, sign: str, regex: str, by: str) -> Column:
    """regexp_replace() of the texts that have sign, without which nothing matches; looking for that is far cheaper."""
    return let(c, lambda t: F.when(F.instr(t, sign) > 0, F.regexp_replace(t, regex, by)).otherwise(t))


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def drop_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def recover_c1(c: Column) -> Column:
    """Code points 80 to 9F, which are Windows-1252 bytes taken for Latin-1, as what they were meant to be."""
    return let(c, lambda t: F.when(beyond_ascii(t) & t.rlike("[\x80-\x9f]"), F.translate(t, "".join(_C1), "".join(_C1.values()))).otherwise(t))


def narrow_fullwidth(c: Column) -> Column:
    return let(c, lambda t: F.when(beyond_ascii(t) & t.rlike("[\uff01-\uff5e]"), F.translate(t, "".join(_WIDE), "".join(_WIDE.values()))).otherwise(t))


def _cjk_pass(c: Column) -> Column:
    for left, right in ((CJK_WIDE, CJK_WIDE), (CJK_WIDE, CJK_MARKS), (CJK_MARKS, CJK_WIDE)):
        c = F.regexp_replace(c, f"(?U)([{left}]){BLANK}([{right}])", "$1$2")
    return c


def close_cjk_gaps(c: Column) -> Column:
    """Without blanks between ideographs and their punctuation.

    One pass with lookaround does it, unless the ideographic space occurs, which is both blank and ideograph: then
    passes follow each other until nothing can change, each taking a blank at least. Texts without ideographs or their marks are left alone.
    """

    def gaps(t: Column) -> Column:
        once = F.regexp_replace(t, f"(?U)(?<=[{CJK_WIDE}]){BLANK}(?=[{CJK_WIDE}{CJK_MARKS}])|(?<=[{CJK_MARKS}]){BLANK}(?=[{CJK_WIDE}])", "")
        rounds = F.sequence(F.lit(0), F.size(F.regexp_extract_all(t, F.lit(r"(?U)([^\S\n])"), F.lit(1))))
        slow = F.aggregate(rounds, t, lambda x, _: _cjk_pass(x))
        return F.when(~beyond_ascii(t) | ~t.rlike(f"(?=[^\\x00-\\xff])[{CJK_WIDE}]"), t).when(F.instr(t, "\u3000") > 0, slow).otherwise(once)

    return let(c, gaps)


def simplify_primes(c: Column) -> Column:
    return replace_where(replace_where(c, r"\prime", r"\^\{\^\{\\prime\}\}", "'"), r"\prime", r"\^\{\\prime\}", "'")


def collapse_blanks(c: Column) -> Column:
    """Runs of white space but newlines as one blank; single blanks, which are most of them, aren't replaced by themselves."""
    return F.regexp_replace(c, rf"(?U)[\s&&[^\n ]][^\S\n]*| {BLANK}", " ")


def clean(c: Column, encoding: bool = True, fullwidth: bool = True, cjk_spaces: bool = True, strip: bool = True) -> Column:
    """All of the above, in order. ASCII without control characters and double blanks, which most short texts are, has nothing for any but the last."""
    return let(c, lambda t: F.when(~beyond_ascii(t) & (F.instr(t, "  ") == 0) & ~t.rlike(_CONTROL), py_strip(simplify_primes(t)) if strip else simplify_primes(t)).otherwise(_clean(t, encoding, fullwidth, cjk_spaces, strip)))


def _clean(c: Column, encoding: bool, fullwidth: bool, cjk_spaces: bool, strip: bool) -> Column:
    c = drop_control_chars(c)
    c = recover_c1(c) if encoding else c
    c = narrow_fullwidth(c) if fullwidth else c
    c = close_cjk_gaps(c) if cjk_spaces else c
    c = collapse_blanks(simplify_primes(c))
    return py_strip(c) if strip else c


def lines(c: Column) -> Column:
    """Like str.splitlines(): no empty last line."""
    parted = lambda t: let(F.split(t, LINE_BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))
    return let(c, lambda t: F.when(~t.rlike(_BROKEN) & (t != ""), F.array(t)).otherwise(parted(t)))


def solid_lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(c), py_strip), lambda x: F.length(x) > 0)


def compact(c: Column) -> Column:
    """Solid lines joined by blanks. Most texts are one line."""
    return let(c, lambda t: F.when(t.rlike(_BROKEN), F.array_join(solid_lines(t), " ")).otherwise(py_strip(t)))


def text_len(c: Column) -> Column:
    return F.length(compact(c))


def line_count(c: Column) -> Column:
    return F.greatest(F.size(solid_lines(c)), F.lit(1))


def truncate(c: Column, limit: int) -> Column:
    """compact(), cut to limit characters, the last then an ellipsis."""
    cut = lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
    # compact() of a text begins with that of its beginning; where this is too long already, the rest doesn't matter.
    return let(compact(F.substring(c, 1, 4 * limit)), lambda head: F.when((F.length(head) > limit) | (F.length(c) <= 4 * limit), cut(head)).otherwise(let(compact(c), cut)))


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def first_line(c: Column) -> Column:
    return py_strip(F.substring_index(c, "\n", 1))


def for_comparison(c: Column) -> Column:
    """Without heading marks and page markers, white space collapsed: what metrics compare."""
    c = replace_where(c, "#", r"(?mU)^#{1,6}\s+", "")
    c = replace_where(c, "<!-- PAGE ", r"<!-- PAGE \d+ -->", "")
    # Single blanks stay as they are.
    return py_strip(F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def to_int(c: Column) -> Column:
    """A number that is whole, or a string of digits; else null."""
    return let(py_strip(c.cast("string")), lambda t: F.when(t.rlike(r"^\d+\z"), t.cast("int")))
