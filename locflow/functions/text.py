"""Column rules for texts, keys and literals.

Every function here takes and returns a ``Column``; they are steps inside the
corpus jobs, evaluated by Catalyst in whole-stage codegen (``transform`` and
``regexp_extract_all`` are the only higher-order/array pieces). Nothing here
runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locflow.functions.tokens import BLANK, BOLD, EDGES, WS_CHARS

# The lookup expression written in place of a literal and the
# constant declaration generated for a key. ``{key}`` is the derived key.
LOOKUP_TEMPLATE = "sess.i18n(XlfKeys.{key})"
CONST_TEMPLATE = 'public const string {key} = "{key}";'


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(c) -> Column:
    """128 bits of a text's SHA-256: stands for the text where only equality counts."""
    return F.unhex(F.substring(F.sha2(col(c).cast("binary"), 256), 1, 32))


def ws_trim(c) -> Column:
    """Trim Unicode white space on both edges (Spark ``trim`` strips only U+0020); linear in the text."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """Null, empty or white space only (FLT-01).

    A match anchored at the start fails at the first non-blank character, so
    ordinary texts cost O(1) instead of a trimmed copy.
    """
    c = col(c)
    return c.isNull() | c.rlike(BLANK)


def first_line(c) -> Column:
    """Text up to the first line break (EXT-04)."""
    return F.substring_index(col(c), "\n", 1)


def newlines(c) -> Column:
    """Number of line breaks in a text; the line of an offset is 1 + this over the prefix (EXT-03)."""
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def pascal_key(c) -> Column:
    """PascalCase key (STR-03): runs of letters/digits, first letter upper, rest lower.

    ``ß`` is folded to ``ss`` first so that upper-casing is the same in every
    engine; a key that would start with a digit gets ``_`` in front; a text
    without letters or digits gives the blank key, which callers refuse.
    """
    words = F.regexp_extract_all(F.replace(col(c), F.lit("ß"), F.lit("ss")),
                                 F.lit(r"([\p{L}\p{N}]+)"), 1)
    cased = F.transform(words, lambda w: F.concat(F.upper(w.substr(F.lit(1), F.lit(1))),
                                                  F.lower(w.substr(F.lit(2), F.length(w)))))
    # the leading digit is seen on the text: the words are put together once
    digit = F.when(col(c).rlike(r"^[^\p{L}\p{N}]*+\p{N}"), F.lit("_")).otherwise(F.lit(""))
    return F.concat(digit, F.array_join(cased, ""))


def has_key(c) -> Column:
    """The text has a letter or digit, so its key is not blank; decided without making the key."""
    return col(c).rlike(r"[\p{L}\p{N}]")


def key_basis(text, translation) -> Column:
    """The text that a key is made from: the translation if not blank, else the text."""
    t = col(translation)
    return F.when(is_blank(t), col(text)).otherwise(t)


def key_for(text, translation=None, explicit=None) -> Column:
    """Key rule of STR-03: explicit key, else from the translation if not blank, else from the text."""
    key = pascal_key(col(text) if translation is None else key_basis(text, translation))
    if explicit is not None:
        e = col(explicit)
        key = F.when(is_blank(e), key).otherwise(e)     # a blank explicit key names nothing
    return key


def carry_capital(source, translation) -> Column:
    """Upper-case the translation's first letter when the source starts upper-case (STR-02)."""
    s, t = col(source), col(translation)
    return F.when(s.rlike(r"^\p{Lu}"),
                  F.concat(F.upper(t.substr(F.lit(1), F.lit(1))), t.substr(F.lit(2), F.length(t)))
                  ).otherwise(t)


def lookup_expr(key, template: str = LOOKUP_TEMPLATE) -> Column:
    """Lookup expression that replaces a literal (STR-04)."""
    head, tail = template.split("{key}")
    return F.concat(F.lit(head), col(key), F.lit(tail))


def const_decl(key, template: str = CONST_TEMPLATE) -> Column:
    """Constant declaration whose value equals its name (STR-05)."""
    parts = template.split("{key}")
    pieces = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [col(key), F.lit(p)]
    return F.concat(*pieces)


def clean_capture(c) -> Column:
    """Captured text cleanup (STR-06): quotes off both ends, colons off the end."""
    return F.regexp_replace(F.regexp_replace(col(c), r'^"+|"+\z', ""), r":+\z", "")


def backslash_verbatim(raw) -> Column:
    """A regular literal of one to four escaped backslashes as a verbatim one (STR-07), others as they are.

    Applied to a whole token, so a literal that merely begins like that is
    never touched. The direction is inferred from how the reference calls its
    helper (the helper's body is not there).
    """
    raw = col(raw)
    half = F.substring(raw, 2, 8)
    body = half.substr(F.lit(1), F.length(raw) - 2)
    return F.when(raw.rlike(r'^"(?:\\\\){1,4}"\z'), F.concat(
        F.lit('@"'), body.substr(F.lit(1), (F.length(body) / 2).cast("int")), F.lit('"'))).otherwise(raw)


# One-letter escapes of a regular literal and what they stand for.
ESCAPES = (("\\", "\\"), ('"', '"'), ("'", "'"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("0", "\0"), ("a", "\x07"),
           ("b", "\b"), ("f", "\f"), ("v", "\x0b"))

_HEX4 = r"(?:[0-9A-CEFa-cef][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"     # no half of a surrogate pair
_PAIR = r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}"
_WIDE = r"\\U00(?:0[1-9A-Fa-f]|10)[0-9A-Fa-f]{4}|\\U0000" + _HEX4
_PIECES = rf"(?s){_PAIR}|\\u{_HEX4}|{_WIDE}|\\x(?:{_HEX4}|[0-9A-Fa-f]{{1,3}})|\\.|[^\\]++|\\"


def escape_text(c) -> Column:
    """Text to the body of a regular C# literal (STR-08, escaping direction)."""
    out = col(c)
    for letter, char in ESCAPES:
        if letter != "'":
            out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def unescape_text(c) -> Column:
    """Body of a regular literal back to text (STR-08, loading direction).

    One pass from left to right over all escapes of the language; what is no
    escape (an unknown letter, half a surrogate pair) stays as written.
    """
    def value(piece):
        hexes = F.replace(F.substring(piece, 3, 10), F.lit("\\u"), F.lit(""))
        letter = F.substring(piece, 2, 1)
        out = F.when(~piece.startswith("\\"), piece)
        for name, char in ESCAPES:
            out = out.when(piece == F.lit("\\" + name), F.lit(char))
        known = piece.rlike(r"^\\[uxU][0-9A-Fa-f]")
        out = out.when(known & (letter == "U"), F.decode(F.unhex(hexes), "UTF-32"))
        return out.when(known, F.decode(F.unhex(F.lpad(hexes, F.greatest(F.length(hexes), F.lit(4)), F.lit("0"))), "UTF-16BE")) \
                  .otherwise(piece)

    c = col(c)
    return F.when(~c.contains("\\"), c).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0)), value), ""))


def literal_value(text, kind) -> Column:
    """The string a literal stands for: escapes resolved (regular) or ``""`` → ``"`` (verbatim).

    A literal of markup (``kind`` null or ``markup``) is its own value.
    """
    text, kind = col(text), col(kind)
    return (F.when(kind == "verbatim", F.replace(text, F.lit('""'), F.lit('"')))
             .when(kind == "regular", unescape_text(text)).otherwise(text))


def regular_form(text, kind) -> Column:
    """Any literal rewritten as a regular literal of the same value (STR-07 generalised: ``@"\\"`` → ``"\\\\"``)."""
    return wrap_quotes(escape_text(literal_value(text, kind)))


def wrap_quotes(c) -> Column:
    """``"text"`` (STR-09)."""
    return F.concat(F.lit('"'), col(c), F.lit('"'))


def once(value: Column, make) -> Column:
    """``make(value)`` with ``value`` computed once, however often ``make`` names it.

    Columns are trees: a value named twice is computed twice, and each further
    step made of it doubles that again.
    """
    return F.transform(F.array(value), make)[0]


def edges(c) -> Column:
    """Split up to two non letter/digit characters off each edge (EXT-07).

    Returns ``struct(prefix, core, suffix)`` with ``prefix || core || suffix``
    equal to the input (lossless, Q15/Q16 fixed). Only two characters of an
    edge are looked at, whatever the text's length.
    """
    two = F.lit(2)

    def ended(rest: Column, prefix: Column) -> Column:
        return once(F.regexp_extract(F.right(rest, two), EDGES[1], 0), lambda suffix: F.struct(
            prefix.alias("prefix"), rest.substr(F.lit(1), F.length(rest) - F.length(suffix)).alias("core"), suffix.alias("suffix")))

    return once(col(c), lambda c: once(F.regexp_extract(F.left(c, two), EDGES[0], 0), lambda prefix: once(
        c.substr(F.length(prefix) + 1, F.length(c)), lambda rest: ended(rest, prefix))))


def split_value(c) -> Column:
    """A value as ``struct(prefix, core, suffix)``: bold tags and edge characters off the core (EXT-06, EXT-07).

    ``prefix || core || suffix`` is the value. A value whose core would be
    blank stays whole.
    """
    def parts(c: Column) -> Column:
        bold = c.rlike(BOLD)
        before = F.when(bold, F.substring(c, F.lit(1), F.instr(c, "<b>") + 2)).otherwise(F.lit(""))
        inside = F.when(bold, F.regexp_extract(c, BOLD, 2)).otherwise(c)
        return once(F.struct(before.alias("before"), inside.alias("inside")), lambda b: once(edges(b["inside"]), lambda e: once(
            is_blank(e["core"]), lambda whole: joined(c, b, e, whole))))

    def joined(c: Column, b: Column, e: Column, whole: Column) -> Column:
        empty = F.lit("")
        after = c.substr(F.length(b["before"]) + F.length(b["inside"]) + 1, F.length(c))
        return F.struct(F.when(whole, empty).otherwise(F.concat(b["before"], e["prefix"])).alias("prefix"),
                        F.when(whole, c).otherwise(e["core"]).alias("core"),
                        F.when(whole, empty).otherwise(F.concat(e["suffix"], after)).alias("suffix"))

    return once(col(c), parts)


def split_lookup(key, prefix, suffix, template: str = LOOKUP_TEMPLATE) -> Column:
    """The lookup of a core between what was split off, as literals of their own."""
    prefix, suffix = col(prefix), col(suffix)
    head = F.when(prefix != "", F.concat(wrap_quotes(escape_text(prefix)), F.lit(" + "))).otherwise(F.lit(""))
    tail = F.when(suffix != "", F.concat(F.lit(" + "), wrap_quotes(escape_text(suffix)))).otherwise(F.lit(""))
    lookup = lookup_expr(key, template)
    return F.when((prefix == "") & (suffix == ""), lookup).otherwise(F.concat(F.lit("("), head, lookup, tail, F.lit(")")))


def bold_parts(c) -> Column:
    """``<b>x</b>`` (edge blanks allowed) to ``struct(open, core, close)``; null when not bold (EXT-06)."""
    c = col(c)
    hit = c.rlike(BOLD)
    return F.when(hit, F.struct(F.regexp_extract(c, BOLD, 1).alias("open"),
                                F.regexp_extract(c, BOLD, 2).alias("core"),
                                F.regexp_extract(c, BOLD, 3).alias("close")))


def clean_line(c) -> Column:
    """Line cleanup (EXT-08): cut at ``//``, trim, drop trailing commas."""
    return F.regexp_replace(ws_trim(F.substring_index(col(c), "//", 1)), r",+\z", "")


def token_kind(raw) -> Column:
    """Kind of a code token: ``verbatim``, ``regular`` or ``interpolated`` (literals), ``comment``, ``block``, ``char``
    or ``directive``."""
    raw = col(raw)
    return (F.when(raw.startswith('"'), "regular")      # most tokens, told without a pattern
             .when(raw.startswith("//"), "comment").when(raw.startswith("/*"), "block")
             .when(raw.startswith("'"), "char").when(raw.rlike(r"^[ \t]*+#"), "directive")
             .when(raw.startswith("$") | raw.startswith("@$"), "interpolated")
             .when(raw.startswith("@"), "verbatim").otherwise("regular"))


def inner_text(raw, kind) -> Column:
    """Characters between a literal's quotes, without what stands before the first one (EXT-09).

    Of other tokens: what stands between their markers.
    """
    raw, kind = col(raw), col(kind)
    start = (F.when(kind == "comment", F.lit(2)).when(kind == "block", F.lit(3)).when(kind == "char", F.lit(2))
              .when(kind == "directive", F.instr(raw, "#") + 1).otherwise(F.instr(raw, '"') + 1))
    behind = F.when(kind == "block", F.lit(2)).when(kind == "directive", F.lit(0)).otherwise(F.lit(1))
    return raw.substr(start, F.length(raw) - start + 1 - behind)
