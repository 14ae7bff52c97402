"""Token patterns.

Spark evaluates these with ``java.util.regex``; the oracle SQL uses the same
patterns in RE2 form. Java regex recurses per repeated group, so the Spark
forms use possessive quantifiers (``*+``): a 40,000-character literal with
thousands of escapes would otherwise overflow the thread stack. Possessive and
plain forms give the same tokens because no alternative needs to give back
characters.
"""

from __future__ import annotations

# The token grammar of source code, one alternation. Its states are the alternatives: inside a verbatim
# literal, a regular one (either may be interpolated), a line comment, a block comment, a character literal and a
# preprocessor line a quote opens nothing. Where none of them starts, a quote or a comment opener is a stray one.
# A hole of an interpolated literal on one line may hold literals and characters of its own; one whose holes don't close
# ends at its next quote.
VERBATIM = r'(?:\$@|@\$?)"[^"]*+(?:""[^"]*+)*+"'
REGULAR = r'\$?"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"'
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\\\n]*+)'"
_QUOTED = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"'
_HOLE = r"\{[^\"'{}\n]*+(?:(?:" + _QUOTED + "|" + _CHAR + r")[^\"'{}\n]*+)*+\}"
INTERPOLATED = r'\$"[^"\\{\n]*+(?:(?:\\[^\n]|\{\{|' + _HOLE + r')[^"\\{\n]*+)*+"'
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
CHAR = _CHAR
DIRECTIVE = r"(?md:^)[ \t]*+#[^\n]*+"
CODE_TOKEN = "|".join((VERBATIM, INTERPOLATED, REGULAR, LINE_COMMENT, BLOCK_COMMENT, CHAR, DIRECTIVE))
# Markup: any quoted run.
MARKUP_TOKEN = r'"[^"]*+"'

PROFILES = {"code": CODE_TOKEN, "markup": MARKUP_TOKEN}
# What opens a token: outside all tokens it is stray, and the file's tokens can't be trusted (FLT-03).
OPENERS = {"code": ('"', "'", "/*"), "markup": ('"',)}
# Kinds of tokens that are string literals; the others are line and block comments, characters and preprocessor lines.
LITERALS = ("regular", "verbatim", "interpolated")

# White space as .NET ``Char.IsWhiteSpace`` sees it: separators, the C0
# controls 9-13 and U+0085. The same class works in Java and RE2.
WS = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
# The same characters one by one, for trimming without a pattern.
WS_CHARS = ("\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
BLANK = r"\A" + WS + r"*+\z"

# Edge split (EXT-07): up to two non letter/digit characters on each edge.
EDGES = (r"^[^\p{L}\p{N}]{0,2}", r"[^\p{L}\p{N}]{0,2}\z")

# Bold wrap (EXT-06): the whole literal, edge blanks allowed.
BOLD = r"(?s)^" + WS + r"*(<b>)(.*)(</b>)" + WS + r"*\z"

# Lookup prefixes (FLT-05); a literal right behind one of these
# is already wrapped in a resource lookup.
LOOKUP_PREFIXES = ("RLData.en[", "RLData.cs[")

# A declared constant (EXT-05); key between the marker and
# ``=``, value between the first and the last quote of the line.
CONST_LINE = r'const string\s+(\w+)\s*=[^"]*"(.*)"'
