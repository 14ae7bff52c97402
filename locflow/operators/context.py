"""Where a literal stands in its file (FLT-06): the code around it decides with its text.

The same text can be a message in one place and a key in another. What counts
is the code between a token and the one before it (its gap), read backwards
from the token, and the start of the code behind it: a call's name, an
attribute of a declaration, a ``case`` label, an indexer, a comparison; in
markup the attribute's name. A token behind nothing but a comma, a plus sign
or a comment stands where the token before it stands, so ``Equals(x, "a" +
"b")`` is one place. That is inherited along the file's token array, in one
row, without a window over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calls whose text arguments are looked up or compared, not shown.
LOOKUP_CALLS = ("Attribute Combine Compare CompareTo Contains Element EndsWith Equals FindName GetAttribute GetEnvironmentVariable "
                "GetField GetMethod GetProperty IndexOf LastIndexOf OpenSubKey Replace SetAttribute Split StartsWith Trim TrimEnd "
                "TrimStart").split()
# Attributes of markup whose values a reader sees.
TEXT_ATTRIBUTES = "alt aria-label content label placeholder summary title value".split()
PLACES = ("attribute", "case", "index", "compare")

# Patterns on a gap read backwards, anchored at its end, so each is one pass over what it matches.
_CALL = r"^\s*+(?:,[^(){};]*+)?+\(\s*+([A-Za-z0-9_]++)"
_ATTRIBUTE = r"^\s*+(?:,[^(){};]*+)?+\(\s*+[A-Za-z0-9_.:]++\s*+\[(?:[ \t\r]*+(?:\n|\z)|\s*+[{};])"
_CASE = r"^\s++esac(?:[^A-Za-z0-9_]|\z)"
_INDEX = r"^\s*+\[\s*+[A-Za-z0-9_\])]"
_COMPARED = r"^\s*+=[=!]"
_COMPARES = r"^\s*+[=!]="
_SAME_PLACE = r"^\s*+[,+]?+\s*+\z"
_MARKUP_ATTRIBUTE = r"^\s*+=\s*+([A-Za-z0-9:_.-]++)"


def _code_place(gap: Column, behind: Column) -> Column:
    """Place by the gaps around a token; null where the token before it decides."""
    back = F.reverse(gap)
    call = F.reverse(F.regexp_extract(back, _CALL, 1))
    return (F.when(back.rlike(_COMPARED) | behind.rlike(_COMPARES), "compare")
             .when(gap.rlike(_SAME_PLACE), F.lit(None).cast("string"))
             .when(back.rlike(_ATTRIBUTE), "attribute").when(back.rlike(_CASE), "case").when(back.rlike(_INDEX), "index")
             .when(call != "", F.concat(F.lit("call:"), call)).otherwise(""))


def _markup_place(gap: Column, behind: Column) -> Column:
    name = F.lower(F.reverse(F.regexp_extract(F.reverse(gap), _MARKUP_ATTRIBUTE, 1)))
    return F.when(name != "", F.concat(F.lit("attr:"), name)).otherwise("")


def token_contexts(gaps: Column, profile: str = "code") -> Column:
    """One place per token of a file: ``gaps`` is the array between and around its tokens."""
    place = _code_place if profile == "code" else _markup_place
    own = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g, i: place(g, gaps[i + 1]))

    # each place is repeated up to the next token that has one of its own; arrays are bound once, so this is linear
    def spread(own: Column) -> Column:
        n = F.size(own)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | own[i].isNotNull())
        return F.transform(F.array(starts), lambda starts: F.flatten(F.transform(starts, lambda s, k: F.array_repeat(
            F.coalesce(own[s], F.lit("")), F.coalesce(F.get(starts, k + 1), n) - s))))[0]

    return F.transform(F.array(own), lambda own: F.when(F.size(own) > 0, spread(own)).otherwise(own))[0]


def place_reason(context: Column) -> Column:
    """Why a literal at this place is not translatable; null where its text decides."""
    return (F.when(context.isin(*PLACES), F.concat(F.lit("context:"), context))
             .when(F.substring_index(context, ":", 1) == "call",
                   F.when(F.substring_index(context, ":", -1).isin(*LOOKUP_CALLS), "context:call"))
             .when(context.startswith("attr:"), F.when(~F.substring_index(context, "attr:", -1).isin(*TEXT_ATTRIBUTES), "context:attr")))
