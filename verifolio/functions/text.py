"""Text functions as Column expressions.

Whitespace is Unicode's, as a character class that Spark's and DuckDB's matchers read
alike; Spark's own ``trim`` and ``\\s`` know only ASCII. A derived text that a lambda uses
goes through ``let``: else the optimizer copies its whole expression into the lambda and
computes it again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One whitespace character.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: One line end.
EOL = r"\r\n|[\x0A-\x0D\x1C-\x1E\x85\u2028\u2029]"
#: Whitespace that ends no line.
BLANKS = r"[\x09\x1F\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]"
# Characters that count as the ASCII one beside them.
FOLD_FROM = (
    "\u2018\u2019\u201B\u2032"
    "\u201C\u201D\u201E\u2033"
    "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
    "\u00A0\u2007\u202F"
)
FOLD_TO = "''''" + '""""' + "-------" + "   "
ELLIPSIS = "\u2026"
# Signs that begin a list item.
BULLETS = " \u2022\u25E6\u25AA-\u2013\t"
#: Words up to this length say too little to be looked for.
SHORT = 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def blank(text: Column) -> Column:
    """Whether nothing but whitespace is there; null counts as empty."""
    return F.length(collapse(F.coalesce(text, F.lit("")))) == 0


def folded(text: Column) -> Column:
    """Folds typographic punctuation."""
    plain = F.replace(F.translate(text, FOLD_FROM, FOLD_TO), F.lit(ELLIPSIS), F.lit("..."))
    # looking for the characters is much cheaper than translating every one
    return F.when(F.rlike(text, F.lit(f"[{FOLD_FROM}{ELLIPSIS}]")), plain).otherwise(text)


def normalize(text: Column) -> Column:
    """Folds typographic punctuation, collapses whitespace, lower-cases."""
    return F.lower(collapse(folded(text)))


def flat(text: Column) -> Column:
    """The text with its line ends, else normalised: a line of it, trimmed, is what its
    normalised line is, and the whole was folded and lower-cased at once."""
    return F.lower(F.regexp_replace(folded(text), BLANKS + "+", " "))


def squash(text: Column) -> Column:
    """The normalised text without blanks."""
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def words(normalized: Column, longer_than: int = 0) -> Column:
    """The words of a normalised text, with duplicates."""
    return F.filter(F.split(normalized, " "), lambda w: F.length(w) > longer_than)


def lines(text: Column) -> Column:
    """Lines by every Unicode line end; an empty last one stays, and all uses drop blanks."""
    return F.split(text, EOL)


def unescape(text: Column) -> Column:
    """Line ends and tabs that were spelled out with a backslash."""
    out = F.replace(text, F.lit("\\r\\n"), F.lit("\n"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\t"), F.lit("\t"))


def list_items(text: Column) -> Column:
    """The items of a list block, without their signs; a text without any is one item."""
    items = F.filter(F.transform(lines(unescape(text)), lambda x: F.btrim(x, F.lit(BULLETS))), lambda x: x != "")
    return let(items, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))


def percent(share: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def preview(items: Column, most: int, separator: str, cut: int | None = None) -> Column:
    """The first items, shortened, and how many more there are."""
    shown = F.slice(items, 1, most)
    if cut:
        shown = F.transform(shown, lambda x: F.substring(x, 1, cut))
    more = F.when(F.size(items) > most, F.concat(F.lit(" (+"), (F.size(items) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(shown, separator), more)


def contained(needle: Column, squashed: Column) -> Column:
    """Whether a text is in another one, spacing aside. Taking blanks out of both keeps
    containment, so the test on the unsquashed texts would add nothing."""
    return F.contains(squashed, squash(needle))


def padded(row: Column, width: Column) -> Column:
    """A row cut or filled up with empty cells to a width."""
    return F.slice(F.concat(row, F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda _: F.lit(""))), F.lit(1), F.greatest(width, F.lit(0)))
