"""Amount rules: text to DECIMAL(38,10), and back to display text.

Each rule answers null where the text is not an amount under that rule. The rules differ
on purpose; they belong to different steps (extraction, display, comparison, evidence).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import bound
from tallyweave.functions.text import _col, strip

AMOUNT_TYPE = "decimal(38,10)"

# Fixed value: a currency mark of up to three letters or symbols before the number.
CURRENCY_PREFIX = r"^[A-Za-z€$£¥₹]{1,3}\s*"


# What a cast to a decimal may be able to read; it drops control characters and blanks at both ends.
_NUMBER = r"^[\x00-\x20]*+[+-]?(?:\p{Nd}++(?:\.\p{Nd}*+)?|\.\p{Nd}++)(?:[eE][+-]?\p{Nd}++)?[\x00-\x20]*+$"


def _parse(text: Column) -> Column:
    # To try a text that is no number would end in an exception, which costs more than all replacements.
    return bound(text, lambda t: F.when(t.rlike(_NUMBER), t.try_cast(AMOUNT_TYPE)))


# Each rule is one chain of replacements in which every step reads its input once. Inside array
# functions Spark evaluates an expression as often as it is written, so chains matter.


def _one_decimal_point(text: Column, noise: str = "") -> Column:
    """Rewrite a number so that '.' is its decimal point and no group mark is left.

    The last of '.' and ',' is the decimal point when at most two characters follow it; a second
    one of the same kind then makes the text unreadable. Otherwise every '.' and ',' is a group
    mark. ``noise`` lists characters to drop as well.
    """
    comma_point = F.regexp_replace(text, r",([^.,]{0,2})$", "#$1")
    dot_point = F.regexp_replace(comma_point, r"\.([^.,#]{0,2})$", "@$1")
    doubtful = F.regexp_replace(dot_point, r"^(?=.*#)(?=.*,).*$|^(?=.*@)(?=.*\.).*$", "?")
    return F.translate(doubtful, "#@,." + noise, "..")


def coerce_amount(value: Column | str) -> Column:
    """Plain number after dropping commas and spaces."""
    return _parse(strip(F.translate(_col(value), ", ", "")))


def convert_amount(value: Column | str) -> Column:
    """Extracted cell: currency prefix, trailing or leading minus, parentheses, separator rule."""
    text = strip(F.regexp_replace(strip(value), CURRENCY_PREFIX, ""))
    minus_last = F.regexp_replace(text, r"^(.*?)\s*-$", "-$1")
    in_parens = F.regexp_replace(minus_last, r"^\(\s*(.*?)\s*\)$", "-$1")
    # A sign before the sign turns it round; blanks after it do not matter.
    signed = F.regexp_replace(in_parens, r"^(?:--|(-)\s*)", "$1")
    return _parse(_one_decimal_point(signed, " '"))


def display_amount(value: Column | str) -> Column:
    """Displayed cell: everything but digits, '-', '.' and ',' is ignored.

    Parentheses are dropped before they could mean a negative amount, so '(126.50)' is 126.50.
    """
    kept = F.regexp_replace(_col(value), r"[^\d\-.,]", "")
    return _parse(_one_decimal_point(F.regexp_replace(kept, r"^([^-].*)-$", "-$1")))


def compare_amount(value: Column | str) -> Column:
    """Comparison only: commas are dropped, nothing else is interpreted."""
    return _parse(F.translate(F.regexp_replace(_col(value), r"[^\d\-.,]", ""), ",", ""))


def evidence_amount(value: Column | str) -> Column:
    """Evidence of a debit or credit: parentheses mean negative, a doubled point is one point."""
    kept = F.regexp_replace(_col(value), r"[^0-9\-.,()]", "")
    signed = F.regexp_replace(kept, r"^(?=.*\()(?=.*\))(?!.*-)", "-")
    return _parse(F.replace(F.translate(signed, "(),", ""), F.lit(".."), F.lit(".")))


def has_amount(value: Column | str) -> Column:
    return F.coalesce(evidence_amount(value) != 0, F.lit(False))


def marked_amount(value: Column | str) -> Column:
    """Amount with a currency mark anywhere: 'R 1,234.56', '(R 1,234.56)'."""
    plain = strip(F.translate(_col(value), ", ", ""))
    no_letters = strip(F.regexp_replace(plain, r"[A-Za-z]", ""))
    kept = F.regexp_replace(F.regexp_replace(no_letters, r"^(\(.*\))$", "~$1"), r"[^0-9.+\-~]", "")
    minus = F.regexp_replace(kept, r"^(?:~[-+]?|-)", "~")
    # Of a text without digits, such as the name of a header, no replacement makes a number.
    return F.when(_col(value).rlike(r"\p{Nd}"), F.coalesce(_parse(plain), _parse(F.translate(minus, "~+-", "-"))))


def format_amount(number: Column) -> Column:
    """1234.5 -> '1,234.50'."""
    return F.format_number(number, 2)


def render_amount(value: Column | str) -> Column:
    """Display text of a cell; blank stays blank, and text that is no amount stays as it is."""
    number = display_amount(value)
    return F.coalesce(format_amount(number), _col(value), F.lit(""))


AMOUNT_RULES = {
    "coerce": coerce_amount,
    "convert": convert_amount,
    "decimal": display_amount,
    "compare": compare_amount,
    "evidence": evidence_amount,
    "marked": marked_amount,
}
