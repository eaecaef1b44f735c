"""Date templates such as 'DD/MM/YYYY' or 'Do MMM YYYY', compiled to column expressions.

A template is read once on the driver; parsing and rendering are plain JVM expressions. Where a
table carries a template per row, the distinct ones become a constant map from the template to its
expression's parts, and one expression serves all rows, however many templates there are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.arrays import bound
from tallyweave.functions.text import _col, strip

# The template tokens, with the text each of them accepts.
TOKEN_PATTERNS = {
    "YYYY": r"(\d{4})",
    "MMMM": r"([A-Za-z]+)",
    "MMM": r"([A-Za-z]{3,})",
    "MM": r"(\d{2})",
    "DD": r"(\d{2})",
    "YY": r"(\d{2})",
    "Do": r"(\d{1,2})(?:st|nd|rd|th)",
    "dddd": r"([A-Za-z]+)",
    "M": r"(\d{1,2})",
    "D": r"(\d{1,2})",
}

# Strftime-style aliases accepted by the lenient dialect.
STRFTIME_ALIASES = {
    "%-d": "D", "%#d": "D", "%_d": "D", "%d": "DD", "%-e": "D", "%#e": "D", "%e": "D",
    "%-m": "M", "%#m": "M", "%_m": "M", "%m": "MM", "%B": "MMMM", "%b": "MMM",
    "%A": "dddd", "%a": "dddd", "%Y": "YYYY", "%y": "YY", "%%": "%",
}

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

PART_OF_TOKEN = {
    "YYYY": "year", "YY": "year", "MMMM": "month", "MMM": "month", "MM": "month", "M": "month",
    "DD": "day", "D": "day", "Do": "day",
}

_SCANNER = re.compile("|".join(TOKEN_PATTERNS))
_LENIENT_SCANNER = re.compile(r"\[([^\]]*)\]|" + "|".join(TOKEN_PATTERNS))
_ALIAS_SCANNER = re.compile("|".join(re.escape(a) for a in sorted(STRFTIME_ALIASES, key=len, reverse=True)))


@lru_cache(maxsize=1024)
def read_template(template: str, lenient: bool = True) -> tuple[tuple[str, object], ...]:
    """Split a template into ('token', name), ('text', literal) and ('optional', pieces)."""
    if lenient:
        template = _ALIAS_SCANNER.sub(lambda m: STRFTIME_ALIASES[m.group()], template)
    pieces: list[tuple[str, object]] = []
    position = 0
    for found in (_LENIENT_SCANNER if lenient else _SCANNER).finditer(template):
        if found.start() > position:
            pieces.append(("text", template[position : found.start()]))
        if lenient and found.group(1) is not None:
            pieces.append(("optional", read_template(found.group(1), lenient)))
        else:
            pieces.append(("token", found.group()))
        position = found.end()
    if position < len(template):
        pieces.append(("text", template[position:]))
    return tuple(pieces)


def _pattern(pieces: Iterable[tuple[str, object]], lenient: bool, tokens: list[str]) -> str:
    out = ""
    for kind, value in pieces:
        if kind == "token":
            tokens.append(str(value))
            out += TOKEN_PATTERNS[str(value)]
        elif kind == "optional":
            out += f"(?:{_pattern(value, lenient, tokens)})?"
        else:
            out += "".join(r"\s+" if lenient and ch == " " else re.escape(ch) for ch in str(value))
    return out


def template_regex(template: str, lenient: bool = True) -> tuple[str, list[str]]:
    """The regular expression of a template and the token of each of its groups."""
    tokens: list[str] = []
    body = _pattern(read_template(template, lenient), lenient, tokens)
    return ("(?i)" if lenient else "") + f"^{body}$", tokens


def parse_date(value: Column | str, template: str, lenient: bool = True, century_from: int = 100) -> Column:
    """DATE of a text under one template; null where it does not fit or is no real date.

    A month name that does not exist, or two tokens that disagree, give null. Two-digit years are
    2000 and later, except those from ``century_from`` on, which are 1900 and later.

    The text is rewritten once into year, month and day, and read from there: one replacement and
    one conversion, which stay cheap inside array functions.
    """
    text = strip(value)
    readings = [
        _read_date(text, {k: F.lit(v) for k, v in r.items()}, century_from) for r in _readings(template, lenient, century_from < 100)
    ]
    if not readings:
        return F.lit(None).cast("date")
    # Each reading of a part that occurs more than once must give the same date.
    if len(readings) == 1:
        return readings[0]
    distinct = F.array_distinct(F.filter(F.array(*readings), lambda d: d.isNotNull()))
    return F.when(F.size(distinct) == 1, F.get(distinct, 0))


def _readings(template: str, lenient: bool = True, early: bool = False) -> list[dict]:
    """How a text is rewritten into year, month and day, once for each choice of groups that give them."""
    regex, tokens = template_regex(template, lenient)
    groups = {part: [i for i, t in enumerate(tokens, start=1) if PART_OF_TOKEN.get(t) == part] for part in ("year", "month", "day")}
    out = []
    for year, month, day in product(groups["year"], groups["month"], groups["day"]):
        named = tokens[month - 1] in ("MMMM", "MMM")
        # The first three letters of a month's name decide; its group keeps just those.
        pattern = re.sub(r"\(\[A-Za-z\](?:\+|\{3,\})\)", "([A-Za-z]{3})[A-Za-z]*", regex) if named else regex
        rest = f"${year}-${month}-${day}"
        brief = tokens[year - 1] == "YY"
        out.append({"regex": pattern, "put": ("#20" if brief else "#") + rest, "early": "#19" + rest if brief and early else None, "named": named})
    return out


def _try_date(parts: Column, date: Column) -> Column:
    """``date`` of a text that was rewritten. One that does not fit keeps its form; to try it would end in two costly exceptions."""
    return F.when(parts.startswith("#"), date)


def _read_date(text: Column, reading: Column, century_from: int = 100) -> Column:
    """DATE of a text by one reading, a struct of ``_READING``."""

    def read(put: Column) -> Column:
        return bound(
            F.regexp_replace(text, reading["regex"], put),
            lambda parts: _try_date(parts, F.when(reading["named"], F.try_to_date(parts, "'#'yyyy-MMM-d")).otherwise(F.try_to_date(parts, "'#'yyyy-M-d"))),
        )

    if century_from >= 100:
        return read(reading["put"])
    late = lambda date: reading["early"].isNotNull() & (F.year(date) % 100 >= century_from)
    return bound(read(reading["put"]), lambda date: F.when(late(date), read(reading["early"])).otherwise(date))


_READING = "regex: string, put: string, early: string, named: boolean"
_PLAN = f"map<string, struct<readings: array<struct<{_READING}>>, guard: string, render: string>>"
_ORDINAL = "\u0001"  # stands for st, nd, rd or th in a rendered text


def _plan_of(template: Column | str, templates: Iterable[str], lenient: bool, loose: bool = False) -> tuple[Column, int]:
    """The parts of the row's template, from a constant map, and how many readings a template has at most."""
    plans = {}
    for name in templates:
        wide, guard = _loose_form(name) if loose else (name, None)
        plans[name] = {"readings": _readings(wide, lenient, loose), "guard": guard, "render": _render_pattern(read_template(name, lenient))}
    most = max([1, *(len(p["readings"]) for p in plans.values())])
    return F.try_element_at(F.from_json(F.lit(json.dumps(plans)), _PLAN), _col(template)), most


def _read_planned(text: Column, plan: Column, most: int, century_from: int = 100) -> Column:
    """DATE of a text by the readings of a plan; those that fit must agree."""
    readings = [_read_date(text, F.get(plan["readings"], i), century_from) for i in range(most)]
    if most == 1:
        return readings[0]
    distinct = F.array_distinct(F.filter(F.array(*readings), lambda d: d.isNotNull()))
    return F.when(F.size(distinct) == 1, F.get(distinct, 0))


def generic_date(value: Column | str) -> Column:
    """DATE of an ISO text, whatever follows the date; null otherwise."""
    iso = (
        r"^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{4})-(\d{2})-(\d{2}).*|(\d{4})(\d{2})(\d{2})(?:[T ].*)?)$"
    )
    rewritten = F.regexp_replace(strip(value), iso, "#$1$4$7-$2$5$8-$3$6$9")
    return bound(rewritten, lambda parts: _try_date(parts, F.try_to_date(parts, "'#'yyyy-M-d")))


# The template tokens in the pattern language of date_format.
_JAVA_PATTERNS = {
    "YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M",
    "DD": "dd", "D": "d", "Do": "d", "dddd": "EEEE",
}


def _render_pattern(pieces: Iterable[tuple[str, object]]) -> str:
    """The date_format pattern of a template; an ordinal's ending is a mark to be replaced."""
    parts: list[tuple[bool, str]] = []

    def add(quoted: bool, text: str) -> None:
        if quoted and parts and parts[-1][0]:
            parts[-1] = (True, parts[-1][1] + text)
        else:
            parts.append((quoted, text))

    def walk(inner: Iterable[tuple[str, object]]) -> None:
        for kind, value in inner:
            if kind == "optional":
                walk(value)
            elif kind == "text":
                add(True, str(value))
            else:
                add(False, _JAVA_PATTERNS[str(value)])
                if value == "Do":
                    add(True, _ORDINAL)

    walk(pieces)
    return "".join("'" + text.replace("'", "''") + "'" if quoted else text for quoted, text in parts)


def _render(date: Column, pattern: Column) -> Column:
    day = F.dayofmonth(date)
    ending = (
        F.when(day.between(10, 20), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    )
    text = F.call_function("date_format", date, pattern)
    return F.when(F.contains(text, F.lit(_ORDINAL)), F.replace(text, F.lit(_ORDINAL), ending)).otherwise(text)


def render_date(date: Column, template: str, lenient: bool = True) -> Column:
    """Text of a DATE under one template."""
    return _render(date, F.lit(_render_pattern(read_template(template, lenient))))


def _loose_form(template: str) -> tuple[str, str | None]:
    """A template with one- or two-digit days and months, and what its text must hold where it names the month."""
    wide = re.sub(r"MM|DD", lambda found: found.group()[0], re.sub("MMMM|MMM", "@", template.upper()))
    names = MONTH_NAMES if "MMMM" in template.upper() else MONTHS if "MMM" in template.upper() else None
    return wide.replace("@", "MMM"), rf"(?i)(^|[^a-z])({'|'.join(names)})($|[^a-z])" if names else None


def _spelled_date(text: Column) -> Column:
    spellings = "|".join((*MONTH_NAMES, *MONTHS, "sept"))
    return F.when(text.rlike(rf"(?i)^\s*\d{{1,2}}\s+({spellings})\s+\d{{4}}\s*$"), parse_date(text, "D MMM YYYY"))


def loose_date(value: Column | str, template: str | None) -> Column:
    """strptime-like reading of a template, then 'D Month YYYY'.

    Without a template: ISO, dd/mm/yy, dd/mm/yyyy, yyyy/mm/dd and dd-mm-yyyy in that order. One or
    two digits do for a day or month, and two-digit years from 69 on belong to the last century.
    """
    text = _col(value)
    if not template:
        plain = ("YYYY-M-D", "D/M/YY", "D/M/YYYY", "YYYY/M/D", "D-M-YYYY")
        return F.coalesce(*[parse_date(text, t, century_from=69) for t in plain])
    wide, guard = _loose_form(template)
    main = parse_date(text, wide, century_from=69)
    return F.coalesce(F.when(text.rlike(guard), main) if guard else main, _spelled_date(text))


def templates_of(df: DataFrame, column: str) -> list[str]:
    """The distinct non-blank templates of a column, short strings that number far below the rows."""
    rows = df.select(F.col(column).alias("t")).where(F.coalesce(F.col("t"), F.lit("")) != "").distinct().collect()
    return sorted(r.t for r in rows)


def parse_by_template(
    value: Column | str, template: Column | str, templates: Iterable[str], lenient: bool = True
) -> Column:
    """DATE of a text under the template in another column."""
    plan, most = _plan_of(template, templates, lenient)
    # A template is searched for among all of them: once a row.
    return bound(plan, lambda plan: _read_planned(strip(value), plan, most))


def loose_by_template(value: Column | str, template: Column | str, templates: Iterable[str]) -> Column:
    """DATE of a text as ``loose_date`` reads it, under the template in another column."""
    text = _col(value)
    plan, most = _plan_of(template, templates, True, loose=True)

    def read(plan: Column) -> Column:
        main = _read_planned(strip(text), plan, most, century_from=69)
        guarded = F.when(plan["guard"].isNull() | F.rlike(text, plan["guard"]), main)
        return F.when(plan.isNotNull(), F.coalesce(guarded, _spelled_date(text)))

    return bound(plan, read)


def coerce_by_template(
    value: Column | str, template: Column | str, templates: Iterable[str], lenient: bool = True
) -> Column:
    """Template first, then any ISO date."""
    return F.coalesce(parse_by_template(value, template, templates, lenient), generic_date(value))


def render_by_template(
    date: Column, template: Column | str, templates: Iterable[str], lenient: bool = True
) -> Column:
    """Text of a DATE under the template in another column; ISO where the template is blank."""
    plan, _ = _plan_of(template, templates, lenient)
    return _render(date, F.coalesce(plan["render"], F.lit("yyyy-MM-dd")))


def epoch_timestamp(value: Column | str) -> Column:
    """TIMESTAMP of epoch seconds, epoch milliseconds (above 1e11) or ISO text in UTC."""
    text = strip(_col(value).cast("string"))
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    from_number = F.timestamp_micros(F.floor(seconds * 1000000).cast("bigint"))
    return F.when(number.isNotNull(), from_number).otherwise(F.try_to_timestamp(text))


def character_mask(value: Column | str) -> Column:
    """Every letter and digit becomes 'A'; other characters stay."""
    return F.regexp_replace(_col(value), r"[\p{L}\p{N}]", "A")
