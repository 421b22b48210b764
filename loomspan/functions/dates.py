"""What counts as a date: one grammar for the library.

A month is a name or its usual abbreviation, with or without a dot; a day has
one or two digits and may have an ordinal's ending; a year is of the twentieth
or twenty-first century. Numeric dates are parted by hyphens or slashes.
"""

from __future__ import annotations

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "(?i:sept|" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r")\.?"
DAY, YEAR = r"[0-3]?[0-9](?i:st|nd|rd|th)?", r"(?:19|20)[0-9]{2}"
_NUMBER = "[0-3]?[0-9]"

#: The order in which the forms are tried, whatever stands first in the text.
ORDER = ("month day year", "month year", "day month year", "year-month-day", "day-month-year")

_WRITTEN = {
    "month day year": rf"{MONTH}\s+{DAY},?\s+{YEAR}",
    "month year": rf"{MONTH},?\s+{YEAR}",
    "day month year": rf"{DAY}\s+{MONTH},?\s+{YEAR}",
    "year-month-day": f"{YEAR}[-/]{_NUMBER}[-/]{_NUMBER}",
    "day-month-year": f"{_NUMBER}[-/]{_NUMBER}[-/]{YEAR}",
}
FORMS = tuple(rf"\b{_WRITTEN[name]}\b" for name in ORDER)
#: Forms that a spoken or sortable date has, without their boundaries.
SPOKEN = "|".join(_WRITTEN[name] for name in ORDER[:4])
