"""Dates in texts: found by format, labelled by the nearest phrase, and resolved against a given day."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.scalar import MONTHS

#: What a word before or after a date says about it (fixed values). Words may go on: ``expire`` holds in ``expires``.
LABELS = {
    "effective_date": ("effective", "eff"),
    "end_date": ("expire", r"end date", r"ends\b", "through"),
    "last_updated_date": ("updated", "updates", "revision", "revised", "revis", r"rev\.", "current", "version", r"last res\.", "revisado"),
    "last_reviewed_date": ("reviewed", "last review", "recent review", "latest review"),
    "next_review_date": ("next review", "annual review"),
    "next_update_date": ("next update",),
    "published_date": ("publish", "posted", "print date", r"v\.", "devised", "issued", "date of origin", "implementation", "publication date", "origination"),
}
FUTURE = frozenset({"end_date", "next_review_date", "next_update_date"})
#: Letters before a date in which a label comes first, and those behind it in which one counts.
LEFT, RIGHT = 50, 20
#: Words of a text that are its heading: dates there need no label, and a year alone is a date.
HEADING = 20
#: The newest dates that are told (fixed value).
IDENTIFIED = 25

_PHRASES = sorted(((p, label) for label, phrases in LABELS.items() for p in phrases), key=lambda x: -len(x[0]))
_LABEL = re.compile("|".join(rf"(?P<l{i}>\b{p})" for i, (p, _) in enumerate(_PHRASES)), re.I)
_SHORT = "|".join(m[:3] for m in MONTHS)
_NAME = rf"(?P<name>(?:{'|'.join(MONTHS)})|(?:{_SHORT}|Sept)\b\.?)"
_DAY, _YEAR, _SEP = r"(?P<d>\d\d?)(?:st|nd|rd|th)?", r"(?P<y>\d{4})", r"[/\-.|]"
_ALONE = r"(?<![\d/\-.|])", r"(?![\d/]|[\-.|]\d)"
_WHOLE = r"(?<![\d/])", r"(?![\d/])"
#: The formats in the order in which they are tried; a place belongs to the first that fits and is a date.
_FORMATS = {
    "y_name": rf"(?<![\w/])(?P<y>\d{{4}})(?P<name>{_SHORT})(?![\w/])",
    "ymd": rf"{_WHOLE[0]}(?P<y>\d{{4}}){_SEP}(?P<m>\d\d?){_SEP}(?P<d>\d\d?){_WHOLE[1]}",
    "mdy": rf"{_WHOLE[0]}(?P<m>\d\d?){_SEP}+(?P<d>\d\d?){_SEP}(?P<y>\d{{4}}|\d\d){_WHOLE[1]}",
    "name_dy": rf"\b{_NAME}\s+{_DAY},?\s+{_YEAR}\b",
    "d_name_y": rf"(?<!\w){_DAY}\s+{_NAME},?\s+{_YEAR}\b",
    "name_y": rf"\b{_NAME},?\s+{_YEAR}(?!\d)",
    "name_d": rf"\b{_NAME},?\s+{_DAY}(?!\d|\s*,?\s*\d{{4}})",
    "my": rf"{_ALONE[0]}(?P<m>\d\d?)\s?{_SEP}(?P<y>\d{{4}}){_ALONE[1]}",
    "m_short": rf"{_ALONE[0]}(?P<m>\d\d?){_SEP}(?P<y>\d\d){_ALONE[1]}",
    "digits": r"(?<!\d)(?P<n>\d{8}|\d{6})(?!\d)",
    "year": rf"{_ALONE[0]}(?P<y>\d{{4}})(?!\w)(?!{_SEP}\d)",
}
_PATTERNS = {kind: re.compile(p, re.I) for kind, p in _FORMATS.items()}
_UNIT = re.compile(r"[$%]|mg|ml|oz", re.I)
_DASH = re.compile(r"\s*[-–—\xad]\s*")
_LIST = re.compile(r"\s*(?:[,;&]\s*(?:and\b|or\b)?|and\b|or\b)\s*")
_REFERENCES = re.compile(r"[^a-z]*references[^a-z]*", re.I)
_QUARTER = re.compile(r"\bQ(?P<a>[1-4])\b|\b(?P<b>[1-4])(?:st|nd|rd|th)\s+(?:quarter|qtr)|\b(?P<c>first|second|third|fourth)\s+(?:quarter|qtr)|\b(?:quarter|qtr)\.?\s+(?P<e>[1-4])\b", re.I)
_ORDINALS = ("first", "second", "third", "fourth")


def _day(year: int, month: int, day: int, last_year: int) -> date | None:
    try:
        return date(year, month, day) if 1980 < year <= last_year else None
    except ValueError:
        return None


def _digits(n: str, last_year: int) -> date | None:
    """Six digits: month and year, year and month, or month, day and short year; eight: month first, else year first."""
    parts = [(n[2:], n[:2], "1"), (n[:4], n[4:], "1"), ("20" + n[4:], n[:2], n[2:4])] if len(n) == 6 else [(n[4:], n[:2], n[2:4]), (n[:4], n[4:6], n[6:])]
    return next((found for y, m, d in parts if (found := _day(int(y), int(m), int(d), last_year))), None)


def _value(kind: str, m: re.Match, line: str, last_year: int) -> date | None:
    g = m.groupdict()
    if kind == "digits":
        return _digits(g["n"], last_year)
    if kind == "m_short" and _UNIT.search(line[max(0, m.start() - 6) : m.start()] + " " + line[m.end() : m.end() + 6]):
        return None
    month = next(i for i, name in enumerate(MONTHS, 1) if name[:3].lower() == g["name"][:3].lower()) if g.get("name") else int(g.get("m") or 1)
    year = g.get("y")
    if year is None:  # a month and a day take the year of the date behind their dash
        dash = _DASH.match(line, m.end())
        after = [x for x in found_dates(line[dash.end() :], last_year) if x[0] == 0] if dash else []
        return _day(after[0][2].year, month, int(g["d"]), last_year) if after else None
    return _day(int(year) + (2000 if len(year) == 2 else 0), month, int(g.get("d") or 1), last_year)


def found_dates(line: str, last_year: int = 2099, heading: bool = True) -> list[tuple[int, int, date]]:
    """(start, end, date) of a line's dates after 1980, left to right. A year alone counts in a heading without other dates."""
    taken, out = bytearray(len(line)), []
    if not any(c.isdigit() for c in line):
        return out
    for kind, pattern in _PATTERNS.items():
        if kind == "year" and (out or not heading):
            continue
        for m in pattern.finditer(line):
            if not any(taken[m.start() : m.end()]) and (value := _value(kind, m, line, last_year)):
                out.append((m.start(), m.end(), value))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return sorted(out)


def quarter_dates(line: str, last_year: int) -> list[date]:
    """The first days of the quarters that a line names beside a year: the next one behind it, else the first of the line."""
    years = [(m.start(), int(m[0])) for m in re.finditer(r"(?<![\d/\-.])\d{4}(?![\d/\-.]\d?)", line)]
    out = []
    for m in _QUARTER.finditer(line) if years else ():
        number = int(m["a"] or m["b"] or m["e"] or _ORDINALS.index(m["c"].lower()) + 1)
        year = next((y for at, y in years if at >= m.end()), years[0][1])
        out.append(_day(year, number * 3 - 2, 1, last_year))
    return [d for d in out if d]


def _label(text: str, nearest_end: bool) -> str | None:
    """The label nearest to the text's end, or to its start."""
    found = list(_LABEL.finditer(text))
    if not found:
        return None
    m = max(found, key=lambda m: m.end()) if nearest_end else found[0]
    return _PHRASES[int(m.lastgroup[1:])][1]


class _Found:
    """The dates of one text as they are read."""

    def __init__(self, today: date):
        self.today, self.best, self.heading, self.identified = today, {}, [], set()

    def add(self, label: str, value: date, near: bool) -> None:
        """A nearer label goes before a farther one; else ends take the earliest, effective dates the nearest, others the latest that is past."""
        if label != "effective_date" and label not in FUTURE and value > self.today:
            return
        old = self.best.get(label)
        if old and old[1] != near:
            better = near
        elif not old:
            better = True
        elif label in FUTURE:
            better = value < old[0]
        elif label == "effective_date":
            better = abs((self.today - value).days) < abs((self.today - old[0]).days)
        else:
            better = value > old[0]
        if better:
            self.best[label] = (value, near)


def extract_dates(text: str, today: date, label_texts: tuple[str, ...] = ()) -> dict:
    """The labelled dates of a text, and its newest dates (``identified_dates``, sorted, distinct).

    A label stands before a date on its line (up to LEFT letters away it comes first), up to RIGHT letters behind it, or on the
    line before, behind that line's last date; dates of a list share the label of the first. Two dates joined by a dash
    are an effective and an end date. A line that ends in a comma goes on in the next. Lines about form approvals are
    skipped, and nothing is read behind the heading of references. Without an effective date, one of ``label_texts`` counts,
    else one of the heading without a label, else the only date there is.
    """
    last_year = today.year + 1
    found, words, before, before_end = _Found(today), 0, "", 0
    for line in text.split("\n"):
        if _REFERENCES.fullmatch(line):
            break
        if "omb approval" in line.lower():
            before, before_end = "", 0
            continue
        if before.endswith(","):
            line, offset = f"{before} {line}", before_end
        else:
            offset = 0
        quarters = quarter_dates(line, last_year)
        found.heading += quarters
        found.identified.update(quarters)
        last, last_near, last_end, spanned = None, False, offset, -1
        dates = [x for x in found_dates(line, last_year, words < HEADING and not quarters) if x[0] >= offset]
        for n, (start, end, value) in enumerate(dates):
            found.identified.add(value)
            following = dates[n + 1] if n + 1 < len(dates) else None
            if following and _DASH.fullmatch(line[end : following[0]]):
                found.add("effective_date", value, True)
                found.add("end_date", following[2], True)
                spanned = following[0]
            elif start != spanned:
                near = _label(line[max(last_end, start - LEFT) : start], True)
                listed = last if last and _LIST.fullmatch(line[last_end:start]) else None
                label = near or listed or _label(line[last_end:start], True)
                behind = None if label else _label(line[end : end + RIGHT], False) or _label(before[before_end:], True)
                if label or behind:
                    last_near = bool(near or behind or offset or (listed and last_near))
                    found.add(label or behind, value, last_near)
                elif words < HEADING:
                    found.heading.append(value)
                last = label or behind
            last_end = end
        words += len(line.split(" "))
        if line:
            before, before_end = line, last_end
    out: dict = {label: found.best[label][0] if label in found.best else None for label in LABELS}
    if out["effective_date"] is None:
        told = [d for t in label_texts for _, _, d in found_dates(t, last_year)] or found.heading or (list(found.identified) if len(found.identified) == 1 else [])
        told = [d for d in told if d != out["end_date"]]
        out["effective_date"] = min(told, key=lambda d: abs((today - d).days), default=None)
        found.identified.update(told)
    out["identified_dates"] = sorted(found.identified)[-IDENTIFIED:]
    return out


SCHEMA = ", ".join(f"{k}: date" for k in LABELS) + ", identified_dates: array<date>"


def labelled_dates(text: Column | str, as_of: str, label_text: Column | str | None = None) -> Column:
    """The dates of ``text`` as a struct, resolved against the day ``as_of``; null texts have none.

    ``label_text`` is a title or link that may tell the effective date. Texts without two digits together are not sent to Python.
    """
    today = date.fromisoformat(as_of)
    text = F.col(text) if isinstance(text, str) else text
    kind = f"struct<{SCHEMA.replace(': ', ':')}>"

    def run(texts: pd.Series, more: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_dates(t or "", today, (m,) if m else ()) for t, m in zip(texts, more, strict=True)], columns=[*LABELS, "identified_dates"])

    more = F.coalesce(F.col(label_text) if isinstance(label_text, str) else label_text, F.lit("")) if label_text is not None else F.lit("")
    none = F.struct(*[F.lit(None).cast("date").alias(k) for k in LABELS], F.array().cast("array<date>").alias("identified_dates"))
    empty = ~(F.coalesce(text, F.lit("")).rlike("[0-9]") | more.rlike("[0-9]"))
    return F.when(empty, none).otherwise(F.pandas_udf(run, kind)(F.when(~empty, text), more))
