"""Differences of two texts: an edit script over words or lines, its sections with their places, and what is kept out of it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.dates import LABELS, found_dates
from docloom.functions.editscript import changes, common_run

KEPT, GONE, COME = 0, -1, 1
#: Characters that a word loses if special ones are not compared.
SPECIAL = re.compile(r"[^\w%<>= ]")
#: The share of the shorter section that a common run of characters must be, to be taken out of both.
SAME_SHARE = 0.95
_LABEL = re.compile("|".join(rf"{phrase}$" for phrases in LABELS.values() for phrase in phrases) + "|(?:updated|effective|revised|reviewed|published)[:]?$", re.I)


def word_tokens(text: str, plain: bool = False) -> list[str]:
    """Lower-case words, each with the one white space behind it as a space; ``plain`` takes special characters off."""
    words = [w for w in re.findall(r"\S*\s|\S+$", re.sub(r"\s", " ", text.lower())) if w != " "]
    if not plain:
        return words
    bare = [SPECIAL.sub("", w) for w in words]
    return [b if b.strip() else w for b, w in zip(bare, words, strict=True)]


def edit_script(a: list[str], b: list[str]) -> list[tuple[int, str]]:
    """(kind, text) of the least script from one list of tokens to the other: kept, gone and come, gone first where both stand at one place."""
    out, at = [], 0
    for i, j, k, m in [*changes(a, b), (len(a), len(a), len(b), len(b))]:
        out += [(kind, "".join(part)) for kind, part in ((KEPT, a[at:i]), (GONE, a[i:j]), (COME, b[k:m])) if part]
        at = j
    return out


def sections(script: list[tuple[int, str]], pages: bool = True) -> list[dict]:
    """The script's changes: kind, text, char_spans, word_spans (page, start, end) and whether the text changed in several places.

    Equal texts of one kind are one section with all their places. Places count in that text which the change is of. Pages
    end with form feeds; without ``pages`` their number is null.
    """
    found: dict[tuple[int, str], dict] = {}
    place = {side: {"char": 0, "page": 0, "word": 0} for side in (GONE, COME)}
    for kind, text in script:
        for side in (GONE, COME):
            if kind == -side:
                continue
            at, spans = place[side], []
            first = at["char"]
            for i, part in enumerate(text.split("\f")):
                if i:
                    at["page"], at["word"] = at["page"] + 1, 0
                n = len(part.split())
                spans.append({"page": at["page"] if pages else None, "start": at["word"], "end": at["word"] + n})
                at["word"] += n
            at["char"] += len(text)
            if kind == side and text.strip("\n"):
                section = found.setdefault((kind, text), {"kind": kind, "text": text, "char_spans": [], "word_spans": [], "repeated": False})
                section["repeated"] = bool(section["char_spans"])
                section["char_spans"].append({"start": first, "end": at["char"]})
                section["word_spans"] += spans
    return list(found.values())


def without_words(spans: list[dict], start: int, length: int) -> list[dict]:
    """``spans`` without the words from ``start`` on, counted over all of them; spans without a page are left alone."""
    out, at = [], 0
    for span in spans:
        n = span["end"] - span["start"]
        low, high = max(start - at, 0), min(start + length - at, n)
        at += n
        if span["page"] is None or low >= high:
            out.append(span)
            continue
        if low > 0:
            out.append({**span, "end": span["start"] + low})
        if high < n:
            out.append({**span, "start": span["start"] + high})
    return out


def _words_in(text: str, start: int, size: int) -> tuple[int, int]:
    """The first word that stands whole in a run of characters, and how many do."""
    whole = [n for n, word in enumerate(re.finditer(r"\S+", text)) if start <= word.start() and word.end() <= start + size]
    return (whole[0], len(whole)) if whole else (0, 0)


def without_moves(found: list[dict], share: float = SAME_SHARE) -> list[dict]:
    """Sections in which a run of characters that went at one place and came at the next is no change any more; its words leave both."""
    gone, come = ([s for s in found if s["kind"] == kind] for kind in (GONE, COME))
    used: set[int] = set()
    for i, new in enumerate(come):
        for j in (i - 1, i):
            if not 0 <= j < len(gone) or j in used:
                continue
            same = common_run(gone[j]["text"], new["text"], share)
            if same:
                for section, start in ((gone[j], same[0]), (new, same[1])):
                    section["word_spans"] = without_words(section["word_spans"], *_words_in(section["text"], start, same[2]))
                used.add(j)
    return [s for s in found if s["word_spans"]]


@lru_cache(1 << 16)
def is_noise(word: str, digits: bool = False) -> bool:
    """Whether a word is a date, a label of dates, one special character or, if ``digits``, a number."""
    own = word.strip()
    return bool(own) and bool(found_dates(own) or (digits and re.fullmatch(r"\d+", own)) or SPECIAL.fullmatch(own) or _LABEL.match(own))


def without_noise(text: str, digits: bool = False) -> str:
    """The text with such words blanked; empty lines go."""
    blank = lambda line: " ".join(" " * len(w) if is_noise(w, digits) else w for w in line.split(" "))
    return "\f".join("\n".join(blank(line) for line in page.split("\n") if line) for page in text.split("\f"))


def without_repeats(a: str, b: str) -> tuple[str, str]:
    """Both texts with the changes blanked that stand in several places of one side, by lines."""
    script = edit_script(a.splitlines(keepends=True) if "\f" not in a else re.findall(r"[^\n]*\n|[^\n]+$", a), re.findall(r"[^\n]*\n|[^\n]+$", b))
    out = {GONE: list(a), COME: list(b)}
    for section in sections(script):
        for span in section["char_spans"] if section["repeated"] else ():
            out[section["kind"]][span["start"] : span["end"]] = " " * (span["end"] - span["start"])
    return "".join(out[GONE]), "".join(out[COME])


_SPAN = "page:int,start:int,end:int"
SECTION = f"struct<kind:int,text:string,char_spans:array<struct<start:int,end:int>>,word_spans:array<struct<{_SPAN}>>,repeated:boolean>"
#: Pairs of texts that a task holds compared as Python objects at once.
PAIRS = 64


def _compared(run: Callable[[str, str], object], kind: str, old: Column | str, new: Column | str) -> Column:
    """``run`` on two texts as a column of ``kind``, a few pairs at once; a null text is empty."""
    whole = _arrow(kind)

    def rows(old: pa.Array, new: pa.Array) -> pa.Array:
        found = [pa.array([], whole)]
        for at in range(0, len(old), PAIRS):
            pairs = zip(old.slice(at, PAIRS).to_pylist(), new.slice(at, PAIRS).to_pylist(), strict=True)
            found.append(pa.array([run(a or "", b or "") for a, b in pairs], whole))
        return pa.concat_arrays(found)

    return F.arrow_udf(rows, kind)(old, new)


def _arrow(kind: str) -> pa.DataType:
    span = [pa.field("start", pa.int32()), pa.field("end", pa.int32())]
    section = [("kind", pa.int32()), ("text", pa.string()), ("char_spans", pa.list_(pa.struct(span))), ("word_spans", pa.list_(pa.struct([pa.field("page", pa.int32()), *span]))), ("repeated", pa.bool_())]
    return {_SCRIPT: pa.list_(pa.struct(section[:2])), _SECTIONS: pa.list_(pa.struct(section)), _PAIR: pa.struct([("old", pa.string()), ("new", pa.string())])}[kind]


_SCRIPT, _SECTIONS, _PAIR = "array<struct<kind:int,text:string>>", f"array<{SECTION}>", "struct<old:string,new:string>"


def word_script(old: Column | str, new: Column | str, plain: bool = False) -> Column:
    """The edit script over words between two texts; a null text is empty."""
    return _compared(lambda a, b: [{"kind": k, "text": t} for k, t in edit_script(word_tokens(a, plain), word_tokens(b, plain))], _SCRIPT, old, new)


def changed_sections(old: Column | str, new: Column | str, moves: bool = True) -> Column:
    """The sections of that script; without ``moves``, what only moved on is none."""

    def run(a: str, b: str) -> list[dict]:
        found = sections(edit_script(word_tokens(a), word_tokens(b)))
        return found if moves else without_moves(found)

    return _compared(run, _SECTIONS, old, new)


def cleaned_texts(old: Column | str, new: Column | str) -> Column:
    """Both texts without repeated changes and noise, which their differences then do not show."""
    return _compared(lambda a, b: dict(zip(("old", "new"), map(without_noise, without_repeats(a, b)), strict=True)), _PAIR, old, new)


def word_changes(old: Column, new: Column) -> Column:
    """The words of an edit script's changes, as structs of word and change (1: come, -1: gone)."""
    script = F.filter(word_script(old, new), lambda x: x["kind"] != KEPT)
    words = F.transform(script, lambda x: F.transform(F.filter(F.split(x["text"], " "), lambda w: w != ""), lambda w: F.struct(w.alias("word"), x["kind"].alias("change"))))
    return F.flatten(words)
