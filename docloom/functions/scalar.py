"""Scalar functions as columns: digests, tokens, urls, places, dates by rule, similarities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: State and territory codes and names (fixed values).
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: File extensions by content type (fixed values).
EXTENSIONS = {
    "application/pdf": "pdf",
    "text/html": "html",
    "text/plain": "txt",
    "text/csv": "csv",
    "application/msword": "doc",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
SPACES = r"[ \t\n\r\f\x0B]+"


def text_digest(text: Column) -> Column:
    """MD5 of the text without white space."""
    return F.md5(F.regexp_replace(text, SPACES, ""))


def string_tokens(text: Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def filename_tokens(name: Column) -> Column:
    """The runs of letters and digits of ASCII."""
    return F.filter(F.split(name, "[^a-zA-Z0-9]"), lambda t: t != "")


def url_path(url: Column) -> Column:
    """The path of a url, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """The path's parts between slashes, empty ones too."""
    return F.split(url_path(url), "/")


def simple_words(text: Column) -> Column:
    """Lower-case words of 2 to 15 letters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}_]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w).between(2, 15) & ~F.startswith(w, F.lit("_")))


def jaccard(a: Column, b: Column) -> Column:
    """Common distinct tokens over the sum of both lists' lengths less those; 0 for two empty lists."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both > 0, common / both).otherwise(0.0)


def extension(path: Column) -> Column:
    """A path's suffix if it is a known one; empty otherwise."""
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(found.isin(*EXTENSIONS.values()), found).otherwise("")


def extension_of_type(content_type: Column) -> Column:
    """The extension of a content type, with or without parameters."""
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return kinds[F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))]


def _first(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def state_code(text: Column) -> Column:
    """The first state code with no letter beside it, in upper case."""
    return F.upper(_first(text, rf"(?i)(?<![a-z])({'|'.join(STATES)})(?![a-z])"))


def state_name(text: Column) -> Column:
    """The first state name, wherever it stands. Of two at one place, the longer."""
    names = "|".join(sorted(STATES.values(), key=len, reverse=True))
    return F.initcap(_first(text, rf"(?i)({names})"))


def year_part(text: Column) -> Column:
    """The first four digits from 2000 to 2999 with no digit beside them."""
    return _first(text, r"(?<![0-9])(2[0-9]{3})(?![0-9])").cast("int")


def month_part(text: Column) -> Column:
    """The first number from 1 to 12 with no digit or lower-case letter beside it."""
    return _first(text, r"(?<![0-9a-z])(0?[1-9]|1[0-2])(?![0-9a-z])").cast("int")


def month_name(text: Column) -> Column:
    """The first month's name."""
    return F.initcap(_first(text, rf"(?i)({'|'.join(MONTHS)})"))


def month_abbr(text: Column) -> Column:
    """The first month's abbreviation that stands alone."""
    names = "|".join("Sept?" if m == "September" else m[:3] for m in MONTHS)
    return F.initcap(_first(text, rf"(?i)(?<![a-z])({names})(?![a-z])"))


def quarter_start(text: Column) -> Column:
    """The first day of a quarter named like ``Q3 2020``, ``2nd quarter 2020`` or ``Third Quarter of 2022``."""
    names = {"first": 1, "second": 2, "third": 3, "fourth": 4}
    low = F.lower(text)
    number = F.coalesce(
        _first(low, r"q([1-4])\s+(?:of\s+)?2[0-9]{3}").cast("int"),
        _first(low, r"([1-4])(?:st|nd|rd|th)\s+quarter\s+(?:of\s+)?2[0-9]{3}").cast("int"),
        F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[_first(low, rf"({'|'.join(names)})\s+quarter\s+(?:of\s+)?2[0-9]{{3}}")],
    )
    year = _first(low, r"(?:q[1-4]|quarter)\s+(?:of\s+)?(2[0-9]{3})").cast("int")
    return F.make_date(year, number * 3 - 2, F.lit(1))


def final_effective_date(effective: Column, reviewed: Column, updated: Column, collected: Column) -> Column:
    """The greatest of three dates, or the first collection, at midnight."""
    return F.date_trunc("day", F.coalesce(F.greatest(effective, reviewed, updated), collected))


def consensus(values: Column) -> Column:
    """The one distinct value among those that are neither null nor empty, else null."""
    distinct = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def size_ratio(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(a, b); 1 if both are 0."""
    most = F.greatest(a, b)
    return F.when(most > 0, 1 - F.abs(a - b) / most).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is missing, zero or of another length."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def cron_matches(cron: Column, when: Column) -> Column:
    """Whether each of a cron string's five fields is ``*`` or exactly the time's own value (Sunday is 0)."""
    own = [F.minute(when), F.hour(when), F.dayofmonth(when), F.month(when), F.dayofweek(when) - 1]
    fields = F.split(F.trim(cron), r"\s+")
    same = [F.get(fields, F.lit(i)).isin("*") | (F.get(fields, F.lit(i)) == value.cast("string")) for i, value in enumerate(own)]
    out = F.size(fields) == 5
    for test in same:
        out = out & F.coalesce(test, F.lit(False))
    return out


def glob_match(value: Column, rule: str) -> Column:
    """What ``*`` stands for in ``value`` by a rule of literal text and ``*``; null if the rule does not fit."""
    pattern = "".join("(.+)" if c == "*" else ("\\" + c if c in r"\.^$|()[]{}+?" else c) for c in rule)
    group = 1 if "*" in rule else 0
    return F.when(value.rlike(f"^{pattern}$"), F.regexp_extract(value, f"^{pattern}$", group))


def date_differs(a: Column, b: Column) -> Column:
    """Whether two times lie on different days; null is a day of its own."""
    return ~F.to_date(a).eqNullSafe(F.to_date(b))


def header_place(header: Column, part: str) -> Column:
    """The place, from 0, of the first header cell that holds ``part``; -1 if none does."""
    return (F.array_position(F.transform(header, lambda h: F.contains(F.lower(h), F.lit(part.lower()))), F.lit(True)) - 1).cast("int")


def content_digest(text: Column, content: Column) -> Column:
    """MD5 of the trimmed text's bytes with those of a file behind them; nulls count as empty."""
    return F.md5(F.concat(F.trim(F.coalesce(text, F.lit(""))).cast("binary"), F.coalesce(content, F.lit("").cast("binary"))))


def document_digest(extension: Column, text: Column, content: Column) -> Column:
    """The text's digest for HTML, which changes from load to load, else that of the bytes."""
    return F.when(extension == "html", text_digest(text)).otherwise(F.md5(content))


def compacted(values: Column) -> Column:
    """The elements that are neither null nor empty."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def naive_date(when: Column) -> Column:
    """Midnight of a time's day, without a zone; null stays null."""
    return F.date_trunc("day", when).cast("timestamp_ntz")


def href_selector(extensions: Column, keywords: Column) -> Column:
    """A CSS selector of links whose target ends with an extension or holds a keyword; empty if there are none."""
    ends = F.transform(extensions, lambda e: F.concat(F.lit('a[href$=".'), e, F.lit('"]')))
    holds = F.transform(keywords, lambda k: F.concat(F.lit('a[href*="'), k, F.lit('"]')))
    return F.array_join(F.concat(ends, holds), ", ")


def hidden_selector(extensions: Column) -> Column:
    """A CSS selector of hidden inputs whose value ends with an extension."""
    return F.array_join(F.transform(extensions, lambda e: F.concat(F.lit('input[type="hidden"][value$=".'), e, F.lit('"]'))), ", ")


def xpath(tag: Column, attribute: Column, value: Column, contains: Column) -> Column:
    """The XPath of elements with an attribute, of a value or holding it; any element if the tag is null."""
    own = F.concat(F.lit("//"), F.coalesce(tag, F.lit("*")))
    held = F.concat(own, F.lit("[contains(@"), attribute, F.lit(", '"), value, F.lit("')]"))
    same = F.concat(own, F.lit("[@"), attribute, F.lit("='"), value, F.lit("']"))
    return F.when(attribute.isNull(), own).when(value.isNull(), F.concat(own, F.lit("[@"), attribute, F.lit("]"))).when(contains, held).otherwise(same)


def disposition_name(header: Column) -> Column:
    """The file name in a content-disposition header, with or without quotes."""
    return _first(header, r"""(?i)filename\*?=(?:UTF-8'')?["']?([^"';]+)["']?""")


def guessed_extension(url: Column, disposition: Column, content_type: Column) -> Column:
    """A file's extension by its url's path, else by its header's name, else by its content type."""
    return F.coalesce(F.nullif(extension(url_path(url)), F.lit("")), F.nullif(extension(disposition_name(disposition)), F.lit("")), extension_of_type(content_type))


def us_date(text: Column) -> Column:
    """``2020-01-31 00:00:00`` as ``01/31/2020``; null if it is no such time."""
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), "MM/dd/yyyy")


def is_after(text: Column, now: Column) -> Column:
    """Whether a time, as text, is after ``now``; false where it is missing or none."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")) > now, F.lit(False))


def safe_int(text: Column) -> Column:
    """A whole number out of text; null if it is none."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(text).try_cast("long"))


#: Medical groups are numbered in steps, so that their ids do not meet other groups' (fixed value).
MEDICAL_STEP = 10_000


def group_id(text: Column, medical: Column) -> Column:
    """A group's id out of text; a medical group's is multiplied."""
    own = safe_int(text)
    return F.when(medical, own * MEDICAL_STEP).otherwise(own)


def display_label(name: Column, own: Column, medical: Column) -> Column:
    """``name | id``, with a medical group's id as it was given."""
    return F.concat(name, F.lit(" | "), F.when(medical, F.floor(own / MEDICAL_STEP)).otherwise(own).cast("string"))


def object_time(object_id: Column) -> Column:
    """The time in the first eight hex digits of an object id; null if it is not of 24."""
    return F.when(object_id.rlike("^[0-9a-fA-F]{24}$"), F.timestamp_seconds(F.conv(F.substring(object_id, 1, 8), 16, 10).cast("long")))


def same_record(a: Column, b: Column, fields: list[str], skipped: tuple[str, ...] = ("name", "score")) -> Column:
    """Whether two structs agree in all fields but the skipped ones; two nulls do."""
    out = F.lit(True)
    for f in fields:
        if f not in skipped:
            out = out & a[f].eqNullSafe(b[f])
    return out


def config_digest(config: Column) -> Column:
    """MD5 of a struct's JSON."""
    return F.md5(F.to_json(config))


#: Groups of words that tell plans and routes apart (fixed values). A phrase holds if its words follow one another.
KEYWORDS = {
    "pa": ("pa", "prior authorization"),
    "st": ("st", "step therapy"),
    "oral": ("oral",),
    "sublingual": ("sublingual",),
    "buccal": ("buccal",),
    "im": ("im", "instramuscular"),
    "iv": ("iv", "intravenous"),
    "sq": ("sq", "subcutaneous"),
    "rectal": ("rectal",),
    "vaginal": ("vaginal",),
    "intranasal": ("intranasal",),
    "inhalation": ("inhalation",),
    "hmo": ("hmo",),
    "ppo": ("ppo",),
    "pos": ("pos",),
    "pdp": ("pdp",),
    "hix": ("hix",),
    "ma": ("ma",),
    "pd": ("pd",),
    "medicaid": ("medicaid",),
    "medicare": ("medicare",),
    "part d": ("part d",),
}


def keyword_groups(text: Column, groups: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """The names of the groups of which a word or phrase stands in the text."""
    words = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))

    def told(w: Column) -> Column:  # the words are bound to a name, so that they are made once
        has = lambda phrases: reduce(lambda x, y: x | y, [F.contains(w, F.lit(f" {p} ")) for p in phrases])
        return F.filter(F.array(*[F.when(has(phrases), F.lit(name)) for name, phrases in groups.items()]), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(words), told), F.lit(0))


#: What abbreviations in drug names stand for, in order (fixed values).
DRUG_WORDS = (
    ("tabs?", "tablet"),
    ("chew", "chewable"),
    ("ca?ps?", "capsule"),
    ("cp24", "capsule extended release"),
    ("12.hour", "12 HR extended release"),
    ("24.hour", "24 HR extended release"),
    ("soln", "solution"),
    ("tbec", "tablet delayed release"),
    ("tbcr", "tablet extended release"),
    ("dr", "delayed release"),
    ("er", "extended release"),
    ("xr", "extended release"),
    ("cr", "extended release"),
    ("controlled release", "extended release"),
    ("sl", "sublingual"),
    ("liqd", "liquid"),
    ("inj", "injection"),
    ("conc", "concentrate"),
    ("prsyr", "prefilled syringe"),
    ("pref", "prefilled"),
    ("suppos", "suppository"),
    ("supp", "suppository"),
    ("susp", "suspension"),
    ("oint", "ointment"),
    ("ophth", "ophthalmic"),
    ("im", "intramuscular"),
    ("act", "actuation"),
    ("actuat", "actuation"),
    ("pow", "powder"),
)


def drug_name(text: Column) -> Column:
    """A drug's name in one spelling: single spaces, ``.5`` as ``0.5``, abbreviations written out. Null is empty."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    out = F.regexp_replace(out, r"(^|[^0-9])\.([0-9])", "$10.$2")
    for pattern, name in DRUG_WORDS:
        out = F.regexp_replace(out, rf"(?i)\b{pattern}\b", name)
    return out


def drug_names(text: Column, separators: str = "/,") -> Column:
    """The names that a list of strengths stands for: what is before the first number with each part behind it. Without a separator, one."""

    def told(own: Column) -> Column:
        name, rest = F.trim(F.regexp_extract(own, r"^([^0-9]*)(.*)$", 1)), F.regexp_extract(own, r"^([^0-9]*)(.*)$", 2)
        parts = F.transform(F.split(rest, f"[{separators}]"), lambda x: F.trim(F.concat(name, F.lit(" "), F.trim(x))))
        return F.when(rest.rlike(f"[{separators}]"), parts).otherwise(F.array(own))

    # bound to a name, so that the text is written out once
    return F.get(F.transform(F.array(drug_name(text)), told), F.lit(0))


def normalized_spaces(text: Column) -> Column:
    """The text with every run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def scrubbed(text: Column) -> Column:
    """The text with every run of other than letters and digits of ASCII as one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))


def prefix_label(code: Column, several: Column) -> Column:
    """How a group of codes is shown by its first code: ``0ppX`` for several; a single short code is filled up to four letters."""
    return F.when(several, F.concat(F.lit("0"), F.substring(code, 1, 2), F.lit("X"))).when(F.length(code) == 2, F.concat(F.lit("0"), code, F.lit("x"))).when(F.length(code) == 3, F.concat(F.lit("0"), code)).otherwise(code)
