"""Document types by ordered rules: phrases in a text's words decide, and the first rule that holds wins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TypeRule:
    """A type holds if a phrase of each group of ``any_of`` stands in the text, and none of ``none_of``."""

    name: str
    any_of: tuple[tuple[str, ...], ...]
    none_of: tuple[str, ...] = ()


#: The rules in order (fixed values).
RULES = (
    TypeRule("Formulary Update", (("pdl", "formulary", "drug list"), ("update", "updates", "change", "changes", "noc")), ("medical", "request")),
    TypeRule(
        "Formulary",
        (("pdl", "formulary", "drug list", "preferred-drug-list"),),
        (
            "update", "change", "changes", "preventive", "specialty", "exclusion", "medical", "prior authorization", "policy", "procedure",
            "step therapy", "quantity limit", "precertification", "pre-certification", "form", "how-to", "how to", "request",
        ),
    ),
    TypeRule("Medical Coverage List", (("medical", "medical coverage", "jcode"),), ("policy", "policies", "standards", "presentation")),
    TypeRule(
        "Restriction List",
        (
            (
                "pa", "prior authorization", "authorization", "auth", "precertification", "pre-certification", "prior approval", "st",
                "step therapy", "step-therapy", "step", "ql", "quantity limit", "quantity",
            ),
            ("list",),
        ),
    ),
    TypeRule("Specialty List", (("sp", "specialty", "specialty pharmacy", "self-administered"), ("list", "dml"))),
    TypeRule("Exclusion List", (("exclusion", "non-formulary"), ("list",))),
    TypeRule(
        "Preventive Drug List",
        (("preventive drug", "preventive", "prevention", "no cost", "zero copay", "zero dollar copay", "$0 copay", "zero premium"), ("list", "pdl")),
    ),
    TypeRule("Fee Schedule", (("fee schedule", "rates"),)),
    TypeRule("Annual Notice of Changes", (("anoc", "annual notice of change", "annual notice of changes"),)),
    TypeRule(
        "Authorization Policy",
        (("pa", "authorization", "auth", "step", "st", "prior authorization", "step therapy", "precertification", "pre-certification"),),
        ("list", "new to market", "unlisted", "non-formulary", "form", "request"),
    ),
    TypeRule("Site of Care Policy", (("soc", "site of care", "site-of-care"),)),
    TypeRule(
        "Authorization Policy",
        (("policy", "coverage determination"),),
        ("update", "national", "local", "ncd", "lcd", "new to market", "unlisted", "non-formulary", "privacy", "form"),
    ),
    TypeRule("Authorization Policy", (("criteria",),), ("new to market", "unlisted", "non-formulary")),
    TypeRule("New-to-Market Policy", (("ntm", "new to market", "new-to-market"),), ("policy", "guideline")),
    TypeRule("Payer Unlisted Policy", (("nf", "non-formulary", "unlisted"), ("policy", "guideline")), ("ntm", "new to market", "new-to-market")),
    TypeRule("Treatment Request Form", (("form", "request", "submission", "waiver"),), ("instructions", "guide")),
    TypeRule("Provider Guide", (("provider policy", "provider manual", "resource manual", "resource guide"),)),
    TypeRule("Provider Guide", (("provider",), ("guide",))),
    TypeRule("Evidence of Coverage", (("eoc", "evidence of coverage"),)),
    TypeRule("Summary of Benefits", (("sob", "benefits summary", "summary of benefits", "explanation of benefits", "bcm"),)),
    TypeRule("NCCN Guideline", (("nccn", "nccn guidelines"),)),
    TypeRule("NCD", (("ncd", "national coverage determination"),)),
    TypeRule("LCD", (("lcd", "local coverage determination"),)),
    TypeRule("Review Committee Meetings", (("meeting", "committee", "agenda", "p&t", "pharmacy & therapeutics"),)),
    TypeRule("Newsletter / Announcement", (("newsletter", "news", "announcement", "announcements", "bulletin", "bulletins", "letter", "letters"),), ("beneficiary",)),
    TypeRule("Regulatory Document", (("regulation", "law", "carve out", "carve-out"),), ("prior authorization",)),
    TypeRule("Directory", (("directory",),)),
    TypeRule(
        "Member Resources",
        (
            (
                "preventive screening", "preventive screenings", "website accessibility", "rights & responsibilities", "rights and responsibilities",
                "notice of", "how to", "help", "information", "pharmacy services", "pharmacy service", "services", "service", "billing", "options",
                "handbook", "membership list", "membership guide", "reference guide", "catalog", "payer sheet", "rating", "ratings", "privacy notice",
                "privacy policy", "transparency in coverage", "standards for", "faq", "frequently asked", "presentation", "underwriting guidelines",
                "pharmacy network", "pharmacy benefit services", "flier", "flyer", "overview", "enrollment", "dental", "vision", "behavioral",
                "brochure", "fact sheet", "application", "program", "log", "fact", "information book", "contact", "contacts", "register", "conduct",
                "certificate", "support",
            ),
        ),
    ),
)
#: How much a source is trusted (fixed values).
CONFIDENCE = {"link_text": 0.8, "name": 0.8, "file_name": 0.8, "text": 0.7}


def padded_words(text: Column) -> Column:
    """The text's lower-case words with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _phrase(phrase: str) -> str:
    """A phrase as it stands among padded words."""
    return f" {' '.join(re.findall(r'[a-z0-9]+', phrase))} "


def type_of(text: Column, rules: tuple[TypeRule, ...] = RULES) -> Column:
    """The first type whose rule holds in ``text``, else null. A null text has none."""

    def told(words: Column) -> Column:
        has = lambda phrases: reduce(lambda a, b: a | b, [F.contains(words, F.lit(_phrase(p))) for p in phrases])
        out = None
        for rule in rules:
            holds = reduce(lambda a, b: a & b, [has(group) for group in rule.any_of] + ([~has(rule.none_of)] if rule.none_of else []))
            out = F.when(holds, rule.name) if out is None else out.when(holds, rule.name)
        return out

    # the words are bound to a name, so that they are made once for all rules
    return F.get(F.transform(F.array(padded_words(text)), told), F.lit(0))


def classified(sources: dict[str, Column], rules: tuple[TypeRule, ...] = RULES, first_words: int = 50) -> Column:
    """type, source and confidence of the first source with a type; of ``text`` only the first words count."""
    found = []
    for name, text in sources.items():
        own = F.array_join(F.slice(F.split(F.trim(padded_words(text)), " "), 1, first_words), " ") if name == "text" else text
        kind = type_of(own, rules)
        found.append(F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.lit(name).alias("source"), F.lit(CONFIDENCE[name]).alias("confidence"))))
    return F.coalesce(*found)


def type_sql(text: str, rules: tuple[TypeRule, ...] = RULES) -> str:
    """The DuckDB expression of ``type_of``."""
    words = f"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    has = lambda phrases: "(" + " OR ".join(f"contains(w, '{_phrase(p)}')" for p in phrases) + ")"
    whens = []
    for rule in rules:
        parts = [has(group) for group in rule.any_of] + ([f"NOT {has(rule.none_of)}"] if rule.none_of else [])
        whens.append(f"WHEN {' AND '.join(parts)} THEN '{rule.name}'")
    return f"list_transform([{words}], lambda w: CASE {' '.join(whens)} END)[1]"
