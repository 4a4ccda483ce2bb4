"""Text normalisation and folding as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and their letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}
#: Dashes that become "-", and quotes that become ' or ".
DASHES = "‐‑‒–—―−－"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛′", "“”„‟″«»"
#: Invisible and bidirectional control characters.
INVISIBLE = "­​‌‍⁠﻿‎‏‪‫‬‭‮⁦⁧⁨⁩"
#: Letters that a scanner confuses, before and after; then pairs.
CONFUSED, FOLDED = "oli|sbzg", "01115826"
PAIRS = (("rn", "m"), ("c1", "d"), ("vv", "w"))


#: White space of any script, in RE2's terms.
_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _hex_class(letters: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in letters) + "]"


def substituted(text: Column) -> Column:
    """Ligatures, dashes and quotes as ASCII."""
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(many))
    return F.translate(text, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def visible(text: Column) -> Column:
    """Without invisible characters."""
    return F.translate(text, INVISIBLE, "")


def dehyphenated(text: Column) -> Column:
    """A hyphen at the end of a line joins what follows if that is a lower-case letter."""
    return F.regexp_replace(text, r"-[ \t]*\n[ \t]*(?=\p{Ll})", "")


def collapsed(text: Column) -> Column:
    """Runs of white space are one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    """D13 to D17 without the map; D12 (NFKC) is that of ``offsets``, which runs only where a map is wanted."""
    return collapsed(dehyphenated(visible(substituted(text))))


def normalised_sql(text: str) -> str:
    for one, many in LIGATURES.items():
        text = f"replace({text}, '{one}', '{many}')"
    quotes = "''" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    text = f"translate({text}, '{DASHES}{SINGLE_QUOTES}{DOUBLE_QUOTES}', '{'-' * len(DASHES)}{quotes}')"
    text = f"regexp_replace({text}, '{_hex_class(INVISIBLE)}', '', 'g')"
    text = f"regexp_replace({text}, '-[ \\t]*\\n[ \\t]*(\\p{{Ll}})', '\\1', 'g')"
    return f"trim(regexp_replace({text}, '{_WHITE}+', ' ', 'g'))"


def folded(text: Column) -> Column:
    """Characters that a scanner confuses become one, white space goes."""
    text = F.translate(F.lower(text), CONFUSED, FOLDED)
    for pair, one in PAIRS:
        text = F.replace(text, F.lit(pair), F.lit(one))
    return F.regexp_replace(text, r"(?U)\s", "")


def folded_sql(text: str) -> str:
    text = f"translate(lower({text}), '{CONFUSED}', '{FOLDED}')"
    for pair, one in PAIRS:
        text = f"replace({text}, '{pair}', '{one}')"
    return f"regexp_replace({text}, '{_WHITE}', '', 'g')"


# -- redaction and protected terms

#: Shapes of addresses and phone numbers, tried in this order.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONES = (
    r"(?<![\w./])\+\d{1,3}(?:[\s.-]?\(?\d{1,4}\)?){2,5}(?![\w./])",
    r"(?<![\w./])\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?![\w./])",
    r"(?<![\w./])0\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?![\w./])",
    r"(?<![\w./])\d{10,15}(?![\w./])",
)


def redacted(text: Column, names: tuple[str, ...] = ()) -> Column:
    """addresses first, then phone numbers, then names, each replaced by its kind."""
    text = F.regexp_replace(text, f"(?iU){EMAIL}", "[redacted:email]")
    for shape in PHONES:
        text = F.regexp_replace(text, f"(?U){shape}", "[redacted:phone]")
    for name in names:
        text = F.regexp_replace(text, rf"(?iU)\b\Q{name}\E\b", "[redacted:name]")
    return text


#: Words and phrases about protected attributes, and structural phrases that are blanked first.
PROTECTED_WORDS = (
    "age", "aged", "ages", "gender", "genders", "gendered", "male", "males", "female", "females", "nationality", "nationalities",
    "ethnicity", "ethnicities", "ethnic", "racial", "religion", "religions", "religious", "married", "marriage", "marital", "divorced",
    "widowed", "pregnant", "pregnancy", "disability", "disabilities", "personality", "appearance", "attractive", "unattractive",
    "handsome", "childcare", "children", "child",
)
PROTECTED_PHRASES = (
    "years old", "year old", "date of birth", "place of birth", "culture fit", "cultural fit", "culture add", "single parent", "single mother",
    "single father", "marital status", "family status", "maternity leave", "paternity leave", "native speaker", "mother tongue",
    "sexual orientation", "gender identity", "racial background", "ethnic background", "race or", "how old",
)
TECHNICAL = (
    "child node", "child nodes", "children of", "child process", "child processes", "child element", "child elements", "child component",
    "child components", "child record", "child records", "child table", "child span", "child spans", "parent and child", "parent-child",
)


def alternation(terms: list[str]) -> str:
    """Whole terms, longest first; a space stands for any white space."""
    return r"\b(?:" + "|".join(t.replace("-", r"\-").replace(" ", r"\s+") for t in sorted(set(terms), key=lambda t: (-len(t), t))) + r")\b"


def protected_pattern(extra: tuple[str, ...] = ()) -> str:
    more = [e.replace("_", " ").strip().lower() for e in extra]
    return alternation([*PROTECTED_WORDS, *PROTECTED_PHRASES, *(e for e in more if e)])


def protected_terms(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """the protected terms of a text, lower-cased, distinct and sorted; empty if it has none."""
    cleaned = F.regexp_replace(text, "(?i)" + alternation([*TECHNICAL]), " ")
    found = F.regexp_extract_all(cleaned, F.lit("(?i)" + protected_pattern(extra)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))
