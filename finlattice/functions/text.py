"""Scalar functions on labels and figures, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def parse_value(x: Column) -> Column:
    """Figure as written -> double; null if it isn't one. Only a leading bracket means negative; % isn't divided."""
    s = strip(x)
    negative = s.startswith("(") & s.endswith(")")
    inner = F.when(negative, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    digits = F.regexp_replace(inner, r"[$£€,\s%]", "")
    number = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(digits).isin("nan", "inf", "-inf", "+inf", "infinity"), digits.try_cast("double"))
    missing = F.lower(s).isin("n/a", "na", "-", "--", "")
    return F.when(missing | s.isNull(), F.lit(None).cast("double")).when(negative, -number).otherwise(number)


def stem(word: Column) -> Column:
    """Known stem, else the first suffix rule that matches."""
    w = F.lower(word)
    known = F.create_map(*(F.lit(x) for entry in V.STEMS.items() for x in entry))
    ruled = F.coalesce(*(F.when(w.rlike(p), F.regexp_replace(w, p, r)) for p, r in V.STEM_RULES), w)
    return F.coalesce(F.try_element_at(known, w), ruled)


def tokenize(text: Column) -> Column:
    """Distinct stems of the words that mean something, in order of appearance."""
    words = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", " "), r"(?U)\s+")
    words = F.array_except(words, F.array(*(F.lit(x) for x in V.FILLERS)))
    return F.array_distinct(F.transform(F.filter(words, lambda x: F.length(x) > 2), stem))


def is_section_header(label: Column) -> Column:
    s = F.lower(strip(label))
    return s.rlike("|".join(f"(?:{p})" for p in V.HEADER_PATTERNS))


def is_compound(label: Column) -> Column:
    out = F.lit(False)
    for s in V.COMPOUND_SEPARATORS:
        out = out | label.contains(s)
    return out


def compound_parts(label: Column) -> Column:
    return F.filter(F.transform(F.split(label, r"\s*[/&]\s*|\s+and\s+"), strip), lambda x: x != "")


def model_text(raw: Column) -> Column:
    """A model's answer without its thoughts and code fence."""
    s = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    fenced = strip(F.regexp_replace(F.regexp_replace(F.get(F.split(s, "```"), F.lit(1)), "^json", ""), "`+$", ""))
    return F.when(s.startswith("```"), fenced).otherwise(s)


def first_object(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*?\}", 0)


def series_of(code: Column) -> Column:
    return F.concat(F.substring(code, 1, 2), F.lit("00"))


def category_of(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in V.CATEGORIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, series_of(code)), F.lit("Unknown"))


def overlap(label: Column, account: Column) -> Column:
    """Label tokens met by an account token: equal, or of five letters at least and one the start of the other."""
    return F.filter(label, lambda p: F.exists(account, lambda c: (p == c) | ((F.length(p) >= 5) & (F.length(c) >= 5) & (p.startswith(c) | c.startswith(p)))))


def duck_stem(w: str) -> str:
    """stem() of a lower-case SQL expression, as DuckDB SQL."""
    cases = " ".join(f"when {w} = '{k}' then '{s}'" for k, s in V.STEMS.items())
    rules = " ".join(f"when regexp_matches({w}, '{p}') then regexp_replace({w}, '{p}', '{r}')" for p, r in V.STEM_RULES)
    return f"(case {cases} {rules} else {w} end)"


def duck_tokens(text: str) -> str:
    fillers = ", ".join(f"'{x}'" for x in V.FILLERS)
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda x: len(x) > 2 and x not in ({fillers}))"
    return f"list_distinct(list_transform({words}, lambda x: {duck_stem('x')}))"


def after_thought(raw: Column) -> Column:
    """The part after the last ` response` of an answer that holds a closing thought tag; others stay."""
    return strip(F.when(raw.contains("</think>"), F.element_at(F.split(raw, " response"), -1)).otherwise(raw))


def whole_number(x: Column) -> Column:
    return F.format_number(x, 0)


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def title_of(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def seconds_of(ms: Column) -> Column:
    return F.round(ms / 1000, 3)
