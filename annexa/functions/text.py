"""Text normalisers: pure Column -> Column, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FAILURE = r"(?i)^\s*(fail(ed)?|error|n/?a|none|null)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c) -> Column:
    return F.when(~_c(c).isin(MISSING), _c(c))


def strip(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def label(c) -> Column:
    return F.lower(strip(c))


def squeeze(c) -> Column:
    """Lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))


def is_failure(c) -> Column:
    return _c(c).isNull() | _c(c).rlike(FAILURE)


def parent_name(c) -> Column:
    return F.regexp_replace(_c(c), r"_segment_\d+", "")


def segment_index(c, default: int = 1_000_000_000) -> Column:
    """The number of ``_segment_<n>``, else of ``_<n>`` before the extension, else default."""
    at = lambda p: F.expr("null").cast("int") if p is None else F.regexp_extract(_c(c), p, 1).try_cast("int")
    return F.coalesce(at(r"_segment_(\d+)"), at(r"_(\d+)(?:\.[^.]+)?$"), F.lit(default))


def group_id(c, mark: str = "@") -> Column:
    return F.split_part(_c(c), F.lit(mark), F.lit(1))


def stem(c) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_c(c), r"^.*[/\\]", ""), r"\.[^.]+$", ""))


def with_extension(c, extension: str) -> Column:
    return F.concat(F.regexp_replace(_c(c), r"\.[^.]+$", ""), F.lit("." + extension))


def event_class(c, whole_words: bool = False) -> Column:
    """NES before ES, by substring (so YES counts as ES) or by whole words."""
    u = F.upper(_c(c))
    hit = (lambda w: u.rlike(rf"\b{w}\b")) if whole_words else (lambda w: u.contains(w))
    return F.when(hit("NES"), "NES").when(hit("ES"), "ES")


def leading_class(c) -> Column:
    found = F.upper(F.regexp_extract(strip(c), r"(?i)^(NES|ES)\b", 1))
    return F.when(found != "", found).otherwise(strip(c))


def direction(c) -> Column:
    """left, right or fail: the last word that says so, else a lone l or r."""
    t = label(c)
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(r"\b(left|right)\b"), F.lit(1)), F.lit(-1))
    return F.coalesce(last, F.when(t == "l", "left").when(t == "r", "right"), F.lit("fail"))


def yes_no(c) -> Column:
    t = F.regexp_replace(label(c), r"[.\s]+$", "")
    return F.when(t.isin("yes", "no", "na"), t).when(t == "n/a", "na").otherwise("fail")


def answer(c) -> Column:
    """na, yes or no found in free text, in this order of preference."""
    t = F.lower(_c(c))
    return F.when(t.rlike(r"\bn/?a\b"), "na").when(t.rlike(r"\byes\b"), "yes").when(t.rlike(r"\bno\b"), "no")


def as_set(c) -> Column:
    """A list answer as a sorted set: separators , and ; (full-width ones too), bars as colons, no space around colons."""
    t = F.regexp_replace(F.regexp_replace(label(c), r"\|", ":"), r"\s*:\s*", ":")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(t, "[,;，；]"), lambda x: F.trim(x)), lambda x: x != "")))


def same_answer(a, b) -> Column:
    """Equal as sets; null counts as an answer of its own."""
    return as_set(F.coalesce(_c(a), F.lit("unknown"))) == as_set(F.coalesce(_c(b), F.lit("unknown")))


def answer_tag(c) -> Column:
    return F.regexp_extract(_c(c), r"<answer>\s*([\s\S]*?)\s*</answer>", 1)


def first_number(c, low: float = 0.0, high: float = 1.0) -> Column:
    x = F.regexp_extract(_c(c), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def letters(c, least: int = 2) -> Column:
    """Runs of a-z of ``least`` letters or more, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z]{%d,}" % least), F.lit(0))


def without_phrases(c, phrases: list[str], words: list[str] = ()) -> Column:
    """Letters of the text after dropping phrases (longest first), then stop words."""
    t = F.regexp_replace(F.lower(_c(c)), r"[-_/]", " ")
    for p in sorted(phrases, key=len, reverse=True):
        t = F.regexp_replace(t, rf"\b{p}\b", " ")
    return F.filter(letters(t), lambda x: ~x.isin(list(words))) if words else letters(t)


#: Body regions, in the order in which alternatives are tried.
REGIONS = ["head", "eyes", "mouth", "face", "left arm", "left leg", "right arm", "right leg", "arms", "legs"]


def region(c, regions: list[str] = REGIONS) -> Column:
    """The last body region named, else fail."""
    hits = F.regexp_extract_all(label(c), F.lit(rf"\b({'|'.join(regions)})\b"), F.lit(1))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("fail"))


def replaced(c, rules: dict[str, str]) -> Column:
    """Whole words matching a pattern (any case) replaced, rule by rule."""
    out = _c(c)
    for pattern, new in rules.items():
        out = F.regexp_replace(out, rf"(?i)\b(?:{pattern})\b", new)
    return out


def _raw(c) -> Column:
    """An answer without its type label, separators in ASCII, bars as colons."""
    t = F.regexp_replace(strip(F.coalesce(_c(c), F.lit(""))), r"(?i)\b(yn|lr|choice|choice_multi|pair|list|map|text)\s*[:=]\s*", "")
    return strip(F.translate(t, "|，；\r", ":,;\n"))


def plain(c) -> Column:
    """Lower case, single spaces; unknown if nothing is left."""
    t = strip(F.regexp_replace(F.lower(_raw(c)), r"\s+", " "))
    return F.when(t == "", "unknown").otherwise(t)


def answer_yes_no(c, strict: bool = False) -> Column:
    """yes or no; anything else is no, or null if strict."""
    t = plain(c)
    return F.when(t.isin("yes", "no"), t).otherwise(F.lit(None) if strict else F.lit("no"))


def answer_side(c) -> Column:
    t = plain(c)
    return F.when(t.isin("left", "l"), "left").when(t.isin("right", "r"), "right").otherwise("neither")


def answer_choice(c, options: list[str]) -> Column:
    t = plain(c)
    return F.when(t.isin([o.lower() for o in options]), t).otherwise("unknown")


def answer_choices(c, options: list[str]) -> Column:
    """The allowed items of a list answer, each once, in the order of ``options``; unknown if none."""
    given = F.transform(F.split(F.lower(_raw(c)), r"[,\n;]+"), lambda x: strip(x))
    allowed = F.array(*(F.lit(o.lower()) for o in dict.fromkeys(options)))
    kept = F.filter(allowed, lambda o: F.array_contains(given, o))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise("unknown")


def first_word_flag(c) -> Column:
    """1 if the first word is YES, 0 if NO, else NA."""
    w = F.get(F.split(F.upper(strip(c)), r"\s+"), 0)
    return F.when(w == "YES", "1").when(w == "NO", "0").otherwise("NA")


def verdict(c) -> Column:
    t = F.lower(_c(c))
    return F.when(t.contains("misaligned"), "misaligned").when(t.contains("aligned"), "aligned").otherwise("unclear")


def keywords(c, vocabulary: list[str]) -> Column:
    """The words of a vocabulary that a text holds, spelt with underscores or spaces, in the vocabulary's order."""
    t = F.lower(_c(c))
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda w: t.contains(w) | t.contains(F.replace(w, F.lit("_"), F.lit(" "))))


def sheet_name(c) -> Column:
    return F.substring(F.regexp_replace(_c(c), r"[:\\/?*\[\]]", "_"), 1, 31)


def model_key(c) -> Column:
    """A model's name without case, hyphens, underscores and full stops."""
    return F.lower(F.translate(_c(c), "-_.", ""))


def model_name(path, families: list[str]) -> Column:
    """The model in a file name (a family's name up to ``-Instruct`` or ``_all_merged``), else the folder's name."""
    name = F.regexp_extract(F.regexp_replace(_c(path), r"^.*/", ""), rf"(?i)((?:{'|'.join(families)})[\w.-]+?)(?:-Instruct|_all_merged)", 1)
    folder = F.regexp_extract(_c(path), r"([^/]+)/[^/]*$", 1)
    return F.regexp_replace(F.when(name != "", name).otherwise(folder), r"(?i)-Instruct.*$", "")


def joined_parts(c) -> Column:
    """The texts of a ``||`` list, blanks and nan left out; null gives none."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"\|\|"), lambda x: strip(x))
    return F.filter(parts, lambda x: ~F.lower(x).isin("", "nan"))


def feature_name(c, prefix: str = "justification_for_") -> Column:
    return strip(F.replace(F.regexp_replace(_c(c), "^" + prefix, ""), F.lit("_"), F.lit(" ")))


def shows_phrase(c) -> Column:
    return F.when(label(c) == "no", "does not exhibit").otherwise("exhibits")


def filled(template: str, **values) -> Column:
    """A template with ``{name}`` replaced by columns (null: empty) and ``{{``, ``}}`` by braces."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [F.coalesce(_c(values[name]).cast("string"), F.lit(""))] if name else []
    return F.concat(F.lit(""), *parts)
