"""Column expressions for lead values: cleaning, parsing, domains, tokens. All built-in, no Python per row.

Text that is missing is null or blank; results that are texts are blank when there is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for yes and no.
TRUE_WORDS = ["1", "true", "yes", "ja", "y", "x"]
FALSE_WORDS = ["0", "false", "no", "nein", "n"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value`` bound to a variable: evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def clean_text(c: Column | str) -> Column:
    """Null to blank, runs of Unicode white space to one space, trimmed."""
    runs = r"(?U) \s+|[\s&&[^ ]]\s*"  # a single space stays as it is and is no match
    return F.trim(F.regexp_replace(F.coalesce(as_col(c).cast("string"), F.lit("")), runs, " "))


def filled(c: Column | str) -> Column:
    """The cleaned text, or null where it is blank."""
    return first_filled_or_null(c)


def first_filled_or_null(*columns: Column | str) -> Column:
    """The first value that isn't blank, cleaned, or null if none is; each is named once, so nested calls stay short."""
    return F.get(F.filter(F.array(*map(clean_text, columns)), lambda x: x != ""), 0)


def has(c: Column | str) -> Column:
    return clean_text(c) != ""


def first_filled(*columns: Column | str) -> Column:
    """The first value that isn't blank, cleaned; blank if none is."""
    return F.coalesce(first_filled_or_null(*columns), F.lit(""))


def truthy(c: Column | str) -> Column:
    """Words for yes are true, words for no and blank are false, any other text is true."""
    return let(F.lower(clean_text(c)), lambda text: F.when(text.isin(TRUE_WORDS), True).when(text.isin(FALSE_WORDS), False).otherwise(text != ""))


def bool_string(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def between(c: Column, low: float, high: float) -> Column:
    """``c`` kept between two bounds; null stays null, which least and greatest alone would skip."""
    return let(c, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))))


def to_number(c: Column | str) -> Column:
    """A double, a comma taken as a point; null if the text is no number."""
    return let(F.regexp_replace(clean_text(c), ",", "."), lambda text: F.when(text.rlike(NUMBER), text.try_cast("double")))


def parse_score(c: Column | str, default: int = 0) -> Column:
    """A whole number, truncated; ``default`` if the text is no number."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(default))


def clamp_score(c: Column) -> Column:
    """Rounded half to even, between 0 and 100."""
    return between(F.rint(c.cast("double")).cast("int"), 0, 100)


def parse_confidence(c: Column | str, default: float = 0.0) -> Column:
    """Between 0 and 1; numbers above 1 are percent, a percent sign at the end is dropped."""
    share = let(to_number(F.regexp_replace(clean_text(c), r"%+$", "")), lambda number: F.when(number > 1, number / 100.0).otherwise(number))
    return F.coalesce(between(share, 0.0, 1.0), F.lit(default))


def confidence_percent(c: Column | str, default: int = 0) -> Column:
    """Whole percent, rounded half to even; numbers from 0 to 1 are shares."""
    percent = let(to_number(c), lambda number: F.when((number >= 0) & (number <= 1), number * 100).otherwise(number))
    return F.coalesce(F.rint(percent).cast("int"), F.lit(default))


def first_valid_confidence(*columns: Column | str) -> Column:
    """The first column that holds a number, as a share between 0 and 1; 1.0 if none does."""

    def share(c):
        return between(let(to_number(c), lambda number: F.when(number > 1, number / 100.0).otherwise(number)), 0.0, 1.0)

    return F.coalesce(*(share(c) for c in columns), F.lit(1.0))


def format_confidence(c: Column | str) -> Column:
    return let(to_number(c), lambda number: F.when(number.isNull(), "").otherwise(F.format_string("%.2f", number)))


def normalize_domain(c: Column | str) -> Column:
    """Host of a URL, a bare domain or an e-mail address: lower case, no user, port, ``www.`` or outer dots."""
    # each step names the one before it once: steps that named it twice doubled the expression each time
    raw = F.regexp_replace(F.lower(clean_text(c)), r"^(?!.*://).*@", "")
    rest = F.regexp_replace(raw, r"^.*?://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")


def normalize_url(c: Column | str, fallback: Column | str | None = None) -> Column:
    """https URL with the normalized host and the path, without query and fragment; else the fallback domain's root."""
    root = let(normalize_domain(fallback), lambda other: F.when(other != "", F.concat(F.lit("https://"), other, F.lit("/"))).otherwise("")) if fallback is not None else F.lit("")

    def address(raw: Column) -> Column:
        path = F.regexp_extract(F.regexp_replace(raw, r"^.*?://", ""), r"^[^/?#]*(/[^?#]*)?", 1)
        return let(normalize_domain(raw), lambda domain: F.when(domain != "", F.concat(F.lit("https://"), domain, F.regexp_replace(path, "^$", "/"))))

    return F.coalesce(let(clean_text(c), address), root)


def lead_id(domain: Column | str) -> Column:
    """Surrogate key of a domain: ``lead_`` and the first 12 hex digits of its SHA-1."""
    return let(normalize_domain(domain), lambda d: F.when(d != "", F.concat(F.lit("lead_"), F.substring(F.sha1(d.cast("binary")), 1, 12))).otherwise(""))


def split_tokens(c: Column | str, lower: bool = False) -> Column:
    """Array of the tokens between ``|``, ``,`` and ``;``, cleaned, blanks dropped."""
    text = clean_text(c)
    tokens = F.filter(F.transform(F.split(F.lower(text) if lower else text, r"[|,;]+"), clean_text), lambda x: x != "")
    return tokens


def distinct_tokens(tokens: Column) -> Column:
    """Tokens distinct without regard to case; the first spelling and the order stay."""
    keys = F.transform(tokens, F.lower)
    return F.filter(tokens, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(distinct_tokens(F.filter(F.transform(tokens, clean_text), lambda x: x != "")), "|")


def merge_tokens(*columns: Column | str, lower: bool = False) -> Column:
    return join_tokens(F.flatten(F.array(*(split_tokens(c, lower) for c in columns))))


def merge_signals(*columns: Column | str) -> Column:
    """Sorted union of lists joined by ``|``."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(as_col(c), F.lit("")), r"\|") for c in columns)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))), "|")


def resolve_aliases(available: list[str], aliases: dict[str, list[str]]) -> list[Column]:
    """One column for each target: the first filled one of its aliases that exist, header case ignored."""
    by_name: dict[str, str] = {}
    for name in available:
        by_name.setdefault(name.strip().lower(), name)
    out = []
    for target, names in aliases.items():
        found = [F.col(f"`{by_name[n.lower()]}`") for n in names if n.lower() in by_name]
        out.append((first_filled(*found) if found else F.lit("")).alias(target))
    return out


def country_hint(domain: Column | str) -> Column:
    d = as_col(domain)
    return F.when(d.endswith(".de"), "DE").when(d.endswith(".at"), "AT").when(d.endswith(".ch"), "CH").otherwise("")


def is_dach(domain: Column | str, hint: Column | str | None = None) -> Column:
    d = as_col(domain)
    by_name = d.endswith(".de") | d.endswith(".at") | d.endswith(".ch")
    return by_name if hint is None else by_name | F.upper(clean_text(hint)).isin("DE", "AT", "CH")


# Page titles that are no company names.
LOW_VALUE_NAMES = ["impressum", "kontakt", "datenschutz", "home", "shop", "startseite"]


def clean_company_name(c: Column | str) -> Column:
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(clean_text(c), r"\s*\|\s*.*$", "")), r"\s+-\s+.*$", ""))
    return let(text, lambda x: F.when(F.lower(x).isin(LOW_VALUE_NAMES), "").otherwise(x))


def company_name(name: Column | str, title: Column | str, domain: Column | str) -> Column:
    """struct(name, source, confidence): the given name, else the page title, else the domain's stem in title case."""
    stem = F.regexp_replace(F.element_at(F.split(as_col(domain), r"\."), 1), "-", " ")
    # title case starts anew after every sign that is no letter
    runs = F.regexp_extract_all(stem, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")

    def out(value, source, confidence):
        return F.struct(value.alias("name"), F.lit(source).alias("source"), F.lit(confidence).cast("double").alias("confidence"))

    def body(names: Column) -> Column:
        given, by_title = names["given"], names["title"]
        return (
            F.when(given != "", out(given, "input_csv:company_name", 0.70))
            .when(by_title != "", out(by_title, "input_csv:title", 0.45))
            .when(has(domain), out(titled, "derived_from_domain", 0.35))
            .otherwise(out(F.lit(""), "", 0.0))
        )

    return let(F.struct(clean_company_name(name).alias("given"), clean_company_name(title).alias("title")), body)


def valid_email(c: Column | str) -> Column:
    """Has an at sign, a dot after the last one, and no space."""
    return let(clean_text(c), lambda text: text.contains("@") & F.element_at(F.split(text, "@"), -1).contains(".") & ~text.contains(" "))


def absolute_url(domain: Column | str, href: Column | str) -> Column:
    """A link's address on its own domain."""
    h, d = as_col(href), as_col(domain)
    return (
        F.when(h.rlike(r"^https?://"), h)
        .when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith("/"), F.concat(F.lit("https://"), d, h))
        .otherwise(F.concat(F.lit("https://"), d, F.lit("/"), h))
    )


def same_domain(url: Column | str, domain: Column | str) -> Column:
    return let(normalize_domain(domain), lambda d: (d != "") & (normalize_domain(url) == d))


# Categories of the scorer and their grades.
CATEGORY_GRADES = {"a++": "A++", "a+": "A+", "a": "A", "b": "B", "c": "C", "review": "Review", "manual_review": "Review", "unknown": "Review", "excluded": "Reject", "reject": "Reject", "rejected": "Reject"}


def normalize_category(c: Column | str) -> Column:
    grades = F.create_map(*[F.lit(x) for pair in CATEGORY_GRADES.items() for x in pair])
    return F.coalesce(F.try_element_at(grades, F.lower(F.trim(as_col(c)))), as_col(c))


def quality_rank(c: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in {"C": 0, "B": 1, "A": 2, "A+": 3, "A++": 4}.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(as_col(c), F.lit(""))), F.lit(0))


def run_stamp(seconds: Column) -> Column:
    """UTC time of a run in ISO form; the run's one timestamp is passed in, never taken anew in each step."""
    return F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stamp(stamp: Column | str) -> Column:
    """A run's time as part of a file name."""
    return F.translate(F.regexp_replace(as_col(stamp), "T", "_"), "-:Z", "")
