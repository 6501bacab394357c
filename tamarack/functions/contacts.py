"""Column expressions that find contacts and names in page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import as_col, clean_text, let

# Local parts of addresses that belong to no person.
GENERIC_PREFIXES = ["info", "kontakt", "contact", "office", "service", "support", "shop", "kundenservice", "mail", "hello", "hallo", "team", "vertrieb", "sales"]
GENERIC_STARTS = ["info.", "kontakt.", "office."]
# Shapes of addresses, numbers and dates.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"((?:\+49|0049|0)[\d\s()./-]{5,}\d)"
LABELLED_PHONE = r"(?i)(?:Telefon|Tel\.?|Fon|Phone|Mobil|Mobile|Rufnummer)\s*:?\s*((?:\+49|0049|0)[\d\s()./-]{5,}\d)"
SITE_EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
SITE_PHONE = r"(?:\+49[\s.\-/]?|0049|0)[0-9][0-9\s()./-]{6,20}"
DATES = r"^[\s.,;:]*\d{1,2}[./-]\d{1,3}[./-]\d{2,4}[\s.,;:]*$"
# Legal forms in the order they are looked for.
LEGAL_FORMS = [r"\bGmbH\s*&\s*Co\.\s*KG\b", r"\bGmbH\b", r"\bUG\s*\(haftungsbeschraenkt\)\b", r"\bUG\s*\(haftungsbeschränkt\)\b", r"\bAG\b", r"\be\.K\.\b", r"\be\.Kfm\.\b", r"\bKG\b", r"\bOHG\b", r"\bGbR\b", r"\bEinzelunternehmen\b"]


def strip_outer(c: Column, signs: str) -> Column:
    return F.btrim(c, F.lit(signs))


def extract_emails(text: Column | str, pattern: str = EMAIL) -> Column:
    """All distinct addresses in lower case, in order."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def is_generic_email(email: Column) -> Column:
    prefix = F.element_at(F.split(email, "@"), 1)
    starts = F.lit(False)
    for s in GENERIC_STARTS:
        starts = starts | prefix.startswith(s)
    return prefix.isin(GENERIC_PREFIXES) | starts


def general_email(text: Column | str) -> Column:
    return F.coalesce(F.get(F.filter(extract_emails(text), is_generic_email), 0), F.lit(""))


def site_email(text: Column | str) -> Column:
    """The first address of a page; blank if it names an image."""
    found = F.lower(strip_outer(F.regexp_extract(F.coalesce(as_col(text), F.lit("")), f"({SITE_EMAIL})", 1), ".,;:()[]<>"))
    return F.when(found.rlike(r"\.(png|jpg|jpeg|gif|webp|svg)$"), "").otherwise(found)


def normalize_phone(c: Column) -> Column:
    """White space and outer signs go, and so does a bracket after a zero that nothing in the number opens; ``(040)`` stays whole."""
    phone = strip_outer(F.regexp_replace(c, r"(?U)\s+", " "), " .-/")
    phone = F.regexp_replace(phone, r"(\([^()]*\))|(0)\)", "$1$2")
    return F.regexp_replace(phone, r"\(\s*0\s*\)", "(0)")


def plausible_phone(c: Column) -> Column:
    """Eight digits or more, no date, no pair of years or of four-digit groups, no dotted list of short groups."""

    def body(groups: Column) -> Column:
        n, second, digits = F.size(groups), F.coalesce(F.get(groups, 1), F.lit("")), F.array_join(groups, "")
        year = (n == 2) & second.rlike(r"^(19|20)\d\d$")
        fours = (n == 2) & F.forall(groups, lambda g: F.char_length(g) == 4)
        dotted = c.contains(".") & (n >= 4) & (F.size(F.filter(groups, lambda g: F.char_length(g) <= 2)) >= 2)
        return (F.char_length(digits) >= 8) & ~digits.startswith("000") & ~c.rlike(r"^\d{1,2}[./-]\d{2,4}$") & ~year & ~fours & ~dotted

    return let(F.filter(F.split(c, r"\D+"), lambda g: g != ""), body)


def extract_phones(text: Column | str, pattern: str = PHONE) -> Column:
    """All distinct plausible numbers, normalized, in order."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, normalize_phone), plausible_phone))


def main_phone(text: Column | str) -> Column:
    """The first labelled number, else the first number; blank if there is none."""
    return F.coalesce(F.get(extract_phones(text, LABELLED_PHONE), 0), F.get(extract_phones(text), 0), F.lit(""))


def site_phone(text: Column | str) -> Column:
    """The first number of a page that is no date and has seven digits or more."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(f"({SITE_PHONE})"), F.lit(1))
    cleaned = F.transform(found, lambda x: clean_text(strip_outer(x, ".,;:()[]<> ")))
    good = F.filter(cleaned, lambda x: (x != "") & ~x.rlike(DATES) & (F.char_length(F.regexp_replace(x, r"\D", "")) >= 7))
    return F.coalesce(F.get(good, 0), F.lit(""))


def legal_form(text: Column | str) -> Column:
    """The first of the legal forms, in their order, as it is spelled in the text.

    Each must end at a word boundary, so those that end in a sign are met only where a letter or digit follows at once.
    """
    t = F.coalesce(as_col(text), F.lit(""))
    return F.coalesce(*(F.nullif(F.regexp_extract(t, f"(?iu)({p})", 1), F.lit("")) for p in LEGAL_FORMS), F.lit(""))


# What a legal name can't hold, and markers before it.
VENDOR_TOKENS = ["cleverreach", "google", "facebook", "meta platforms", "paypal", "klarna", "shopify", "woocommerce", "trustpilot", "zammad", "box-taped"]
QUANTITY = r"(?iu)\b\d+(?:[,.]\d+)?\s*(?:kg|g|gramm|ml|l|liter|stk|stück|pcs)\b"
STOP_WORDS = r"(?U)\b(eine|einer|einem|einen|umgründung|seminar|bestellungen)\b"
NAME_MARKERS = ["Angaben gemaess", "Angaben gemass", "Angaben gemäß", "Impressum", "Kontakt", "Anbieter", "Diensteanbieter", "Betreiber"]
CONTEXT_MARKERS = ["diensteanbieter", "anbieter", "betreiber", "firma", "impressum", "angaben gemaess", "angaben gemass", "angaben gemäß"]
ANY_FORM = r"(?iu)\b(?:GmbH|UG|AG|e\.K|KG|OHG|GbR|Einzelunternehmen)"  # what each form above and below begins with
FALLBACK_FORMS = ["GmbH", "UG", "AG", "e.K.", "KG", "OHG", "GbR"]


def plausible_legal_name(value: Column, form: Column) -> Column:

    def body(text: Column) -> Column:
        words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
        lower = let(F.lower(text), lambda x: x.contains(F.lower(form)) & ~x.rlike("|".join(VENDOR_TOKENS)) & ~x.rlike(QUANTITY) & ~x.rlike(r"^(diensteanbieter|anbieter) ") & ~x.rlike(STOP_WORDS))
        return (text != "") & lower & (words >= 2) & (words <= 8)

    return let(clean_text(value), body)


def clean_legal_name(value: Column) -> Column:
    text = clean_text(value)
    for m in NAME_MARKERS:  # what stands before the last marker goes
        text = F.regexp_replace(text, f"^.*{m}", "")
    words = F.filter(F.split(text, " "), lambda w: w != "")
    last = let(words, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 7, F.lit(1)), F.lit(8)), " "))
    return strip_outer(last, " ,.;:-")


def _places(found: Column, text: Column) -> Column:
    """Where each of a pattern's successive matches begins (from 1): the first place of its text after the match before."""
    at = lambda raw, start: F.call_function("locate", raw, text, start)
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    step = lambda a, raw: F.struct((at(raw, a["next"]) + F.char_length(raw)).alias("next"), F.array_append(a["at"], at(raw, a["next"])).alias("at"))
    return F.aggregate(found, start, step, lambda a: a["at"])


def legal_name_for(text: Column, form: Column) -> Column:
    """The best plausible name that ends in ``form``: with a legal marker near its own place first, then the shortest, then the first."""
    quoted = F.regexp_replace(form, r"([.()&\\+*?\[\]{}^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"([A-ZÄÖÜa-z0-9][A-ZÄÖÜa-zäöüß0-9&.,\-\s]{2,80}"), quoted, F.lit(")"))

    def rated(raw: Column, i: Column, at: Column) -> Column:
        near = F.lower(F.substring(text, F.greatest(at - 80, F.lit(1)), F.char_length(raw) + F.least(at - 1, F.lit(80)) + 40))
        marked = F.exists(F.array(*map(F.lit, CONTEXT_MARKERS)), lambda m: near.contains(m))

        def row(name: Column) -> Column:
            score = F.when(marked, 20).otherwise(0) + F.when(F.lower(name).endswith(F.lower(form)), 5).otherwise(0)
            return F.struct((-score).alias("rank"), F.char_length(name).alias("size"), i.alias("i"), name.alias("name"))

        return let(clean_legal_name(raw), row)

    def best(found: Column) -> Column:
        rows = let(_places(found, text), lambda places: F.transform(found, lambda raw, i: rated(raw, i, F.get(places, i))))
        good = F.filter(rows, lambda r: plausible_legal_name(r["name"], form))
        return F.coalesce(F.array_min(good)["name"], F.lit(""))

    return F.when(form == "", "").otherwise(let(F.regexp_extract_all(text, pattern, F.lit(1)), best))


def company_identity(text: Column | str) -> Column:
    """struct(legal_name, legal_form) of a text: the first legal form's best name, else the fallback forms' in turn.

    One pass tells the texts that hold none of the forms, which is most of them.
    """
    out = lambda name, f: F.struct(name.alias("legal_name"), f.alias("legal_form"))

    def by_form(t: Column, f: str) -> Column:
        met = t.rlike(r"(?iu)\b" + f.replace(".", r"\.") + ("" if f.endswith(".") else r"\b"))
        return F.when(met, let(legal_name_for(t, F.lit(f)), lambda name: F.when(name != "", out(name, F.lit(f)))))

    def body(t: Column) -> Column:
        def formed(form: Column) -> Column:
            direct = let(legal_name_for(t, form), lambda name: F.when(name != "", out(name, form)))
            return F.coalesce(direct, *(by_form(t, f) for f in FALLBACK_FORMS), out(F.lit(""), form))

        return let(legal_form(t), formed)

    return let(clean_text(text), lambda t: F.when(t.rlike(ANY_FORM), body(t)).otherwise(out(F.lit(""), F.lit(""))))


_NAME = r"\s*([A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-\s.]{3,80})"
# Roles and the phrases that name them, in order.
ROLES = [
    ("Operator", r"(?iu)(?:run by|operated by|managed by|CEO(?:\s+(?:is|named))?|owner(?:\s+is)?)\s*:?" + _NAME),
    ("Geschaeftsfuehrer", r"(?iu)(?:Geschaeftsfuehrer(?:/in)?|Geschäftsführer(?:/in)?|Vertreten durch)\s*(?:ist|:)?" + _NAME),
    ("Inhaber", r"(?iu)(?:Inhaber|Inhaberin)\s*:?" + _NAME),
]
# Where a person's name ends, and what is no name.
NAME_ENDS = r"(?iu)(?:Telefon|E-Mail|Email|Register|USt|Ust-ID|Umsatzsteuer(?:-Identifikationsnummer)?|Umsatzsteueridentifikationsnummer|Adresse|Sitz|Impressum|Kontakt|The company|company's|registered|address|Sources?|managed by|website|offers|EU-STREITSCHLICHTUNG|Werderstr|Straße|Strasse|Street|HRB)\b"
SENTENCE_ENDS = r"(?:\.(?=\s+(?:The|This|Der|Die|Das|USt|Ust|Adresse|Register|Telefon|Email|E-Mail))|\||, und|, and)\s+"
NO_NAMES = ["einer", "eine", "einem", "wir", "kontakt", "impressum"]


def clean_person_name(value: Column) -> Column:
    text = F.get(F.split(clean_text(value), NAME_ENDS, 2), 0)
    text = F.get(F.split(text, SENTENCE_ENDS, 2), 0)
    text = F.get(F.split(text, r"(?i)\s+and\s+(?:offers|has|runs|operates|is)\b", 2), 0)
    text = F.regexp_replace(text, r"(?i)\s+(?:and|und)\s*$", "")
    text = F.regexp_replace(text, r"(?iu)^(?:ist|is|Geschäftsführer|Geschaeftsfuehrer|Inhaber|Inhaberin|Vertreten durch|managed by)\s*:?\s*", "")
    text = strip_outer(text, " ,.;")
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 5), " ")


def plausible_person_name(value: Column) -> Column:
    lower = F.lower
    return let(clean_text(value), lambda text: (text != "") & ~lower(text).isin(NO_NAMES) & ~lower(text).rlike("umsatzsteuer|identifikationsnummer|register|adresse") & text.contains(" ") & ~text.rlike(r"(?U)\d"))


def decision_maker(text: Column | str) -> Column:
    """struct(name, role, source, confidence) by the first role whose phrase is followed by a plausible name."""
    out = lambda name, role, source, share: F.struct(name.alias("name"), F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit(share).alias("confidence"))

    def by_role(t: Column, role: str, pattern: str) -> Column:
        return let(clean_person_name(F.regexp_extract(t, pattern, 1)), lambda name: F.when(plausible_person_name(name), out(name, role, "website_text", 0.95)))

    return let(clean_text(text), lambda t: F.coalesce(*(by_role(t, r, p) for r, p in ROLES), out(F.lit(""), "", "", 0.0)))


# Shapes of street and town, and where they end.
STREET = r"(?iu)\b((?:[A-Z][A-Za-z0-9.'\-]+\s+){0,2}[A-Z][A-Za-z0-9.'\-]*(?:strasse|str\.|straße|weg|allee|platz|ring|gasse)\s+\d+[a-zA-Z]?)"
STREET_END = r"(?iu)(?:strasse|str\.|straße|weg|allee|platz|ring|gasse)\s+\d"
TOWN = r"\b(\d{5}\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß .'\-]{2,60})"
STREET_STARTS = ["GmbH", "UG", "AG", "KG", "OHG", "GbR"]
TOWN_ENDS = ["Geschäftsführer", "Geschaeftsfuehrer", "Inhaber", "Telefon", "E-Mail", "Email"]


def address(text: Column | str) -> Column:
    """Street with number, and postal code with town, joined by a comma; blank if neither is found."""

    def body(t: Column) -> Column:
        street = F.when(t.rlike(STREET_END), clean_text(F.regexp_extract(t, STREET, 1))).otherwise("")  # words are tried from each place only where some street ends
        town = clean_text(F.regexp_extract(t, TOWN, 1))
        for m in STREET_STARTS:  # what stands before the first marker goes
            street = F.regexp_replace(street, f"^.*?{m}", "")
        for m in TOWN_ENDS:
            town = F.get(F.split(town, m, 2), 0)
        return F.array_join(F.filter(F.array(strip_outer(street, " ,.;:-"), strip_outer(town, " ,.;:-")), lambda p: p != ""), ", ")

    return let(clean_text(text), body)


# The label of a registration id and the words that may stand near one.
ID_LABELLED = r"(?i)(?:IK[ \-]?(?:Nr\.?|Nummer)?|Instituts(?:ions)?kennzeichen)\s*[:\.]?\s*(\d{9})"


def registration_id(text: Column | str, labelled: str = ID_LABELLED, words: tuple[str, ...] = ("institutionskennzeichen", "institutskennzeichen", " ik ", "ik-", "ik:"), digits: int = 9) -> Column:
    """Digits after an explicit label; else the first bare number of that length with a label in the 60 characters before it."""
    t = F.coalesce(as_col(text), F.lit(""))
    number = rf"\b\d{{{digits}}}\b"

    def bare(numbers: Column) -> Column:
        """The first number with a label in what stands before it: the number before ends that stretch, 60 characters at most."""
        labels = F.array(*map(F.lit, words))
        rows = let(F.split(t, number), lambda gaps: F.transform(numbers, lambda x, i: F.struct(F.lower(F.right(F.get(gaps, i), F.lit(60))).alias("before"), x.alias("number"))))
        fit = F.filter(rows, lambda r: F.exists(labels, lambda w: F.concat(r["before"], r["number"]).contains(w)))
        return F.when(F.size(numbers) == 0, "").otherwise(F.coalesce(F.get(fit, 0)["number"], F.lit("")))

    return let(F.regexp_extract(t, labelled, 1), lambda direct: F.when(direct != "", direct).otherwise(let(F.regexp_extract_all(t, F.lit(number), F.lit(0)), bare)))


# Claims of size.
SCALE_CLAIMS = [
    r"(?i)(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?)\s*(?:\+|plus)?\s*(?:mio\.?|millionen?)\s+(?:kunden|versicherte|patienten|nutzer)",
    r"(?i)(\d{1,3}(?:[.,]\d{3})*)\s*\+?\s*(kunden|versicherte|patienten|nutzer|menschen)",
    r"(?i)(\d{1,4})\s*\+?\s*(?:mitarbeiter|mitarbeitenden?|angestellte)",
    r"(?i)(\d{1,3})\s*\+?\s*(?:krankenkassen|pflegekassen|kassenpartner|vertragspartner)",
    r"(?i)(\d{1,3})\s*\+?\s*(?:standorte|niederlassungen|filialen)",
    r"(?iu)(bundesweit|deutschlandweit|europaweit|europaweit\s+t[äa]tig)",
]


def scale_claims(text: Column | str, patterns: list[str] = SCALE_CLAIMS) -> Column:
    """All matches of the patterns in turn, white space collapsed, distinct in order."""
    t = F.coalesce(as_col(text), F.lit(""))
    found = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in patterns)))
    return F.array_distinct(F.filter(F.transform(found, clean_text), lambda x: x != ""))
