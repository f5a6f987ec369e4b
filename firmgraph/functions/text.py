"""Normalisation of names, addresses, phone numbers and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmgraph.functions.dims import FREE_MAIL_DOMAINS, GENERIC_CORES, INDUSTRIES, INDUSTRY_ENDINGS, LEGAL_FORMS, PREFECTURES

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
SPACE = r"[\s　 ]"
DASHES = "[ー−‐―—－]"


def let(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_width(s: Column) -> Column:
    """Full-width ASCII and the ideographic space become ASCII."""
    return F.translate(s, WIDE, NARROW)


def without_legal_form(s: Column) -> Column:
    return F.trim(F.regexp_replace(half_width(s), f"(?i){LEGAL_FORMS}", ""))


def company_name(s: Column) -> Column:
    """The key by which names are compared: no legal form, spaces or punctuation, lower case."""
    bare = F.regexp_replace(F.regexp_replace(half_width(s), f"(?i){LEGAL_FORMS}", ""), f"{SPACE}+", "")
    return F.trim(F.lower(F.regexp_replace(bare, r"[・･\.．,，、。「」『』【】\[\]()（）\-‐－―—_＿'\"’”`~〜～]", "")))


def company_core(s: Column) -> Column:
    """A name without up to three endings that say the industry; null if under two letters or a mere place."""
    core = without_legal_form(s)
    for _ in range(3):
        core = F.regexp_replace(core, f"({INDUSTRY_ENDINGS})$", "")
    return F.when((F.length(core) >= 2) & ~core.isin(GENERIC_CORES), core)


def name_tokens(s: Column) -> Column:
    """Distinct runs of three or more ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(without_legal_form(s)), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def block_numbers(s: Column) -> Column:
    """Block numbers in kanji or digits (below 100) before 丁目 become digits and a hyphen."""
    one = "[一二三四五六七八九1-9]"
    for pattern, to in ((f"({one})十({one})丁目", "$1$2丁目"), (f"({one})十丁目", "$10丁目"), (f"十({one})丁目", "1$1丁目"), ("十丁目", "10丁目")):
        s = F.regexp_replace(s, pattern, to)
    for digit, kanji in enumerate("〇一二三四五六七八九"):
        s = F.regexp_replace(s, f"{kanji}(?=[〇一二三四五六七八九0-9]*丁目)", str(digit))
    return F.regexp_replace(s, "([0-9]+)丁目", "$1-")


def address(s: Column) -> Column:
    """The key by which addresses are compared: no postal code or spaces, block numbers joined by hyphens."""
    x = F.regexp_replace(F.regexp_replace(half_width(s), r"〒?\d{3}-?\d{4}", ""), f"{SPACE}+", "")
    x = block_numbers(x)
    for pattern, to in ((r"(\d+)番地?(\d+)号?", "$1-$2"), (r"(\d+)番地?", "$1"), (r"(\d+)号", "$1"), (DASHES, "-"), ("-+", "-"), ("-$", "")):
        x = F.regexp_replace(x, pattern, to)
    return F.when(F.length(s) > 0, F.lower(x))


def prefecture(s: Column) -> Column:
    """The first prefecture, by code, that the address contains."""
    return let(half_width(s), lambda x: F.coalesce(*[F.when(x.contains(p), F.lit(p)) for p in PREFECTURES]))


def prefecture_code(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, PREFECTURES)), name)
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def city(s: Column) -> Column:
    """The municipality that follows the prefecture."""
    x = F.trim(F.regexp_replace(half_width(s), r"〒?\d{3}-?\d{4}", ""))
    found = prefecture(x)
    rest = F.when(found.isNotNull(), F.substring(x, F.instr(x, found) + F.length(found), F.length(x))).otherwise(x)
    return F.nullif(F.regexp_extract(rest, "^(.+?郡.+?[町村]|.+?市.+?区|.+?[市区町村])", 1), F.lit(""))


def address_keys(s: Column) -> Column:
    """Beginnings of an address, with and without the prefecture, by which a page shows it; of six letters at least."""
    def of(found: Column) -> Column:
        bare = address(F.replace(s, F.coalesce(found, F.lit("\u0000")), F.lit("")))
        return F.array_compact(F.array(F.substring(address(s), 1, 12), F.when(found.isNotNull(), F.substring(bare, 1, 10))))

    return F.array_distinct(F.filter(let(prefecture(s), of), lambda k: F.length(k) >= 6))


def appears(keys: Column, text: Column) -> Column:
    """Whether a key, or (from eight letters) a key with one other letter, stands in a normalised text.

    A key with one other letter has one of its halves unchanged, so a pattern is built and compiled only where a half stands in the text.
    """

    def one_off(k: Column) -> Column:
        half = F.floor(F.length(k) / 2).cast("int")
        near = F.contains(text, F.substring(k, F.lit(1), half)) | F.contains(text, F.substring(k, half + 1, F.length(k)))
        letters = F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.regexp_replace(F.substring(k, i, F.lit(1)), r"([\W_])", r"\\$1"))
        other = lambda e: F.transform(e, lambda _, i: F.concat(F.array_join(F.slice(e, F.lit(1), i), ""), F.lit("."), F.array_join(F.slice(e, i + 2, F.size(e)), "")))
        return near & F.regexp_like(text, F.array_join(let(letters, other), "|"))

    exact = F.exists(keys, lambda k: F.contains(text, k))
    return F.coalesce(exact | F.exists(keys, lambda k: (F.length(k) >= 8) & one_off(k)), F.lit(False))


def phone(s: Column) -> Column:
    """A number of 10 or 11 digits, with its hyphens if it has any; else null."""
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    checked = lambda x: F.when(F.length(digits(x)).between(10, 11), F.when(x.contains("-"), x).otherwise(digits(x)))
    return let(F.regexp_replace(F.regexp_replace(half_width(s), r"[()（）\s]", ""), DASHES, "-"), checked)


def corporate_number(s: Column) -> Column:
    digits = F.regexp_replace(half_width(s.cast("string")), r"\D", "")
    return F.when(F.length(digits) == 13, digits)


def employee_count(s: Column) -> Column:
    """The first number of a text, without thousands separators; zero and none are null."""
    n = F.regexp_extract(F.regexp_replace(half_width(s.cast("string")), ",", ""), r"\d+", 0)
    return F.nullif(F.when(n != "", n.try_cast("long")), F.lit(0))


def collapse_whitespace(s: Column) -> Column:
    x = F.regexp_replace(s, "\r", "")
    x = F.regexp_replace(x, r"[ \t\f 　]+", " ")
    x = F.regexp_replace(x, " *\n *", "\n")
    return F.trim(F.regexp_replace(x, "\n{3,}", "\n\n"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 for empty names and lengths more than four apart."""
    far = (F.abs(F.length(a) - F.length(b)) > 4) | (a == "") | (b == "")
    return F.when(a == b, 1.0).when(far, 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def names_related(a: Column, b: Column) -> Column:
    held = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))
    return F.coalesce((a != "") & (b != "") & ((a == b) | held | (similarity(a, b) >= 0.6)), F.lit(False))


def industry(s: Column) -> Column:
    """The first industry one of whose words the text contains."""
    return F.coalesce(*[F.when(F.greatest(*[F.contains(s, F.lit(w)).cast("int") for w in words.split()], F.lit(0)) == 1, F.lit(key)) for key, words in INDUSTRIES])


def normal_date(s: Column) -> Column:
    """YYYY-MM-DD of a date with any separators; missing parts are 01."""
    x = half_width(s)
    part = lambda i: F.regexp_extract(x, r"(\d{4})(?:[-./年](?:(\d{1,2})(?:[-./月](\d{1,2}))?)?)?", i)
    two = lambda i: F.lpad(F.when(part(i) == "", "1").otherwise(part(i)), 2, "0")
    return F.when(part(1) != "", F.concat_ws("-", part(1), two(2), two(3)))


def redact_secrets(s: Column, limit: int = 300) -> Column:
    """Connection strings and URLs become ***."""
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"postgres(ql)?://\S+", "***"), r"https?://\S+", "***"), 1, limit)


#: A mail address within a letter, and a Latin word of it.
MAIL_IN_TEXT = r"[\w.+-]+@[\w-]+\.[\w.-]{2,}"
LATIN_WORD = "[A-Za-z][A-Za-z'-]{1,}"


def foreign_words(s: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Distinct Latin words, with inner hyphens and apostrophes, that are not all capitals nor allowed, after taking out addresses."""
    bare = F.regexp_replace(F.regexp_replace(s, MAIL_IN_TEXT, " "), r"https?://\S+", " ")
    known = [w.lower() for w in allowed]
    return F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(LATIN_WORD), F.lit(0)), lambda w: ~w.rlike("^[A-Z0-9-]+$") & ~F.lower(w).isin(known)))


EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def emails(s: Column) -> Column:
    """Distinct addresses in order, without file names, placeholders and version numbers."""
    plain = F.transform(F.regexp_extract_all(half_width(s), F.lit(EMAIL), F.lit(0)), lambda e: F.regexp_replace(F.lower(e), "^[._-]+", ""))
    good = lambda e: ~(e.rlike(r"\.(png|jpe?g|gif|svg|webp|css|js)$") | e.rlike("^(example|sample|test|xxx|your|name|user|mail|email|info@example)") | e.rlike(r"@(example|sample|test)\.") | e.rlike(r"@\d+\.\d+")) & (F.length(e) <= 100)
    hidden = r"(?i)([a-zA-Z0-9._%+-]+)\s*[\[（(【]\s*(?:at|アット|＠)\s*[\]）)】]\s*([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
    shown = F.transform(F.regexp_extract_all(half_width(s), F.lit(hidden), F.lit(0)), lambda e: F.lower(F.regexp_replace(e, hidden, "$1@$2")))
    return F.array_distinct(F.concat(F.filter(plain, good), F.filter(shown, lambda e: ~e.rlike("^(example|sample|test|xxx|your|name|user|mail|email)"))))


def phones(s: Column) -> Column:
    """Distinct domestic numbers of 10 or 11 digits, in order."""
    found = F.regexp_extract_all(half_width(s), F.lit(r"0\d{1,4}[-‐−ー－(（]?\d{1,4}[-‐−ー－)）]?\d{3,4}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, phone), lambda p: p.isNotNull() & F.regexp_replace(p, r"\D", "").rlike("^0[1-9]")))


def company_email(found: Column, site: Column, free: tuple[str, ...] = FREE_MAIL_DOMAINS) -> Column:
    """The first address of the site's own domain, else the first free-mail address, else null."""
    domain = lambda e: F.substring_index(e, "@", -1)
    own = lambda e: (domain(e) == site) | F.endswith(domain(e), F.concat(F.lit("."), site)) | F.endswith(site, F.concat(F.lit("."), domain(e)))
    return F.coalesce(F.get(F.filter(found, own), F.lit(0)), F.get(F.filter(found, lambda e: domain(e).isin(list(free))), F.lit(0)))
