"""String functions of the search, selection and link operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separator between indexed words, and what stands for a blank inside one.
SEPARATOR, BLANK = "⁠", " "
#: Fixed value: the link pattern.
URL = r"(((https?|ftps?):\/\/)|www\.)(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?::(?:0|[1-9]\d{0,3}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5]))?(?:\/(?:[-a-zA-Z0-9@%_\+.~#?&=]+\/?)*)?"
#: Source labels of each block type; any other label is text.
LABELS = {
    "title": ["paragraph_title", "title", "section_title"],
    "image": ["figure", "image", "picture", "photo"],
    "table": ["table", "tabular"],
    "caption": ["figure_footnote", "table_footnote", "caption", "image_caption", "table_caption"],
}
#: Schemes that may be opened, units of sizes.
SCHEMES = ["ftp", "http", "https", "mailto", "tel", "imap", "file"]
SIZES = ["bytes", "KB", "MB", "GB", "TB", "PB", "EB"]


def is_punctuation(s: Column) -> Column:
    """Also true of the empty string."""
    return s.rlike(r"^\p{P}*$")


def is_separator(s: Column) -> Column:
    return s.rlike(r"^\p{Z}*$")


def clean_query(query: str) -> tuple[str, int]:
    """The query as the index spells it (punctuation apart, blanks replaced) and its number of words."""
    import unicodedata

    out = []
    for i, c in enumerate(query):
        if unicodedata.category(c).startswith("P"):
            out += [SEPARATOR * (i != 0), c, SEPARATOR * (i < len(query) - 1)]
        else:
            out.append(c)
    text = "".join(out)
    count = text.count(SEPARATOR) + 1 - text.startswith(SEPARATOR) - text.endswith(SEPARATOR)
    return text.replace(" ", BLANK), count


def index_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.translate(w, SEPARATOR + " ", BLANK * 2)), SEPARATOR)


def snippet(text: Column, at: Column) -> Column:
    """40 characters from 10 before ``at`` (0-based)."""
    return F.substring(text, F.greatest(at - 10, F.lit(0)) + 1, F.lit(40))


def shown(sample: Column) -> Column:
    return F.concat(F.lit("..."), F.translate(sample, SEPARATOR, " "), F.lit("..."))


def link(s: Column) -> Column:
    """The first link in ``s``, or the empty string."""
    may = s.contains("://") | s.contains("www.")
    return F.when(may, F.regexp_extract(s, URL, 0)).otherwise("")


def block_type(label: Column) -> Column:
    out = F.lit(None)
    known = F.lower(F.trim(label))
    for name, labels in LABELS.items():
        out = F.coalesce(out, F.when(known.isin(labels), F.lit(name)))
    return F.coalesce(out, F.lit("text"))


def allowed_uri(uri: Column) -> Column:
    """The URI that may be opened; null if none.

    Without a colon it gets http:// before it, unless it begins with http. Else what stands before the
    first colon must be one of ``SCHEMES``, letter by letter; a file needs a path.
    """
    scheme = F.substring_index(uri, ":", 1)
    path = F.regexp_replace(F.substring(uri, 6, 1 << 30), "^/{0,2}", "")
    known = scheme.isin([x for x in SCHEMES if x != "file"]) | ((scheme == "file") & (F.trim(path) != ""))
    bare = F.when(~uri.startswith("http") & (uri != ""), F.concat(F.lit("http://"), uri))
    return F.when(~uri.contains(":"), bare).when(known, uri)


def normalised_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; NaN if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(float("nan"))).otherwise(F.levenshtein(a, b) / F.when(longest > 0, longest))


def ends_hyphenated(s: Column) -> Column:
    return s.rlike(r"[\p{Pc}\p{Pd}]$")


def no_space_after(s: Column) -> Column:
    return s.rlike(r"[\p{Ps}\p{Pi}\p{Pd}\p{Pc}]$")


def no_space_before(s: Column) -> Column:
    return s.rlike(r"^[\p{Pe}\p{Pf}\p{Po}\p{Pd}\p{Sm}\p{Sc}]")


def readable_size(n: Column) -> Column:
    """Bytes with one decimal; a unit up where it would show 1000 or more."""
    size = F.abs(n).cast("double")
    mag = F.when(size > 0, F.floor(F.log2(F.when(size > 0, size)) / 10)).otherwise(0)
    shown = size / F.pow(F.lit(1024.0), mag)
    up = F.round(shown, 1) >= 1000
    mag, shown = mag + up.cast("int"), F.when(up, shown / 1024).otherwise(shown)
    units = F.array(*[F.lit(u) for u in SIZES])
    return F.concat(F.when(n < 0, "-").otherwise(""), F.format_number(shown, 1), F.lit(" "), F.get(units, mag.cast("int")))


def safe_name(name: Column, substitute: str = "_") -> Column:
    return F.regexp_replace(name, r'[\x00-\x1f"<>|:*?\\/]', substitute)


def log_name(name: Column) -> Column:
    return F.rpad(name, 15, " ")


def pdf_date(raw: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss +hh:mm of D:yyyyMMddHHmmss+hh'mm'; other text as it is."""
    s = F.regexp_replace(raw, r"^D:", "")
    p = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:Z|([+-])(\d{2})'?(\d{2})?'?)?"
    g = lambda i: F.regexp_extract(s, p, i)
    plain = F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), g(4), F.lit(":"), g(5), F.lit(":"), g(6))
    sign = F.when(g(7) == "", "+").otherwise(g(7))
    offset = F.concat(sign, F.lpad(g(8), 2, "0"), F.lit(":"), F.lpad(g(9), 2, "0"))
    good = s.rlike(p) & F.try_to_timestamp(plain).isNotNull()
    return F.when(good, F.concat(plain, F.lit(" "), offset)).otherwise(raw)


def page_ranges(expression: Column, total: Column) -> Column:
    """Sorted distinct pages of "1-3, 5"; null if none is left.

    Both ends of a range are clamped to the pages there are, single pages beyond them are ignored, and so
    is what is no number or range. A dash at the start belongs to the number.
    """
    parts = F.transform(F.split(expression, ","), lambda p: F.trim(p))

    def pages(p: Column) -> Column:
        dash = F.instr(p, "-")
        number = lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("int"))
        clamped = lambda x: F.least(F.greatest(x, F.lit(1)), total)
        a, b = number(F.substring(p, F.lit(1), dash - 1)), number(F.substring(p, dash + 1, F.length(p)))
        single = F.when((dash <= 1) & number(p).between(1, total), F.array(number(p)))
        low, high = F.when(b.isNotNull(), clamped(a)), F.when(a.isNotNull(), clamped(b))
        span = F.when((dash > 1) & (low <= high), F.sequence(low, F.greatest(low, high)))
        return F.coalesce(single, span, F.array().cast("array<int>"))

    out = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    return F.when(F.size(out) > 0, out)
