"""Text preparation as Catalyst expressions: no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from passagery import constants as K

CONTROL = "".join(chr(i) for i in range(33))
WIDE_SPACE = "[^\\s\\u001c-\\u001f\\u1680\\u2000-\\u2006\\u2008-\\u200a\\u2028\\u2029\\u205f\\u3000]"
TOKEN = "[\\p{L}\\p{N}]+"


def trim_control(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(text, F.lit(CONTROL))


def is_blank(text: Column) -> Column:
    """Null, empty, or only white space in the Unicode sense."""
    return text.isNull() | ~text.rlike(WIDE_SPACE)


def null_if_blank(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def split_literal(text: Column, delimiter: str) -> Column:
    """Split on a literal delimiter, keeping empty parts."""
    return F.split(text, "\\Q" + delimiter + "\\E", -1)


def clean_text(text: Column) -> Column:
    """One line-end convention, at most one blank line in a row, no outer white space."""
    unix = F.regexp_replace(text, "\\r\\n?", "\n")
    return trim_control(F.regexp_replace(unix, "\\n{3,}", "\n\n"))


def is_title_line(line: Column) -> Column:
    return (F.length(line) <= K.TITLE_MAX) & line.rlike("^(?:" + K.TITLE_FORMS + ").*$")


def split_paragraphs(cleaned: Column) -> Column:
    """Paragraphs end at blank lines and before numbered headings; lines are trimmed.

    Three linear regex passes: trim the lines, open a gap before each heading line, cut at gaps.
    """
    edge = "[\\x00-\\x09\\x0b-\\x20]*\\n[\\x00-\\x09\\x0b-\\x20]*"
    lines = trim_control(F.regexp_replace(cleaned, edge, "\n"))
    heading = (
        "\\n(?=[^\\n]{1," + str(K.TITLE_MAX) + "}(?:\\n|\\z))"
        "(?=(?:" + K.TITLE_FORMS + ")[^\\n\\r\\u0085\\u2028\\u2029]*(?:\\n|\\z))"
    )
    gaps = F.regexp_replace(lines, heading, "\n\n")
    return F.filter(F.split(gaps, "\\n{2,}", -1), lambda p: p != "")


def split_oversized(text: Column, limit: int) -> Column:
    """Cut at the last sentence end inside each window of `limit` characters, else hard. A window is read forward once."""
    pattern = f"(?s).{{1,{limit}}}(?:\\z|(?<=[{K.SENTENCE_ENDS}]))|.{{1,{limit}}}"
    pieces = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.filter(F.transform(pieces, trim_control), lambda p: p != "")


def split_hard(text: Column, limit: int, overlap: int) -> Column:
    """Windows of `limit` characters that step `limit - overlap`, so that every character is covered."""
    step = max(limit - overlap, 1)
    last = F.greatest(F.ceil((F.length(text) - limit) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(limit)))


def split_hard_lossy(text: Column, limit: int, overlap: int) -> Column:
    """The compatibility form: windows step `limit` but start `overlap` early, so tails can be lost."""
    last = F.ceil(F.length(text) / F.lit(float(limit))).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(text, F.greatest(i * limit - overlap, F.lit(0)) + 1, F.lit(limit)),
    )


def java_string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash as hex without leading zeros."""
    code = F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )
    return F.lower(F.hex(F.when(text == "", F.lit(0).cast("bigint")).otherwise(code)))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def estimate_tokens(text: Column) -> Column:
    """One token per CJK ideograph plus one per four other characters."""
    body = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(body, F.lit("[\\u4e00-\\u9fff]"))
    return (cjk + F.floor((F.length(body) - cjk) / 4)).cast("int")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def token_text(text: Column) -> Column:
    """Lower-cased text whose `tokens` are its runs of ASCII letters, ASCII digits and characters beyond ASCII: other
    characters beyond ASCII are spaces. Plain ASCII needs no regular expression."""
    low = F.lower(text)
    plain = F.octet_length(low) == F.length(low)
    return F.when(plain, low).otherwise(F.regexp_replace(low, "[^\\x00-\\x7f\\p{L}\\p{N}]+", " "))


def file_extension(name: Column) -> Column:
    """Text after the last dot, lower case; empty when there is no dot."""
    return F.coalesce(F.lower(F.regexp_extract(name, "\\.([^.]*)\\z", 1)), F.lit(""))


def content_type(name: Column) -> Column:
    """Extension when a dot exists past the first character, else `unknown`."""
    has_dot = name.rlike("(?s)^.+\\.[^.]*\\z")
    return F.when(has_dot, file_extension(name)).otherwise(F.lit("unknown"))


def file_type(name: Column) -> Column:
    known = [F.lit(x) for pair in ((e, e.upper()) for e in K.PARSER_BY_EXTENSION) for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*known), file_extension(name)), F.lit("UNKNOWN"))


def route_parser(name: Column, override: Column | None = None, pdf_provider: str = "layout") -> Column:
    """Parser kind by extension; an explicit layout-model request wins; unknown types are read as text."""
    table = dict(K.PARSER_BY_EXTENSION)
    table["pdf"] = "mixed" if pdf_provider.lower().endswith("mixed") else "layout"
    routes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    kind = F.coalesce(F.try_element_at(routes, file_extension(name)), F.lit("text"))
    if override is None:
        return kind
    return F.when(F.lower(trim_control(override)) == K.LAYOUT_OVERRIDE, F.lit("layout")).otherwise(kind)


def clean_ocr_text(raw: Column) -> Column:
    """Drop coordinate boxes and tags, keep the words inside reference tags, squeeze line gaps."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\\[\\[\\s*\\d+(?:\\s*,\\s*\\d+){3}\\s*\\]\\]", "")
    text = F.regexp_replace(text, "<\\|ref\\|>(.*?)<\\|/ref\\|>", "$1")
    text = F.regexp_replace(text, "<\\|/?[a-zA-Z_]+\\|>", "")
    return trim_control(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def is_meaningful(text: Column) -> Column:
    rest = F.length(F.regexp_replace(text, K.OCR_NOISE, ""))
    return F.coalesce(rest >= K.OCR_MIN_CHARS, F.lit(False))


BLOCK_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li"
    "|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
NAMED_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def decode_numeric_entities(text: Column) -> Column:
    """Replace `&#NNN;` and `&#xHH;` by their characters."""
    mark = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    pieces = F.split(text, mark, -1)
    codes = F.transform(
        F.regexp_extract_all(text, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), 1),
        lambda c: F.when(
            c.rlike("^[xX]"), F.conv(F.substring(c, 2, 9), 16, 10)
        ).otherwise(c).cast("int"),
    )
    chars = F.transform(
        codes,
        lambda n: F.when(
            (n > 0) & (n < 1114112) & ~n.between(55296, 57343),
            F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"),
        ).otherwise(F.lit("")),
    )
    joined = F.array_join(F.zip_with(pieces, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(text.rlike(mark), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Body text of a page: no head, scripts, styles or comments; block elements break lines."""
    text = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, "(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, "(?is)<head(?:\\s[^>]*)?>.*?</head>", " ")
    text = F.regexp_replace(text, "(?i)</?(?:" + BLOCK_TAGS + ")(?:\\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    text = decode_numeric_entities(text)
    for name, char in NAMED_ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    text = F.regexp_replace(text, "[ \\t\\r\\f\\x0b]+", " ")
    text = F.regexp_replace(text, " ?\\n ?", "\n")
    return trim_control(F.regexp_replace(text, "\\n{2,}", "\n"))
