"""Reading HTML with built-in functions.

The page rules are our own, documented here and in the README; they are not
output-equal to any readability library.

1. Drop comments, scripts, styles, navigation, headers, footers, asides, forms
   and ad boxes.
2. Main content is the ``article`` element, else ``main``, else ``body``, else
   the whole page.
3. Text: block tags become newlines, other tags vanish, entities are decoded,
   space is collapsed, empty lines go.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import first_nonempty, let, trim_space

# Element names, and the entities that the SQL of the queries decodes.
DROPPED_ELEMENTS = (
    "script", "style", "noscript", "template", "iframe", "svg",
    "nav", "header", "footer", "aside", "form",
)
BLOCK_TAGS = "address|article|blockquote|br|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|li|main|ol|p|pre|section|table|td|th|tr|ul"
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&hellip;", "…"),
    ("&middot;", "·"),
    ("&euro;", "€"),
)
# A title ends with its tag or, unclosed, with the page.
TITLE_TAG = r"(?is)<title(?:\s[^>]*)?>(.*?)(?:</title|\z)"
# What a title can't stand in.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
SCRIPTS = ("script", "style", "noscript", "template")
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
IMG_TAG = r"(?i)<img\b[^>]*>"


def _code_point(digits: Column, base: int) -> Column:
    point = F.lpad(F.conv(digits, base, 16), 8, "0")
    # Zero, surrogates and values past the last code point are no characters.
    broken = (point == "00000000") | point.between("0000D800", "0000DFFF") | (point > "0010FFFF")
    return F.when(broken, F.lit("\ufffd")).otherwise(F.decode(F.unhex(point), "UTF-32"))


def _named() -> Column:
    """All named references that HTML knows, as a map."""
    return F.from_json(
        F.lit(json.dumps({f"&{name}": char for name, char in html5.items() if name.endswith(";")})), "map<string,string>"
    )


def decode_entities(c: Column) -> Column:
    """Every character reference decoded once; unknown names stay."""
    return let(c, _decoded)


def _decoded(c: Column) -> Column:
    def char(ref: Column) -> Column:
        number = F.substring(ref, 2, 1) == "#"
        hexed = F.lower(F.substring(ref, 3, 1)) == "x"
        return (
            F.when(number & hexed, _code_point(F.regexp_extract(ref, "([0-9a-fA-F]+);", 1), 16))
            .when(number, _code_point(F.regexp_extract(ref, "([0-9]+);", 1), 10))
            .otherwise(F.coalesce(F.try_element_at(_named(), ref), ref))
        )

    found = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), char)
    between = F.split(c, REFERENCE, -1)
    joined = F.array_join(
        F.zip_with(between, found, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), ""
    )
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def html_title(html: Column) -> Column:
    """First non-empty ``<title>`` in document order, decoded and trimmed; else NULL.

    Comments and scripts hold no title.
    """
    out = F.regexp_replace(html, COMMENT, "")
    for name in SCRIPTS:
        out = _without(out, name)

    def title(out: Column) -> Column:
        later = F.get(
            F.filter(F.regexp_extract_all(out, F.lit(TITLE_TAG), F.lit(1)), lambda t: t != ""), F.lit(0)
        )
        return _first_match(out, [TITLE_TAG], later)

    return trim_space(decode_entities(let(out, title)))


def _without(html: Column, name: str) -> Column:
    """Without the elements of a name.  Most pages lack most of them, which is told faster than by the pattern."""
    return let(
        html,
        lambda h: F.when(
            F.contains(F.lower(h), F.lit(f"<{name}")), F.regexp_replace(h, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}>", "")
        ).otherwise(h),
    )


def _first_match(html: Column, patterns: list[str], otherwise: Column) -> Column:
    """The first group of the first pattern that finds one that isn't empty; no later pattern is tried."""
    if not patterns:
        return otherwise
    return let(
        F.regexp_extract(html, patterns[0], 1),
        lambda found: F.when(found != "", found).otherwise(_first_match(html, patterns[1:], otherwise)),
    )


def strip_images(html: Column) -> Column:
    return F.when(trim_space(html) == "", html).otherwise(F.regexp_replace(html, IMG_TAG, ""))


def drop_boilerplate(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in DROPPED_ELEMENTS:
        out = _without(out, name)
    return F.regexp_replace(
        out, r"""(?is)<div[^>]*class=["']?(?:ad|ads|advert|sponsor)[\s"'][^>]*>.*?</div>""", ""
    )


def main_content(html: Column) -> Column:
    """HTML of the main content after boilerplate removal."""
    patterns = [rf"(?is)<{name}(?:\s[^>]*)?>(.*)</{name}>" for name in ("article", "main", "body")]
    return trim_space(let(drop_boilerplate(html), lambda clean: _first_match(clean, patterns, clean)))


def plain_text(content: Column) -> Column:
    """Readable text of an HTML fragment."""
    lines = F.regexp_replace(content, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n")
    bare = F.regexp_replace(lines, r"<[^>]*>", "")
    spaced = F.regexp_replace(decode_entities(bare), r"[ \t\r\f ]+", " ")
    return trim_space(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"))


def _meta(html: Column, key: str, value: str) -> Column:
    return decode_entities(
        F.regexp_extract(
            html, rf"""(?is)<meta[^>]*{key}=["']{value}["'][^>]*content=["']([^"']*)["']""", 1
        )
    )


def excerpt(html: Column, text: Column) -> Column:
    """Meta description, else the first line of the text."""
    return F.coalesce(
        first_nonempty(_meta(html, "name", "description"), F.split_part(text, F.lit("\n"), F.lit(1))),
        F.lit(""),
    )


def lead_image(html: Column) -> Column:
    return _meta(html, "property", "og:image")


def byline(html: Column) -> Column:
    return _meta(html, "name", "author")
