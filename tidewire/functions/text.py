"""String rules: ids, fallback chains, metadata and publishing text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published texts, tags, limits and defaults.
SOURCES_HEADING = "Sources:\n"
SINGLE_SOURCE_LABEL = "🔗 Source: "
PUBLISH_FOOTER = "📱 Follow for daily tech updates!\n#tech #ai #technology #shorts"
PUBLISH_TAGS = [
    "tech news",
    "AI",
    "technology",
    "artificial intelligence",
    "tech shorts",
    "daily tech",
]
PUBLISH_CATEGORY = "28"
DEFAULT_SOURCE_URL = "https://example.com/article"
UPLOAD_FOOTER = "Follow for daily tech updates!\n#tech #ai #technology #shorts"
UPLOAD_TAGS = ["tech", "AI", "shorts"]
TITLE_WORDS = 10
TITLE_LIMIT = 100
PREVIEW_LIMIT = 200
EDGE_SPACE = r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+\z"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once.  Else it is computed again behind every condition that names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def nonempty(c: Column) -> Column:
    """NULL for the empty string, so that it falls through a ``coalesce``."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in cols])


def trim_space(c: Column) -> Column:
    """Strip every Unicode white space from both ends."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def article_id(source: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``source``."""
    return F.substring(F.sha2(F.encode(source, "UTF-8"), 256), 1, 16)


def id_source(link: Column, guid: Column, title: Column) -> Column:
    return first_nonempty(link, guid, title)


def feed_item_id(link: Column, guid: Column, title: Column) -> Column:
    """Article id of a feed item; an item with nothing to hash has the id ''."""
    return F.coalesce(article_id(id_source(link, guid, title)), F.lit(""))


def summary(description: Column, content: Column) -> Column:
    return F.coalesce(first_nonempty(description, content), F.lit(""))


def embed_text(text: Column, html: Column, summary_: Column, title: Column) -> Column:
    """Text that is compared between articles; '' when there is none."""
    return F.coalesce(first_nonempty(text, html, summary_, title), F.lit(""))


def stored_body(text: Column, html: Column, summary_: Column) -> Column:
    """Text written into a story; unlike ``embed_text`` never the title."""
    return F.coalesce(first_nonempty(text, html, summary_), F.lit(""))


def enrich_fill(old: Column, extracted: Column) -> Column:
    """Keep what the feed said, else take what the page said."""
    return F.coalesce(first_nonempty(old, extracted), F.lit(""))


def truncate_ellipsis(title: Column, limit: int = TITLE_LIMIT) -> Column:
    return F.when(
        F.length(title) > limit, F.concat(F.substring(title, 1, limit - 3), F.lit("..."))
    ).otherwise(title)


def title_from_words(words: Column) -> Column:
    """Title of the first ten caption words; each keeps its following space."""
    head = F.transform(F.slice(words, 1, TITLE_WORDS), lambda w: F.concat(w["text"], F.lit(" ")))
    return truncate_ellipsis(F.array_join(head, ""))


def title_choice(given: Column, page_title: Column, words: Column) -> Column:
    return F.coalesce(first_nonempty(given, page_title), title_from_words(words))


def source_url(given: Column) -> Column:
    return F.coalesce(nonempty(given), F.lit(DEFAULT_SOURCE_URL))


def publish_description(urls: Column, source: Column) -> Column:
    """List of sources, or the one source, followed by the fixed footer."""
    listed = F.concat(
        F.lit(SOURCES_HEADING),
        F.array_join(F.transform(urls, lambda u: F.concat(u, F.lit("\n"))), ""),
        F.lit("\n"),
    )
    single = F.concat(F.lit(SINGLE_SOURCE_LABEL), source, F.lit("\n\n"))
    section = (
        F.when(F.coalesce(F.size(urls), F.lit(0)) > 0, listed)
        .when(nonempty(source).isNotNull(), single)
        .otherwise("")
    )
    return F.concat(section, F.lit(PUBLISH_FOOTER))


def publish_tags() -> Column:
    return F.array(*[F.lit(t) for t in PUBLISH_TAGS])


def parse_tags(raw: Column) -> Column:
    """Comma list, trimmed, empties dropped; the default tags when none is left."""
    parts = F.filter(
        F.transform(F.split(raw, ","), trim_space), lambda t: F.length(t) > 0
    )
    default = F.array(*[F.lit(t) for t in UPLOAD_TAGS])
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, parts).otherwise(default)


def upload_title(title: Column, path: Column) -> Column:
    """Given title, else the file name without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.coalesce(nonempty(trim_space(title)), stem)


def upload_description(description: Column, title: Column, source: Column) -> Column:
    with_source = F.when(
        nonempty(trim_space(source)).isNotNull(),
        F.concat(F.lit("Source: "), source, F.lit("\n\n")),
    ).otherwise("")
    default = F.concat(title, F.lit("\n\n"), with_source, F.lit(UPLOAD_FOOTER))
    return F.coalesce(nonempty(trim_space(description)), default)


def key_prefix(prefix: Column) -> Column:
    return F.when(
        (prefix != "") & ~F.endswith(prefix, F.lit("/")), F.concat(prefix, F.lit("/"))
    ).otherwise(prefix)


def object_key(prefix: Column, id_: Column) -> Column:
    return F.concat(key_prefix(prefix), id_)


def export_key(prefix: Column, id_: Column) -> Column:
    """Key of an exported article: slashes around the prefix collapse to one behind it."""
    bare = F.regexp_replace(trim_space(prefix), r"^/+|/+\z", "")
    return F.concat(
        F.when(bare != "", F.concat(bare, F.lit("/"))).otherwise(""),
        F.lit("articles/"),
        id_,
        F.lit(".json"),
    )


def error_envelope(body: Column) -> Column:
    """``error: message`` of a JSON object, either one alone, else NULL."""
    parsed = F.when(F.startswith(body, F.lit("{")), F.try_parse_json(body))
    parts = []
    for field in ("error", "message"):
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
        ok = kind.isNull() | kind.isin("STRING", "VOID")
        parts.append((ok, nonempty(F.try_variant_get(parsed, f"$.{field}", "string"))))
    well_typed = parts[0][0] & parts[1][0]
    return F.when(well_typed, nonempty(F.concat_ws(": ", parts[0][1], parts[1][1])))


def preview(text: Column, limit: int = PREVIEW_LIMIT) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def percent(score: Column) -> Column:
    return F.round(score * 100, 2)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance
