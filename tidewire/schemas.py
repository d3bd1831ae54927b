"""Record shapes shared by sources, plans and sinks, as DDL strings."""

ARTICLE = (
    "id string, title string, url string, published_at timestamp, fetched_at timestamp, "
    "summary string, author string, categories array<string>, full_content string, "
    "full_content_text string, excerpt string, image_url string, extraction_error string"
)

CAPTION_WORD = "struct<text:string,start:double,end:double>"

# Remembered URLs and titles.
SEEN = "kind string, value string"

# One row per segment of a story.
STORY_SEGMENT = "id string, run long, seq long, title string, text string"
# A segment in the log: ``starts`` marks the first of a story, which replaces any before it.
STORY_LOG = f"{STORY_SEGMENT}, starts boolean"

MESSAGE_ENVELOPE = "topic string, partition int, offset bigint, key string, value string"
