"""Messages: decoding, type checks, and the places they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.times import parse_rfc3339
from tidewire.schemas import CAPTION_WORD

# Topics and the types a field may have in JSON.
DEFAULT_TOPIC = "video-processing-requests"
TEXT_FIELDS = ("uuid", "voiceover", "status", "error", "title", "source_url")
NUMBER_KINDS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)\z"


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    """Type of a JSON value; a missing or null value counts as VOID."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_text(v: Column) -> Column:
    return _kind(v).isin("STRING", "VOID")


def _is_number(v: Column) -> Column:
    return _kind(v).rlike(NUMBER_KINDS)


def _absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _elements(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _entries(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def _list_of(v: Column, path: str, ok) -> Column:
    """The field is absent, or a list whose elements all pass."""
    return _absent(_field(v, path)) | F.coalesce(F.forall(_elements(v, path), ok), F.lit(False))


def _is_word(w: Column) -> Column:
    known = _is_text(_field(w, "$.text")) & _is_number(_field(w, "$.start")) & _is_number(_field(w, "$.end"))
    return F.is_variant_null(w) | (_entries(w, "$").isNotNull() & known)


def well_typed(v: Column) -> Column:
    """No field of the message has a wrong JSON type.

    Casting would turn ``{"uuid": 5}`` into the text "5"; such a message is
    refused as a whole, as a strict decoder does.
    """
    checks = [F.is_variant_null(v) | _entries(v, "$").isNotNull()]
    checks += [_is_text(_field(v, f"$.{name}")) for name in TEXT_FIELDS]
    checks += [
        _list_of(v, "$.subtitle_timestamps", _is_word),
        _list_of(v, "$.article_urls", _is_text),
        _absent(_field(v, "$.resource_timestamps")) | _entries(v, "$.resource_timestamps").isNotNull(),
        _absent(_field(v, "$.timings"))
        | F.coalesce(F.forall(F.map_values(_entries(v, "$.timings")), _is_number), F.lit(False)),
    ]
    return reduce(lambda x, y: x & y, checks)


def parse_once(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the value parsed into a VARIANT, NULL if it is no JSON.

    The outer generator is a fence.  Without it a filter on anything read from
    the parsed value is pushed below the parse, with one more parse per mention.
    """
    return df.select(*df.columns, F.explode_outer(F.array(F.try_parse_json(value))).alias(out))


def decode(envelopes: DataFrame, value: str = "value") -> DataFrame:
    """Typed message columns beside the envelope, plus ``decode_error``.

    Missing fields are NULL.
    """
    parsed = parse_once(envelopes, value, "_p")
    good = F.coalesce(F.col("_p").isNotNull() & well_typed(F.col("_p")), F.lit(False))
    typed = parsed.withColumn("_v", F.when(good, F.col("_p")))

    def text(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "string").alias(name)

    return typed.select(
        *envelopes.columns,
        *[text(name) for name in TEXT_FIELDS],
        F.try_variant_get("_v", "$.subtitle_timestamps", f"array<{CAPTION_WORD}>").alias(
            "subtitle_timestamps"
        ),
        F.to_json(_field(F.col("_v"), "$.resource_timestamps")).alias("resource_timestamps"),
        F.try_variant_get("_v", "$.article_urls", "array<string>").alias("article_urls"),
        F.try_variant_get("_v", "$.timings", "map<string,double>").alias("timings"),
        F.when(F.col("_v").isNull(), "cannot decode message").alias("decode_error"),
    )


def read_message_files(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """``file, value``: every ``*.json`` and ``*.txt`` file is one message.

    With ``nested`` those of all folders below as well, which are listed by tasks.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{json,txt}", recursiveFileLookup=nested)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def json_dir_scan(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Decoded messages of a directory; a bad file is an error of that file only."""
    rows = decode(read_message_files(spark, path, nested))
    return rows.withColumn(
        "file_error",
        F.coalesce(
            "decode_error",
            F.when(
                ~F.coalesce(F.col("status") == "success", F.lit(False)),
                F.concat(F.lit("input status is not success: "), F.coalesce("status", F.lit(""))),
            ),
        ),
    )


def article_intake(requests: DataFrame, value: str = "value") -> DataFrame:
    """Requests ``{"article": {...}}`` as articles plus ``reject_reason``.

    Unknown fields are ignored; a request without an article is a reject row.
    """
    parsed = parse_once(requests, value, "_v")
    rejected = F.when(F.col("_v").isNull(), "invalid JSON").when(
        _entries(F.col("_v"), "$.article").isNull(), "article is required"
    )
    fields = []
    for name, kind in (part.strip().split(" ", 1) for part in schemas.ARTICLE.split(",") if part.strip()):
        got = F.try_variant_get("_v", f"$.article.{name}", "string" if kind == "timestamp" else kind)
        if kind == "timestamp":
            got = parse_rfc3339(got)
        fields.append(got.alias(name))
    return parsed.select(*requests.columns, *fields, rejected.alias("reject_reason"))


def message_source(
    spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC, starting: str = "latest"
) -> DataFrame:
    """Stream of one topic.  Needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return raw.select(
        "topic", "partition", "offset", F.col("key").cast("string"), F.col("value").cast("string")
    )


def file_message_source(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same envelope from Parquet files that land in a folder."""
    return (
        spark.readStream.schema(schemas.MESSAGE_ENVELOPE)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )
