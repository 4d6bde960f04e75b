"""Readers that bring stored data into the item layout."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewatch.functions.text import html_text
from tidewatch.schema import CANDIDATE, TRACKED_EVENT, conform

STORY_CSV = "id string, type string, author string, timestamp string, body string, title string, parent string"
COMMENT_JSON = "id string, created_utc long, subreddit string, body string, score int, author string, parent_id string, link_id string, permalink string"


def stories_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items of a story dump, in time order; multi-line bodies are read whole."""
    raw = spark.read.csv(path, schema=STORY_CSV, header=True, multiLine=True, escape='"')
    rows = raw.select(
        F.expr("try_cast(id AS long)").alias("item_id"), F.col("type").alias("item_type"), "author", F.expr("try_cast(timestamp AS long)").alias("sec"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("title", F.lit("")).alias("title"), F.expr("try_cast(nullif(parent, '') AS long)").alias("parent"),
        F.lit("").alias("url"), F.lit(False).alias("deleted"), F.lit(False).alias("dead"),
    )
    return rows.orderBy("sec", "item_id")


class ZstLines(DataSource):
    """JSON lines in zstandard files: spark.read.format("zst_lines").load(path), a file, a folder or an URI of a store that Arrow reads.

    One partition per file, streamed in chunks. Broken lines are skipped; a last line
    without its end is dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return COMMENT_JSON

    def reader(self, schema) -> DataSourceReader:
        return ZstLinesReader(self.options.get("path", ""), [f.name for f in schema.fields], int(self.options.get("chunk", 1 << 16)))


class ZstLinesReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str], chunk: int) -> None:
        self.path, self.fields, self.chunk = path, fields, chunk

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(self.path)]
        files = store.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith(".zst"))
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return [InputPartition(n if not head else f"{head}{n}") for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(path, compression=None) as f, zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(f) as stream:
            rest = b""
            while part := stream.read(self.chunk):
                *lines, rest = (rest + part).split(b"\n")
                for line in lines:
                    if (row := parse_line(line, self.fields)) is not None:
                        yield row


def parse_line(line: bytes, fields: list[str]) -> tuple | None:
    try:
        got = json.loads(line)
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    number = {"created_utc": int, "score": int}
    try:
        return tuple(None if got.get(n) is None else number.get(n, str)(got[n]) for n in fields)
    except (TypeError, ValueError):
        return None


def comments_zst(spark: SparkSession, path: str, distributed_store: bool = False) -> DataFrame:
    """Items of a comment dump. With distributed_store the files are read through Spark, for stores that only it reaches; a file is then held whole by its task."""
    if distributed_store:
        names = [x.split()[0] for x in COMMENT_JSON.split(", ")]

        def unpack(batches):
            import io

            import pandas as pd
            import zstandard

            for batch in batches:
                for content in batch["content"]:
                    stream, rest = zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(io.BytesIO(content)), b""
                    while part := stream.read(1 << 22):
                        *lines, rest = (rest + part).split(b"\n")
                        yield pd.DataFrame([r for x in lines if (r := parse_line(x, names)) is not None], columns=names)

        raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, COMMENT_JSON)
    else:
        spark.dataSource.register(ZstLines)
        raw = spark.read.format("zst_lines").load(path)
    return raw.select("id", F.col("subreddit").alias("channel"), "body", F.col("created_utc").alias("sec"), "author", "score", "parent_id", "link_id", "permalink")


STORY_JSON = "id long, type string, by string, time long, text string, title string, url string, parent long, score long, deleted boolean, dead boolean"


def retried(call: Callable, first: float = 5.0, most: float = 60.0, tries: int = 8, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a failure again, with pauses that double from `first` up to `most` seconds."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            sleep(min(most, first * 2**n))


def numbered_items(newest: Callable[[], int], fetch: Callable[[int], dict | None], name: str = "numbered_items", ids_a_task: int = 50, schema: str = STORY_JSON) -> type[DataSource]:
    """A streaming source of items that a service numbers: register it, then spark.readStream.format(name).load().

    The offset is the newest id; what is older than the first one is skipped.
    newest and fetch ask the service (a JSON object, or None for what is gone);
    ids between two offsets are fetched in tasks of ids_a_task. An item that
    cannot be had is left out.
    """
    fields = [x.split() for x in schema.split(", ")]

    def row(got: dict) -> tuple:
        make = {"long": int, "boolean": bool, "string": str}
        return tuple(None if got.get(n) is None else make[k](got[n]) for n, k in fields)

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"id": retried(newest)}

        def latestOffset(self, *_) -> dict:
            return {"id": retried(newest)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [InputPartition((at, min(end["id"] + 1, at + ids_a_task))) for at in range(start["id"] + 1, end["id"] + 1, ids_a_task)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for i in range(*partition.value):
                try:
                    got = fetch(i)
                    if isinstance(got, dict):
                        yield row(got)
                except Exception:
                    continue

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader()

    return Source


def story_items(raw: DataFrame) -> DataFrame:
    """Items of a story service's objects (STORY_JSON): text without markup, of stories the title where they have none; items without text go."""
    body = html_text(F.coalesce(F.nullif("text", F.lit("")), F.nullif("title", F.lit("")), F.lit("")))
    rows = raw.select(
        F.col("id").alias("item_id"), F.col("type").alias("item_type"), F.coalesce("by", F.lit("")).alias("author"), F.coalesce("time", F.lit(0)).alias("sec"), body.alias("body"), F.coalesce("title", F.lit("")).alias("title"), F.col("parent"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("dead", F.lit(False)).alias("dead"),
    )
    return rows.where("body <> ''")


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Post items of a folder that firehose messages (JSON lines) arrive in, as a stream."""
    return posts_from_messages(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


JETSTREAM = (
    "kind string, did string, time_us long, commit struct<collection:string,operation:string,rkey:string,cid:string,record:struct<text:string,langs:array<string>,reply:struct<root:struct<uri:string>,parent:struct<uri:string>>,"
    "facets:array<struct<features:array<struct<`$type`:string,tag:string,uri:string>>>>,embed:struct<`$type`:string,images:array<struct<alt:string>>,external:struct<uri:string,title:string,description:string>,record:string,media:struct<`$type`:string,images:array<struct<alt:string>>,external:struct<uri:string,title:string,description:string>>>>>"
)


def posts_from_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Post items of firehose messages (JSON text): new posts only, with hashtags, links, embeds and reply roots."""
    m = messages.select(F.from_json(column, JETSTREAM).alias("m")).select("m.*")
    m = m.where("kind = 'commit' AND commit.operation = 'create' AND commit.collection = 'app.bsky.feed.post'")
    record, embed = "commit.record.", "commit.record.embed."
    features = F.flatten(F.transform(F.coalesce(record + "facets", F.array().cast("array<struct<features:array<struct<`$type`:string,tag:string,uri:string>>>>")), lambda f: f["features"]))
    of = lambda kind, field: F.transform(F.filter(features, lambda x: x["$type"].endswith(kind) & x[field].isNotNull()), lambda x: x[field])
    external = F.coalesce(embed + "external", embed + "media.external")
    images = F.coalesce(embed + "images", embed + "media.images")
    kind = F.coalesce(F.col(embed + "`$type`"), F.lit(""))
    media = F.coalesce(F.col(embed + "media.`$type`"), F.lit(""))
    uri = F.concat(F.lit("at://"), "did", F.lit("/"), "commit.collection", F.lit("/"), "commit.rkey")
    body = F.coalesce(record + "text", F.lit(""))
    return m.select(
        F.crc32(F.encode(uri, "UTF-8")).alias("item_id"), uri.alias("platform_uri"), F.coalesce(record + "reply.root.uri", uri).alias("root_uri"), F.col(record + "reply.parent.uri").alias("parent_uri"), F.col(record + "reply").isNotNull().alias("is_reply"), F.floor(F.col("time_us") / 1000000).cast("long").alias("sec"),
        F.col("did").alias("author"), body.alias("body"), F.substring(body, 1, 100).alias("story_title"), F.coalesce(record + "langs", F.array().cast("array<string>")).alias("langs"), of("#tag", "tag").alias("hashtags"), of("#link", "uri").alias("links"), kind.alias("embed_type"),
        (F.size(F.coalesce(images, F.array().cast("array<struct<alt:string>>"))) > 0).alias("has_image"), F.coalesce(F.size(images), F.lit(0)).alias("image_count"), (kind.contains("video") | media.contains("video")).alias("has_video"), external.isNotNull().alias("has_external_link"), external["uri"].alias("external_uri"),
        kind.contains("record").alias("has_quote_post"), F.transform(F.coalesce(images, F.array().cast("array<struct<alt:string>>")), lambda i: i["alt"]).alias("alt_texts"), F.concat_ws(" ", F.nullif(F.trim(external["title"]), F.lit("")), F.nullif(F.trim(external["description"]), F.lit(""))).alias("embed_text"),
    )


def candidates_between(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """Stored candidates of a range of days: only those folders are read. An archive without files has none."""
    days = [(first + timedelta(n)).isoformat() for n in range((last - first).days + 1)]
    try:
        raw = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], CANDIDATE)
    return conform(raw.where(F.col("date").cast("string").isin(*days)), CANDIDATE)


def unseen(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Rows of files that the manifest does not name."""
    return files.join(done.select(key), key, "left_anti")


def stored_events(spark: SparkSession, path: str, since: int) -> DataFrame:
    """Tracked events from JSON lines, last seen at or after a second, in order of first_seen."""
    return spark.read.schema(TRACKED_EVENT).json(path).where(F.col("last_seen") >= since).orderBy("first_seen", "event_id")


def latest_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest JSON document of a folder."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_path"))
    newest = rows.select("_at", "_path").orderBy(F.desc("_at"), F.desc("_path")).limit(1)
    return rows.join(F.broadcast(newest), ["_at", "_path"]).drop("_at", "_path")
