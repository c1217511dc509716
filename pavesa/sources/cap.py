"""Weather-warning archives and messages."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import scalar as S

PAIR = "array<struct<valueName:string,value:string>>"
AREA = f"array<struct<areaDesc:string,polygon:string,geocode:{PAIR}>>"
INFO = f"array<struct<language:string,event:string,onset:string,expires:string,description:string,eventCode:{PAIR},parameter:{PAIR},area:{AREA}>>"
#: Only elements that are read: the parser skips the others without building them.
ALERT = f"identifier string, sent string, info {INFO}"
LIVE_ALERT = "identifier string, info array<struct<event:string,onset:string,expires:string,area:array<struct<areaDesc:string,polygon:string>>>>"


#: Messages, and their bytes, handed on at a time; memory holds these and one member, or one plain archive.
MESSAGES, MESSAGE_BYTES = 2000, 4 << 20
#: Members up to this size are read in one piece, larger ones as a stream.
SMALL_MEMBER = 1 << 20
#: First bytes of bzip2, xz and lzma.
PACKED = (b"BZh", b"\xfd7zXZ", b"]\x00\x00")
#: A plain archive unpacks to this many bytes at most, and nests so deep.
PLAIN_BYTES, PLAIN_DEPTH = 16 << 20, 8
#: What the usual writers put behind the name into the header of a file or folder: octal numbers, no link, no prefix.
PLAIN_HEADER = re.compile(
    rb"(?:[0-7]{7}\0){3}([0-7]{11})\0[0-7]{11}\0([0-7]{6})\0 ([05])\0{100}ustar(?:\x0000|  \0).{64}(?:[0-7]{7}\0|\0{8}){2}\0{155}", re.DOTALL
)
#: Eight bytes that can't be the checksum of a tar header.
NO_CHECKSUM = re.compile(rb"(?![\x80\xff])[^\0]*?[^\0\s\x1c-\x1f0-7oO_+\-]")
CHECKSUM = slice(148, 156)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return unpack(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def members(name: str, stream: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """Every XML document inside a stream, however deeply gzip and tar are nested; archives are read through, never unpacked whole."""
    waiting = [iter([(name, stream)])]
    while waiting:
        name, stream = next(waiting[-1], (None, None))
        if name is None:
            waiting.pop()
            continue
        stream = stream if stream.seekable() else io.BytesIO(stream.read())
        start = stream.read(tarfile.BLOCKSIZE)
        stream.seek(0)
        if start[:2] == b"\x1f\x8b":
            waiting.append(iter([(name, gzip.GzipFile(fileobj=stream))]))
        elif _is_tar(stream, start):
            waiting.append(_entries(name, stream))
        elif (body := stream.read()).lstrip().startswith(b"<?xml"):
            yield name, body


def _is_tar(stream: BinaryIO, start: bytes) -> bool:
    """``tarfile.is_tarfile`` tries every compression on what isn't a tar; a first block without a valid checksum saves that."""
    if not start.startswith(PACKED):
        try:
            tarfile.TarInfo.frombuf(start, tarfile.ENCODING, "surrogateescape")
        except tarfile.EOFHeaderError:
            pass  # a tar without members starts with a block of zeros
        except tarfile.HeaderError:
            return False
    found = tarfile.is_tarfile(stream)
    stream.seek(0)
    return found


def _entries(name: str, stream: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    with tarfile.open(fileobj=stream, mode="r:") as archive:
        for entry in archive:
            if entry.isfile():
                small = entry.size <= SMALL_MEMBER and not entry.issparse()
                yield f"{name}/{entry.name}", _at_once(stream, entry) if small else archive.extractfile(entry)


def _at_once(stream: BinaryIO, entry: tarfile.TarInfo) -> BinaryIO:
    stream.seek(entry.offset_data)
    content = stream.read(entry.size)
    if len(content) < entry.size:
        raise tarfile.ReadError("unexpected end of data")
    return io.BytesIO(content)


class _NotPlain(Exception):
    """Something that ``members`` has to judge."""


def plain_members(name: str, content: bytes) -> list[tuple[str, bytes]] | None:
    """What ``members`` gives for a small whole archive of usual headers, without a file object for each member; None for any other."""
    found: list[tuple[str, bytes]] = []
    room = PLAIN_BYTES - len(content)

    def take(name: str, body: bytes, depth: int) -> None:
        nonlocal room
        if body[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            inner = unzip.decompress(body, max(room, 1))
            room -= len(inner)
            if not unzip.eof or unzip.unused_data or room < 0 or depth >= PLAIN_DEPTH:
                raise _NotPlain
            take(name, inner, depth + 1)
        elif body.startswith(PACKED):
            raise _NotPlain
        elif _no_header(body):
            if body.lstrip().startswith(b"<?xml"):
                found.append((name, body))
        elif depth >= PLAIN_DEPTH:
            raise _NotPlain
        else:
            for inner_name, start, end in _plain_entries(body):
                take(f"{name}/{inner_name}", body[start:end], depth + 1)

    try:
        if room < 0:
            return None
        take(name, content, 0)
    except (_NotPlain, zlib.error, UnicodeDecodeError):
        return None
    return found


def _no_header(body: bytes) -> bool:
    """The first block surely isn't the header of a tar."""
    if len(body) < tarfile.BLOCKSIZE or NO_CHECKSUM.match(body[CHECKSUM]):
        return True
    try:
        tarfile.TarInfo.frombuf(body[: tarfile.BLOCKSIZE], tarfile.ENCODING, "surrogateescape")
    except tarfile.EOFHeaderError:
        return False
    except tarfile.HeaderError:
        return True
    return False


def _plain_entries(body: bytes) -> Iterator[tuple[str, int, int]]:
    """Name and place of each file of a tar that is whole and has plain headers only."""
    at, block = 0, tarfile.BLOCKSIZE
    while True:
        header = body[at : at + block]
        if at and header == bytes(block):
            return
        plain = PLAIN_HEADER.match(header, 100)
        if not plain or sum(header) - sum(header[CHECKSUM]) + 256 != int(plain[2], 8):
            raise _NotPlain
        size, start = int(plain[1], 8), at + block
        if start + size > len(body) or (plain[3] == b"5" and size):
            raise _NotPlain
        if plain[3] == b"0":
            yield header[:100].split(b"\0", 1)[0].decode(tarfile.ENCODING), start, start + size
        at = start + -(-size // block) * block


def _message_rows(found: list[tuple[str, str | None, bytes | None, str | None]]) -> pa.RecordBatch:
    paths, names, bodies, errors = zip(*found)
    try:
        payloads = pa.array(bodies, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # some text isn't UTF-8
        payloads = pa.array([None if b is None else b.decode("utf-8", "replace") for b in bodies], pa.string())
    texts = [pa.array(v, pa.string()) for v in (paths, names, errors)]
    return pa.RecordBatch.from_arrays([texts[0], texts[1], payloads, texts[2]], ["path", "member_path", "payload", "error"])


def unpack(archives: DataFrame) -> DataFrame:
    """``(path, content)`` rows to one row per XML member. A broken archive gives what could be read and a row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of many small archives go on together: a batch for each archive costs more than reading it.
        found, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name, content = path.rsplit("/", 1)[-1], content.as_py() or b""
                read = plain_members(name, content)
                try:
                    for member, body in members(name, io.BytesIO(content)) if read is None else read:
                        found.append((path, member, body, None))
                        held += len(body)
                        if len(found) >= MESSAGES or held >= MESSAGE_BYTES:
                            yield _message_rows(found)
                            found, held = [], 0
                except (OSError, EOFError, zlib.error, tarfile.TarError) as broken:
                    found.append((path, None, None, f"{type(broken).__name__}: {broken}"))
        if found:
            yield _message_rows(found)

    return archives.select("path", "content").mapInArrow(run, "path string, member_path string, payload string, error string")


def parsed(messages: DataFrame, schema: str) -> DataFrame:
    """Messages with ``a``, the parsed alert, in place of ``payload``. Each text is parsed once, whatever later filters and columns ask of it."""
    return geo.computed_once(messages, a=F.from_xml("payload", schema, {"rowTag": "alert"})).drop("payload")


def parse(messages: DataFrame) -> DataFrame:
    """One row per heat-warning area: Spanish text, phenomenon AT, both validity times, a named area."""
    kept = [c for c in messages.columns if c != "payload"]
    info = parsed(messages, ALERT).filter("a.identifier IS NOT NULL").withColumn("i", F.explode("a.info"))
    info = info.filter(
        F.lower(F.trim("i.language")).startswith("es") & S.blank_to_null(F.col("i.onset")).isNotNull() & S.blank_to_null(F.col("i.expires")).isNotNull()
    )
    info = geo.computed_once(info, event_code=S.coded_value(F.col("i.eventCode"), K.CAP_EVENT_NAME), parameter=S.coded_value(F.col("i.parameter"), K.CAP_PARAMETER_NAME))
    code, phenomenon, _ = S.coded_parts(F.col("event_code"))
    info = info.filter(code == "AT")
    p_code, p_label, p_value = S.coded_parts(F.col("parameter"))
    label = F.coalesce(phenomenon, F.lit("Temperaturas máximas"))
    info = geo.computed_once(
        info, phenomenon_code=code, phenomenon_label=label, event_text=F.coalesce(S.blank_to_null(F.col("i.event")), label),
        level=S.coded_value(F.col("i.parameter"), K.CAP_LEVEL_NAME), parameter_code=p_code, parameter_label=p_label, parameter_value=p_value,
    )
    level, event, value = F.col("level"), F.col("event_text"), F.col("parameter_value")
    area = info.withColumn("r", F.explode_outer("i.area")).filter(S.blank_to_null(F.col("r.areaDesc")).isNotNull())
    return area.select(
        *kept,
        F.trim("a.identifier").alias("cap_identifier"), S.catalog_time(F.trim("a.sent")).alias("sent_at"), F.trim("i.language").alias("language"),
        "phenomenon_code", "phenomenon_label", S.level_code(level, event).alias("level_code"), S.level_label(level, event).alias("level_label"),
        "parameter_code", "parameter_label", "parameter_value",
        S.coded_value(F.col("i.parameter"), K.CAP_PROBABILITY_NAME).alias("probability"),
        S.temperature_c(F.coalesce(F.nullif(value, F.lit("")), F.col("parameter")), F.col("i.description")).alias("temperature_max_c"),
        S.catalog_time(F.trim("i.onset")).alias("onset_at"), S.catalog_time(F.trim("i.expires")).alias("expires_at"),
        F.trim("r.areaDesc").alias("area_name"), S.coded_value(F.col("r.geocode"), K.CAP_ZONE_NAME).alias("area_code"),
        S.polygon_ring(F.col("r.polygon")).alias("ring"),
    )


def parse_live(messages: DataFrame) -> DataFrame:
    """First info and first area only, naive 19-character times, level from the event text."""
    first = lambda array: F.get(array, F.lit(0))
    naive = lambda c: F.try_to_timestamp(F.left(F.trim(c), F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    i = first(F.col("a.info"))
    rows = parsed(messages.select("payload"), LIVE_ALERT).filter("a.identifier IS NOT NULL")
    rows = geo.computed_once(
        rows, id=F.trim("a.identifier"), title=F.coalesce(S.blank_to_null(i.event), F.lit("Desconocido")), r=first(i.area), onset=naive(i.onset), expires=naive(i.expires)
    ).filter("id <> '' AND onset IS NOT NULL AND expires IS NOT NULL")
    rows = geo.computed_once(rows, event=S.live_event_title(F.col("title")), level=S.live_level(F.col("title")))
    return rows.select(
        "id", "event", "level", S.level_color(F.col("level")).alias("level_color"),
        F.when(F.col("r").isNull(), "España").otherwise(F.trim("r.areaDesc")).alias("area_name"), "onset", "expires", F.col("r.polygon").alias("polygon"),
    )


ROAD_MEMBER = "localId string, gmlId string, posList string"


def parse_road_members(payloads: DataFrame) -> DataFrame:
    """Road-service members: id ``VIAL_TR<int>`` and an even list of at least four numbers."""
    x = lambda path: F.xpath_string("payload", F.lit(path))
    rows = payloads.select(
        F.trim(x("//*[local-name()='localId']")).alias("inspire_id"), x("//*[local-name()='RoadLink']/@*[local-name()='id']").alias("gml_id"),
        F.filter(F.split(F.trim(x("//*[local-name()='posList']")), r"\s+"), lambda v: v != "").alias("numbers"),
    )
    values = F.transform("numbers", lambda v: v.try_cast("double"))
    rows = rows.withColumn("id_tramo", S.road_id_from_public(F.col("inspire_id"))).withColumn("v", values)
    good = F.col("id_tramo").isNotNull() & (F.size("v") >= 4) & (F.size("v") % 2 == 0) & ~F.exists("v", lambda n: n.isNull())
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1),
        lambda i: F.struct(F.get(F.col("v"), i * 2).alias("x"), F.get(F.col("v"), i * 2 + 1).alias("y")),
    )
    return rows.filter(good).select("id_tramo", "inspire_id", "gml_id", pairs.alias("line"))


def xml_text(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
