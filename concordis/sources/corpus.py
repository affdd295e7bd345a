"""Corpus files: scan, item ids, seed families, image headers and sealed page records."""

from __future__ import annotations

from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.functions.identity import seal

# Accepted suffixes, seed families and policy names.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
SEED_FAMILIES = (
    "D-GEO", "D-PHOT", "D-OPT", "D-MAT", "D-INK", "D-INTER", "D-NOISE", "D-COMP", "D-OCC", "D-SURR", "D-LAYER",
    "D-NEWS-MULTICOL", "D-NEWS-CONT", "D-NEWS-AD", "D-NEWS-MASTHEAD", "D-NEWS-CLIP", "D-NEWS-HALFTONE", "D-NEWS-MICRO",
)
MEDIA_TYPES = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff",
}
SCHEMA_VERSION = "v2"  # default; pass the version of records already stored to keep their ids
READING_ORDER_POLICY_ID = "reading_order_v1"
PREPROCESS_POLICY_ID = "preprocess_v1"


def item_id(path: Column, root: str) -> Column:
    """Path below the corpus root, without the file system's scheme and host."""
    base = urlparse(root).path.rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(F.startswith(bare, F.lit(base)), F.substring(bare, len(base) + 1, 2147483647)).otherwise(bare)


def scan_corpus(spark: SparkSession, root: str, suffixes=IMAGE_SUFFIXES, only: DataFrame | None = None) -> DataFrame:
    """Files under ``root`` with an accepted suffix.

    ``content`` is read only where a later step uses it.  ``only`` restricts the scan to
    the listed ``dataset_item_id`` values.
    """
    return accepted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, suffixes, only)


def accepted(files: DataFrame, root: str, suffixes=IMAGE_SUFFIXES, only: DataFrame | None = None) -> DataFrame:
    """Of listed files (``path``) those with an accepted suffix, with their item ids."""
    files = files.withColumn("dataset_item_id", item_id(F.col("path"), root))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    found = files.where(suffix.isin(*suffixes))
    return found if only is None else found.join(only.select("dataset_item_id"), "dataset_item_id", "left_semi")


def missing_items(only: DataFrame, found: DataFrame) -> DataFrame:
    """Requested items that the scan did not find."""
    return only.select("dataset_item_id").distinct().join(found, "dataset_item_id", "left_anti")


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def seed_family(item: Column, families=SEED_FAMILIES) -> Column:
    """The top folder, if it is a known family; deeper folders do not count."""
    parts = F.split(item, "/")
    return F.when((F.size(parts) > 1) & parts[0].isin(*families), parts[0])


def is_safe_item_id(item: Column) -> Column:
    return ~item.rlike(r"[^A-Za-z0-9._/-]")


def split_unsafe(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    safe = F.coalesce(is_safe_item_id(F.col("dataset_item_id")), F.lit(False))
    return items.where(safe), items.where(~safe)


def check_output_root(dataset_root: str, output_root: str) -> None:
    """Refuse an output root equal to the corpus root or inside it."""
    source, target = urlparse(dataset_root), urlparse(output_root)
    inside = (target.path.rstrip("/") + "/").startswith(source.path.rstrip("/") + "/")
    same_store = (source.scheme or "file", source.netloc) == (target.scheme or "file", target.netloc)
    if same_store and inside:
        raise ValueError(f"output root {output_root!r} overlaps the corpus root {dataset_root!r}")


def _png_number(content: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("int")


def png_header(content: Column) -> Column:
    """Width, height, bit depth and colour mode from a PNG header; NULL for other files."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    colour = _png_number(content, 26, 1)
    depth = _png_number(content, 25, 1)
    mode = (
        F.when((colour == 0) & (depth == 1), "1").when(colour == 0, F.when(depth == 16, "I;16").otherwise("L"))
        .when(colour == 2, "RGB").when(colour == 3, "P").when(colour == 4, "LA").when(colour == 6, "RGBA")
    )
    return F.when(
        is_png,
        F.struct(
            _png_number(content, 17, 4).alias("width_px"), _png_number(content, 21, 4).alias("height_px"),
            depth.alias("bit_depth"), mode.alias("color_mode"),
        ),
    )


_SIZE = "struct<width_px:int,height_px:int,color_mode:string>"
_JPEG, _TIFF = ("FFD8FF",), ("49492A00", "4D4D002A")


def jpeg_size(data: bytes) -> dict | None:
    """Size and mode of the first frame header (SOF) among a JPEG's segments; None if it is cut off or broken."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a segment
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(data):
                return None
            height, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (5, 7))
            return {"width_px": width, "height_px": height, "color_mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(data[at + 9])}
        else:
            at += 2 + max(2, int.from_bytes(data[at + 2 : at + 4], "big"))
    return None


def tiff_size(data: bytes) -> dict | None:
    """Size and mode from a byte-order mark (four bytes) and the entries of the first directory; None without a size."""
    order = "little" if data[:2] == b"II" else "big"
    number = lambda a, b: int.from_bytes(data[a:b], order)
    tags = {}
    for at in range(4, len(data) - 11, 12):
        width = {1: 1, 3: 2, 4: 4}.get(number(at + 2, at + 4), 0)
        inline = width * number(at + 4, at + 8) <= 4
        tags[number(at, at + 2)] = number(at + 8, at + 8 + width) if inline else None
    if not tags.get(256) or not tags.get(257) or max(tags[256], tags[257]) >= 1 << 31:
        return None
    bits, samples, light = tags.get(258, 1), tags.get(277, 1), tags.get(262)
    if light in (0, 1):
        mode = {1: "1", 8: "L", 16: "I;16"}.get(bits) if samples == 1 else "LA" if samples == 2 else None
    else:
        mode = {(2, 3): "RGB", (2, 4): "RGBA", (3, 1): "P", (5, 4): "CMYK", (6, 3): "YCbCr"}.get((light, samples))
    return {"width_px": tags[256], "height_px": tags[257], "color_mode": mode}


def _order_number(content: Column, little: Column, start: Column | int, size: int) -> Column:
    """An unsigned number in the file's byte order; ``start`` counts from one."""
    digits = [F.hex(F.substring(content, F.lit(start) + k, F.lit(1))) for k in range(size)]
    return F.conv(F.when(little, F.concat(*digits[::-1])).otherwise(F.concat(*digits)), 16, 10).cast("long")


def image_size(content: Column) -> Column:
    """Width, height and mode from the header of a PNG, JPEG or TIFF file, by content; NULL for others.  Nothing is decoded.

    A PNG's header has fixed places and stays in the JVM.  Of a TIFF only its first directory goes to
    Python, wherever it lies; a JPEG goes whole, since its frame header may follow any number of segments.
    """
    magic = F.hex(F.substring(content, 1, 4))
    is_jpeg, is_tiff = F.substring(magic, 1, 6).isin(*_JPEG), magic.isin(*_TIFF)
    little = magic == _TIFF[0]
    directory = _order_number(content, little, 5, 4)
    inside = directory < F.octet_length(content)
    first = F.when(inside, directory).cast("int")
    entries = F.substring(content, first + 3, (12 * _order_number(content, little, first + 1, 2)).cast("int"))
    sent = F.when(is_jpeg, content).when(is_tiff, F.concat(F.substring(content, 1, 4), entries))

    @F.arrow_udf(_SIZE)
    def parsed(files: pa.Array) -> pa.Array:
        kind = pa.struct([("width_px", pa.int32()), ("height_px", pa.int32()), ("color_mode", pa.string())])
        found = []
        for file in files:
            data = file.as_py()
            found.append(None if data is None else jpeg_size(data) if data[:1] == b"\xff" else tiff_size(data))
        return pa.array(found, kind)

    png = png_header(content)
    return F.coalesce(F.when(png.isNotNull(), F.struct(png["width_px"].alias("width_px"), png["height_px"].alias("height_px"), png["color_mode"].alias("color_mode"))), parsed(sent))


def source_pages(files: DataFrame, settings: dict[str, str | None]) -> DataFrame:
    """Sealed source pages from scanned files; other columns of ``files`` are kept."""
    suffix = F.lower(F.regexp_extract("dataset_item_id", r"(\.[^./]*)$", 1))
    media = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    header = image_size(F.col("content"))
    text = lambda name: F.lit(settings.get(name)).cast("string")
    described = files.withColumn("_h", header).withColumns(
        {
            "schema_version": F.lit(settings.get("schema_version", SCHEMA_VERSION)),
            "dataset_id": text("dataset_id"),
            "dataset_version": text("dataset_version"),
            "source_uri": F.col("path"),
            "source_sha256": file_digest(F.col("content")),
            "media_type": F.coalesce(F.try_element_at(media, suffix), F.lit("application/octet-stream")),
            "byte_size": F.col("length").cast("bigint"),
            "width_px": F.col("_h.width_px"),
            "height_px": F.col("_h.height_px"),
            "color_mode": F.col("_h.color_mode"),
            "bit_depth": F.lit(None).cast("int"),
            "orientation_metadata": F.lit(None).cast("string"),
            "source_genre": text("source_genre"),
            "license_id": text("license_id"),
        }
    )
    return seal(described.drop("_h", "content"), "source_page")


def evaluation_units(pages: DataFrame, settings: dict[str, str | None]) -> DataFrame:
    """One whole-page unit per source page."""
    return seal(
        pages.select("source_page_id").withColumns(
            {
                "schema_version": F.lit(settings.get("schema_version", SCHEMA_VERSION)),
                "selector": F.lit(None).cast("map<string,string>"),
                "layout_complexity": F.lit(settings.get("layout_complexity", "linear")),
                "reading_order_policy_id": F.lit(READING_ORDER_POLICY_ID),
                "language": F.lit(settings.get("language")).cast("string"),
                "mixed_language": F.lit(False),
                "evaluation_scope_status": F.lit(settings.get("evaluation_scope_status", "in_scope_scored")),
            }
        ),
        "evaluation_unit",
    )


# Bits per sample by colour mode; a fixed lookup.
_MODE_BITS = {"1": 1, "L": 8, "LA": 8, "P": 8, "RGB": 8, "RGBA": 8}


def decode_provenances(pages: DataFrame, decoder_id: str, decoder_version: str) -> DataFrame:
    bits = F.create_map(*[F.lit(x) for pair in _MODE_BITS.items() for x in pair])
    return seal(
        pages.select(
            "source_page_id", F.lit(decoder_id).alias("decoder_id"), F.lit(decoder_version).alias("decoder_version"),
            F.col("media_type").alias("original_media_type"),
            F.try_element_at(bits, F.col("color_mode")).alias("original_bit_depth"),
            F.col("color_mode").alias("original_color_mode"),
            F.lit(None).cast("string").alias("original_orientation_metadata"),
            F.lit("png").alias("output_encoding"),
        ),
        "decode_provenance",
    )


def input_variants(pages: DataFrame, units: DataFrame, provenances: DataFrame) -> DataFrame:
    """The natural baseline variant of each unit.  The source bytes are the artifact: no
    image is decoded and encoded again here."""
    transforms = "array<struct<step_id:string,algorithm_id:string,algorithm_version:string,parameters:map<string,string>>>"
    joined = (
        units.select("evaluation_unit_id", "source_page_id", "schema_version")
        .join(
            pages.select(
                "source_page_id", F.col("source_uri").alias("artifact_uri"), F.col("source_sha256").alias("artifact_sha256"),
                "media_type", "byte_size", "width_px", "height_px",
            ),
            "source_page_id",
        )
        .join(provenances.select("source_page_id", "decode_provenance_id"), "source_page_id")
    )
    return seal(
        joined.withColumns(
            {
                "variant_kind": F.lit("natural_baseline"),
                "mitigation_kind": F.lit(None).cast("string"),
                "transform_chain": F.array().cast(transforms),
                "preprocess_policy_id": F.lit(PREPROCESS_POLICY_ID),
                "perturbation_provenance": F.lit(None).cast("string"),
            }
        ),
        "page_input_variant",
    )
