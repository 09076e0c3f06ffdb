"""Chapter files, archives and books as tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as X
from .named_files import write_named


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, content of the *.md files of a folder, not of folders below. Text that is not UTF-8 is an error, line ends become \\n, a BOM stays.

    Pass the folder itself: names that begin with _ or . inside it are hidden from the reader.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), name)))
    return files.select(name.alias("file_name"), X.newlines(text).alias("content")).orderBy("file_name")


def read_archives(spark: SparkSession, path: str, glob: str = "*.epub") -> DataFrame:
    """archive, ord, name, size, data of every entry of ZIP files, in archive order. Each archive is read by one task; entries leave one at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, raw in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for k, info in enumerate(z.infolist()):
                        yield pd.DataFrame({"archive": [where], "ord": [k], "name": [info.filename], "size": [info.file_size], "data": [z.read(info)]})

    return files.mapInPandas(entries, "archive string, ord int, name string, size long, data binary")


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """archive, title, author, publisher, ord, name, content: a row per spine item of each book, in reading order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dc, opf = "{http://purl.org/dc/elements/1.1/}", "{http://www.idpf.org/2007/opf}"
        for batch in batches:
            for where, raw in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
                    package = next(x.attrib["full-path"] for x in box.iter() if x.tag.endswith("rootfile"))
                    tree = ElementTree.fromstring(z.read(package))
                    meta = {k: (tree.findtext(f".//{dc}{k}") or None) for k in ("title", "creator", "publisher")}
                    hrefs = {x.attrib["id"]: x.attrib["href"] for x in tree.iter(f"{opf}item")}
                    for k, ref in enumerate(tree.iter(f"{opf}itemref")):
                        name = posixpath.join(posixpath.dirname(package), hrefs[ref.attrib["idref"]])
                        yield pd.DataFrame({"archive": [where], "title": [meta["title"]], "author": [meta["creator"]], "publisher": [meta["publisher"]], "ord": [k], "name": [name], "content": [z.read(name).decode()]})

    return files.mapInPandas(items, "archive string, title string, author string, publisher string, ord int, name string, content string")


def write_epub(chapters: DataFrame, path: str, title: str, author: str, cover: bytes | None = None) -> None:
    """A book from chapters (file_name, content as XHTML body), streamed through the driver in the order of names: a book is one file."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for row in chapters.select("file_name", "content").orderBy("file_name").toLocalIterator():
            names.append(row["file_name"])
            z.writestr(f"OEBPS/c{len(names)}.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(row["file_name"])}</title></head><body>{row["content"]}</body></html>')
        if cover:
            z.writestr("OEBPS/cover.png", cover)
        manifest = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(1, len(names) + 1)) + ('<item id="cover" href="cover.png" media-type="image/png" properties="cover-image"/>' if cover else "")
        manifest += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        spine = "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(names) + 1))
        nav = "".join(f'<li><a href="c{k}.xhtml">{esc(n)}</a></li>' for k, n in enumerate(names, 1))
        z.writestr("OEBPS/nav.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(title)}</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{esc(title)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(author)}</dc:creator><dc:language>zh</dc:language></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>')


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """ord, kind, file_name, content of the books and chapters of a folder of mixed formats: Markdown files, and the spine of each EPUB, by name."""
    chapters = read_chapters(spark, folder).select(F.lit("markdown").alias("kind"), "file_name", F.lit(0).alias("ord"), "content")
    books = read_epub(spark, folder).select(F.lit("epub").alias("kind"), F.element_at(F.split("archive", "/"), -1).alias("file_name"), "ord", "content")
    return chapters.unionByName(books).orderBy("file_name", "ord")


def read_epub_images(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size, data, width, height of the images of each book."""
    entries = read_archives(spark, path).where(F.lower("name").rlike("[.](jpg|jpeg|png|gif|webp)$"))
    return entries.select("archive", "name", "size", "data", image_size("data").alias("s")).select("archive", "name", "size", "data", "s.width", "s.height")


def read_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, size of the image files of a folder and all below it, by extension in lower case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("path").rlike("[.](jpg|png|gif|webp)$")).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def epub_metadata(spark: SparkSession, path: str) -> DataFrame:
    """archive, title, author, publisher, chapters of each book."""
    return read_epub(spark, path).groupBy("archive", "title", "author", "publisher").agg(F.count("*").alias("chapters"))


def cover_or_package(entries: DataFrame, picked: DataFrame) -> DataFrame:
    """The picked entries (see cover_pick) with the cover's bytes, or the first 2000 characters of the package where there is no cover."""
    rows = picked.join(entries.select("archive", "ord", "data"), ["archive", "ord"])
    text = F.substring(F.try_validate_utf8(F.col("data").cast("string")), 1, 2000)
    return rows.select("archive", "ord", "name", "kind", F.when(F.col("kind") == "cover", F.col("data")).alias("cover"), F.when(F.col("kind") == "opf", text).alias("excerpt"))


def _size(data: bytes | None) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, GIF, WebP or JPEG image."""
    if not data:
        return None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:3] == b"GIF" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        if data[at + 1] in range(0xC0, 0xD0) and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(data: pd.Series) -> pd.DataFrame:
    sizes = [_size(x) for x in data]
    return pd.DataFrame({"width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32")})


def write_chapters(chapters: DataFrame, folder: str) -> None:
    """One file for each chapter, by the last part of its name; all of them or, if the job fails, none. The folder must be one that all executors share."""
    name = F.element_at(F.split("file_name", "/"), -1)
    write_named(chapters.select(name.alias("name"), F.coalesce("content", F.lit("")).alias("content")), folder)


def write_cover(picked: DataFrame, path: str) -> bool:
    """The one cover of a book to a file, by a task that commits it (see named_files); whether there was one. Of several, that of the first archive."""
    rows = picked.where("cover is not null").orderBy("archive", "ord").limit(1)
    found = not rows.isEmpty()
    if found:
        write_named(rows.select(F.lit(posixpath.basename(path)).alias("name"), F.col("cover").alias("content")), posixpath.dirname(path) or ".")
    return found
