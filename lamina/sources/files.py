"""Image files in, decks and reports out."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.strings import collapsed_stem, escaped, three_places

#: English metric units of an inch; suffixes that count as images.
EMU_PER_INCH = 914400
SUFFIXES = "png,jpg,jpeg,webp"


def list_images(spark: SparkSession, folder: str, start: int = 1, limit: int | None = None) -> DataFrame:
    """path, length: image files by name, from the start-th on (counted from 1)."""
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES.split(",")) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path").offset(start - 1)
    return files if limit is None else files.limit(limit)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """image_id (hash of the path), path, width, height, channels and data of PNG and JPEG files; files that can't be read are left out."""
    i = spark.read.format("image").option("dropInvalid", True).load(folder)
    return i.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def image_pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b. Bytes are in the order blue, green, red, and opacity, which is ignored; one channel is grey."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, width, height, channels, data in batch[["image_id", "width", "height", "channels", "data"]].itertuples(index=False):
                px = np.frombuffer(data, np.uint8).reshape(height * width, channels)
                r, g, b = (px[:, 2], px[:, 1], px[:, 0]) if channels > 1 else (px[:, 0],) * 3
                at = np.arange(height * width)
                for part in range(0, len(at), 1 << 20):
                    own = slice(part, part + (1 << 20))
                    yield pd.DataFrame({"image_id": i, "y": at[own] // width, "x": at[own] % width, "r": r[own], "g": g[own], "b": b[own]})

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(rows, "image_id long, y int, x int, r int, g int, b int")


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An RGBA image."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgba[at : at + width * 4] for at in range(0, len(rgba), width * 4))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def placed(layers: DataFrame, first_width: Column, first_height: Column, dpi: float = 112.0) -> DataFrame:
    """Layers (x, y, width, height, image_width, image_height) with their place on a slide of the deck's size, in EMU."""
    sw, sh = F.bround(first_width / dpi * EMU_PER_INCH), F.bround(first_height / dpi * EMU_PER_INCH)
    scale = F.least(sw / F.col("image_width"), sh / F.col("image_height"))
    left, top = (sw - F.col("image_width") * scale) / 2, (sh - F.col("image_height") * scale) / 2
    spot = {"left_emu": left + F.col("x") * scale, "top_emu": top + F.col("y") * scale, "width_emu": F.col("width") * scale, "height_emu": F.col("height") * scale}
    return layers.select("*", sw.cast("long").alias("slide_width"), sh.cast("long").alias("slide_height"), *[F.bround(v).cast("long").alias(k) for k, v in spot.items()])


MANIFEST = "file,slides,objects,picture_layers,text_layers"


def manifest(decks: DataFrame) -> DataFrame:
    """bundle, place, line: the list of each bundle, its heading (place 0) and a row for each deck (bundle, name, slides, objects, picture_layers, text_layers) by name and id, numbered within the bundle."""
    place = F.row_number().over(Window.partitionBy("bundle").orderBy("name", "image_id"))
    named = decks.withColumn("place", place).withColumn("file", F.concat(F.format_string("%02d_", "place"), collapsed_stem(F.col("name")), F.lit("_layers.pptx")))
    rows = named.select("bundle", "place", F.concat_ws(",", "file", "slides", "objects", "picture_layers", "text_layers").alias("line"))
    return rows.unionByName(decks.select("bundle").distinct().select("bundle", F.lit(0).alias("place"), F.lit(MANIFEST).alias("line")))


def report_rows(rows: DataFrame) -> DataFrame:
    """image_id, html: a table row of nine cells for each report row (index, name, mode, threshold, editable_text_lines, ocr_lines, raster_layers, mae, psnr, edge_f1, preview)."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    text = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    link = F.regexp_extract("preview", "([^/]*)$", 1)
    preview = F.when(F.coalesce("preview", F.lit("")) == "", "").otherwise(F.concat(F.lit('<a href="'), link, F.lit('"><img src="'), link, F.lit('" loading="lazy"></a>')))
    pair = lambda a, mark, b: F.concat(text(a), F.lit(mark), text(b))
    cells = [text("index"), text("name"), pair("mode", "@", "threshold"), pair("editable_text_lines", "/", "ocr_lines"), text("raster_layers"), *[three_places(F.col(c)) for c in ("mae", "psnr", "edge_f1")], preview]
    return rows.select("image_id", F.concat(F.lit("<tr>"), *map(cell, cells), F.lit("</tr>")).alias("html"))


def metadata_json(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """key, json: each row's values as one JSON object, missing ones left out, for one file an image."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"


def run_xml(run: dict) -> str:
    """A run of text of one colour: text, r, g, b, font_size (points) and bold."""
    colour = f'{int(run["r"]):02X}{int(run["g"]):02X}{int(run["b"]):02X}'
    size = round(float(run["font_size"] or 18) * 100)
    return f'<a:r><a:rPr lang="en-US" sz="{size}" b="{int(bool(run["bold"]))}" dirty="0"><a:solidFill><a:srgbClr val="{colour}"/></a:solidFill><a:latin typeface="Aptos Display"/></a:rPr><a:t>{escape(run["text"])}</a:t></a:r>'


def shape_xml(number: int, shape: dict) -> str:
    """A picture, or a box of text runs without margins."""
    spot = f'<a:xfrm><a:off x="{shape["left"]}" y="{shape["top"]}"/><a:ext cx="{shape["width"]}" cy="{shape["height"]}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom>'
    name = escape(shape["name"], {'"': "&quot;"})
    if shape.get("runs") is None:
        return f'<p:pic><p:nvPicPr><p:cNvPr id="{number}" name="{name}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId{number}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{spot}</p:spPr></p:pic>'
    runs = "".join(map(run_xml, shape["runs"]))
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{spot}<a:noFill/></p:spPr><p:txBody><a:bodyPr wrap="square" lIns="0" tIns="0" rIns="0" bIns="0" anchor="t"><a:normAutofit/></a:bodyPr><a:lstStyle/><a:p><a:pPr algn="l"><a:spcBef><a:spcPts val="0"/></a:spcBef><a:spcAft><a:spcPts val="0"/></a:spcAft></a:pPr>{runs}</a:p></p:txBody></p:sp>'


def deck(width: int, height: int, slides: list[tuple[str, list[dict]]]) -> bytes:
    """A deck. slides: background colour and shapes (name, left, top, width, height in EMU; png of a picture, or runs of a text box)."""
    kind, rel = "application/vnd.openxmlformats-officedocument.presentationml.", "http://schemas.openxmlformats.org/package/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    spaces = f'xmlns:a="{DRAWING}" xmlns:r="{RELATIONS}" xmlns:p="{SLIDES}"'
    links = lambda rows: head + f'<Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/{t}" Target="{to}"/>' for i, t, to in rows) + "</Relationships>"
    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    fill = lambda c: f'<a:solidFill><a:srgbClr val="{c}"/></a:solidFill>'
    numbers = range(1, len(slides) + 1)
    parts = [("presentation", "presentation.main"), ("slideLayouts/slideLayout1", "slideLayout"), ("slideMasters/slideMaster1", "slideMaster"), *[(f"slides/slide{n}", "slide") for n in numbers]]
    files: dict[str, str | bytes] = {
        "[Content_Types].xml": head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>' + "".join(f'<Override PartName="/ppt/{path}.xml" ContentType="{kind}{t}+xml"/>' for path, t in parts) + "</Types>",
        "_rels/.rels": links([(1, "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": head + f'<p:presentation {spaces}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + n}" r:id="rId{n + 1}"/>' for n in numbers) + f'</p:sldIdLst><p:sldSz cx="{width}" cy="{height}"/><p:notesSz cx="{height}" cy="{width}"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": links([(1, "slideMaster", "slideMasters/slideMaster1.xml"), *[(n + 1, "slide", f"slides/slide{n}.xml") for n in numbers]]),
        "ppt/slideMasters/slideMaster1.xml": head + f'<p:sldMaster {spaces}><p:cSld><p:spTree>{group}</p:spTree></p:cSld><p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": links([(1, "slideLayout", "../slideLayouts/slideLayout1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": head + f'<p:sldLayout {spaces} type="blank"><p:cSld><p:spTree>{group}</p:spTree></p:cSld></p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": links([(1, "slideMaster", "../slideMasters/slideMaster1.xml")]),
    }
    for n, (colour, shapes) in zip(numbers, slides, strict=True):
        pictures = [i for i, s in enumerate(shapes, 2) if s.get("runs") is None]
        body = "".join(shape_xml(i, s) for i, s in enumerate(shapes, 2))
        files[f"ppt/slides/slide{n}.xml"] = head + f"<p:sld {spaces}><p:cSld><p:bg><p:bgPr>{fill(colour)}<a:effectLst/></p:bgPr></p:bg><p:spTree>{group}{body}</p:spTree></p:cSld></p:sld>"
        files[f"ppt/slides/_rels/slide{n}.xml.rels"] = links([(1, "slideLayout", "../slideLayouts/slideLayout1.xml"), *[(i, "image", f"../media/image{n}_{i}.png") for i in pictures]])
        files |= {f"ppt/media/image{n}_{i}.png": shapes[i - 2]["png"] for i in pictures}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def pictures(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """image_id, layer_id, png: each layer's pixels (image_id, layer_id, y, x, r, g, b, alpha) in its box (x, y, width, height). A task has one layer's pixels."""
    box = layers.select("image_id", "layer_id", *[F.col(c).cast("int").alias(n) for c, n in (("x", "left"), ("y", "top"), ("width", "width"), ("height", "height"))])

    def drawn(rows: pa.Table) -> pa.Table:
        left, top, width, height = (rows.column(c)[0].as_py() for c in ("left", "top", "width", "height"))
        rgba = np.zeros((height, width, 4), np.uint8)
        rgba[rows.column("y").to_numpy() - top, rows.column("x").to_numpy() - left] = np.stack([rows.column(c).to_numpy() for c in ("r", "g", "b", "alpha")], axis=1)
        return pa.table({"image_id": rows.column("image_id")[:1], "layer_id": rows.column("layer_id")[:1], "png": pa.array([png(width, height, rgba.tobytes())], pa.binary())})

    own = cells.select(F.col("image_id").cast("long"), "layer_id", *[F.col(c).cast("int") for c in ("y", "x", "r", "g", "b", "alpha")])
    return own.join(box, ["image_id", "layer_id"]).groupBy("image_id", "layer_id").applyInArrow(drawn, "image_id long, layer_id string, png binary")


def decks(layers: DataFrame, cells: DataFrame, background: DataFrame, texts: DataFrame | None = None, deck_of: DataFrame | None = None) -> DataFrame:
    """deck_id, pptx: a deck for each deck_id, a slide for each of its images in order of slide.

    layers: placed ones with layer_id and z; cells: image_id, layer_id, y, x, r, g, b, alpha; texts: placed boxes with
    layer_id and runs (text, r, g, b, font_size, bold), which go on top; deck_of: image_id, deck_id and slide, else
    each image is a deck. A deck has the size of its first slide, by which layers are placed. A task has one deck's slides.
    """
    raster = pictures(cells, layers)
    runs = "array<struct<text: string, r: int, g: int, b: int, font_size: double, bold: boolean>>"
    spot = ["image_id", "layer_id", "z", "x", "y", "width", "height", "left_emu", "top_emu", "width_emu", "height_emu", "slide_width", "slide_height"]
    rows = layers.join(raster, ["image_id", "layer_id"]).select(*spot, "png", F.expr(f"cast(null as {runs})").alias("runs"))
    if texts is not None:
        # Fixed value: a text box is 1.15 times as high as its line.
        tall = F.bround(F.col("height_emu") * 1.15).cast("long").alias("height_emu")
        rows = rows.unionByName(texts.select(*[tall if c == "height_emu" else F.col(c) for c in spot], F.lit(None).cast("binary").alias("png"), F.col("runs").cast(runs).alias("runs")))
    deck_of = background.select("image_id", F.col("image_id").alias("deck_id"), F.lit(1).alias("slide")) if deck_of is None else deck_of
    shape = F.struct(F.col("runs").isNotNull().alias("on_top"), *[c for c in ("z", "layer_id", "x", "y", "width", "height", "left_emu", "top_emu", "width_emu", "height_emu")], "png", "runs")
    slide = rows.groupBy("image_id").agg(F.first("slide_width").alias("slide_width"), F.first("slide_height").alias("slide_height"), F.collect_list(shape).alias("shapes"))
    whole = deck_of.join(background, "image_id").join(slide, "image_id").select("deck_id", "slide", "slide_width", "slide_height", "bg_r", "bg_g", "bg_b", "shapes")

    def made(rows: pa.Table) -> pa.Table:
        slides = sorted(rows.to_pylist(), key=lambda r: r["slide"])
        content = []
        for r in slides:
            shapes = []
            for s in sorted(r["shapes"], key=lambda s: (s["on_top"], s["z"], s["layer_id"])):
                shown = {"name": s["layer_id"], "left": s["left_emu"], "top": s["top_emu"], "width": s["width_emu"], "height": s["height_emu"]}
                shapes.append(shown | ({"png": s["png"]} if s["runs"] is None else {"runs": s["runs"]}))
            content.append((f"{r['bg_r']:02X}{r['bg_g']:02X}{r['bg_b']:02X}", shapes))
        first = slides[0]
        return pa.table({"deck_id": pa.array([first["deck_id"]], pa.int64()), "pptx": pa.array([deck(first["slide_width"], first["slide_height"], content)], pa.binary())})

    return whole.groupBy("deck_id").applyInArrow(made, "deck_id long, pptx binary")
