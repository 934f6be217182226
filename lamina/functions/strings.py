"""Names, labels and small parsers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_stem(name: Column, default: str = "image") -> Column:
    """Letters, digits, - and _; white space becomes _, the rest goes; 80 characters; the default if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r"\s", "_"), r"[^\p{L}\p{N}_-]", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 80), F.lit("")), F.lit(default))


def path_stem(path: Column) -> Column:
    """The last part of a path, without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"^(.+)\.[^.]+$", "$1")


def collapsed_stem(path: Column) -> Column:
    """Of a path's stem: runs of anything but letters and digits become one _; none at the ends; `image` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(path_stem(path), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("image"))


def download_name(names: Column, bundled: Column, product: str = "lamina") -> Column:
    """What a download is called. names: an array of the uploaded files' names; bundled: whether it is a bundle of decks, else it is one deck."""
    n = F.coalesce(F.size(names), F.lit(0))
    many = F.concat(F.lit(f"{product}_"), n.cast("string"))
    stem = safe_stem(path_stem(F.coalesce(F.get(names, F.lit(0)), F.lit(f"{product}_output"))), f"{product}_output")
    bundle = F.when(n > 1, F.concat(many, F.lit("_pptx_layers.zip"))).otherwise(f"{product}_pptx_layers.zip")
    return F.when(bundled, bundle).when(n > 1, F.concat(many, F.lit("_slides_layers.pptx"))).otherwise(F.concat(stem, F.lit("_layers.pptx")))


def output_mode(asked: Column, files: Column) -> Column:
    """A bundle only if it is asked for and there are several files."""
    return F.when((asked == "zip") & (files > 1), "zip").otherwise("deck")


def unfenced(text: Column) -> Column:
    """An answer without the marks of a block of code around it, and the name of its language."""
    bare = F.regexp_replace(F.trim(text), "^`+|`+$", "")
    return F.trim(F.when(F.startswith(text, F.lit("```")), F.regexp_replace(bare, "(?i)^json", "")).otherwise(text))


def parsed_json(text: Column, schema: str) -> Column:
    """The object in an answer, null if there is none that can be read."""
    return F.from_json(json_slice(unfenced(text)), schema, {"mode": "PERMISSIVE"})


def escaped(text: Column) -> Column:
    """HTML text."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def three_places(value: Column) -> Column:
    """With three decimal places; nothing for null."""
    return F.when(value.isNull(), "").otherwise(F.format_string("%.3f", value))


def threshold_label(value: Column) -> Column:
    """35.0: 35; 17.5: 17p5."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.replace(value.cast("string"), F.lit("."), F.lit("p")))


def model_list(text: Column) -> Column:
    """Names from lines and commas, trimmed, without empty ones, comments and repetitions."""
    parts = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(",")), ","), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & ~p.startswith("#")))


def json_slice(text: Column) -> Column:
    """From the first { to the last }; null without both."""
    start, end = F.instr(text, "{"), F.char_length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (F.instr(text, "}") > 0) & (end >= start), text.substr(start, end - start + 1))


def thresholds(text: Column, default: Column | None = None) -> Column:
    """Distinct numbers of a list with commas, in order; the default (an array) where there are none. Anything but a number is an error."""
    found = F.array_distinct(F.transform(F.filter(F.split(text, ","), lambda t: F.trim(t) != ""), lambda t: F.trim(t).cast("double")))
    return found if default is None else F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(default)


def data_url(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content.cast("binary")), r"[\r\n]", ""))


def counted(n: Column, name: str) -> Column:
    """1 image, 2 images."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {name}").otherwise(f" {name}s"))


def one_of(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(known), value).otherwise(default)


def merged_maps(own: Column, other: Column) -> Column:
    """Entries of both, the other's where both have a key; a null map has none."""
    other = F.coalesce(other, F.map_filter(own, lambda k, v: F.lit(False)))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(other, k)), other)


def first_set(*values: Column, default: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))
