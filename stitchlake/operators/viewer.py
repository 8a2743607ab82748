"""Rows for an image viewer: shaders, layer settings, state as JSON text.

Layers are rows (source, channel, range_lo, range_hi, visible, color, ...); nothing here renders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = (0, 200)


def monochrome_shader(color: Column, emitter: str = "RGB", vec: str = "vec3") -> Column:
    """Shader of one colour with a normalised intensity control."""
    lines = [f'#uicontrol {vec} color color(default="%s")', "#uicontrol invlerp normalized", "void main() {", f"emit{emitter}(color * normalized());", "}"]
    return F.format_string("\n".join(lines), color)


def rgb_shader(ranges: list[tuple[Column, Column]]) -> Column:
    """Shader of three channels, each with its own range."""
    controls = "".join(f"#uicontrol invlerp normalized_{c}(range=[%d, %d])\n" for c in "rgb")
    values = "".join(f"float {c} = normalized_{c}(getDataValue({i}));\n" for i, c in enumerate("rgb"))
    return F.format_string(controls + "void main(){\n" + values + "emitRGB(vec3(r, g, b));\n}\n", *[v for pair in ranges for v in pair])


def source_url(path: Column, service: str, bucket: str) -> Column:
    """Where a viewer finds an image: work folders go, the bucket comes before; only .zarr is known."""
    inner = F.when(path.contains("/scratch/"), F.replace(path, F.lit("/scratch/"), F.lit(""))).otherwise(F.replace(path, F.lit("/results/"), F.lit("")))
    full = F.when(path.startswith(f"{service}://"), path).otherwise(F.concat(F.lit(f"{service}://{bucket}/"), inner))
    return F.when(full.endswith(".zarr"), F.concat(F.lit("zarr://"), full)).otherwise(F.raise_error(F.concat(F.lit("unknown image format: "), path)))


def layers(rows: DataFrame, service: str, bucket: str) -> DataFrame:
    """Rows with defaults filled in: channel 0, the default range, visible, named by source and channel."""
    channel = F.coalesce(F.col("channel"), F.lit(0))
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]+)?/?$", 1)
    return rows.select(
        source_url(F.col("source"), service, bucket).alias("source"), channel.alias("channel"), F.coalesce("name", F.concat_ws("_", stem, channel)).alias("name"),
        F.coalesce("range_lo", F.lit(RANGE[0])).alias("range_lo"), F.coalesce("range_hi", F.lit(RANGE[1])).alias("range_hi"), F.coalesce("visible", F.lit(True)).alias("visible"),
        monochrome_shader(F.coalesce("color", F.lit("white"))).alias("shader"),
    )


def state(found: DataFrame, voxel: tuple[float, float, float], unit: str = "m", title: str = "", others: DataFrame | None = None) -> DataFrame:
    """One row ``state``: JSON of dimensions and all layers (a viewer shows a handful) in name order: image
    layers, and ``others`` as ``other_layers`` makes them."""
    layer = F.struct(
        "name", F.lit("image").alias("type"), "source", "visible", "shader",
        F.struct(F.struct(F.array("range_lo", "range_hi").alias("range")).alias("normalized")).alias("shaderControls"),
        F.struct(F.array(F.col("channel")).alias("c'")).alias("localPosition"),
    )
    rows = found.select("name", F.to_json(layer).alias("layer"))
    if others is not None:
        rows = rows.unionByName(others.select("name", "layer"))
    size = F.struct(*[F.array(F.lit(str(v)), F.lit(unit)).alias(a) for a, v in zip("xyz", voxel, strict=True)])
    head = F.rtrim(F.to_json(F.struct(F.lit(title).alias("title"), size.alias("dimensions"))), F.lit("}"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("name", "layer"))), lambda r: r["layer"])
    return rows.agg(F.concat(head, F.lit('},"layers":['), F.array_join(ordered, ","), F.lit("]}")).alias("state"))


def other_layers(rows: DataFrame) -> DataFrame:
    """name, type, layer (JSON) of segmentation and annotation layers (name, type, source, tab, segments): the
    first with the precomputed source and the chosen segments, the second with its tab open."""
    segments = F.transform(F.coalesce("segments", F.array().cast("array<long>")), lambda s: s.cast("string"))
    source = F.when(F.col("source").startswith("precomputed://"), F.col("source")).otherwise(F.concat(F.lit("precomputed://"), "source"))
    segmentation = F.struct("name", "type", source.alias("source"), segments.alias("segments"), F.coalesce("tab", F.lit("segments")).alias("tab"))
    annotation = F.struct("name", "type", source.alias("source"), F.coalesce("tab", F.lit("annotations")).alias("tab"), F.lit("#ffff00").alias("annotationColor"))
    layer = F.when(F.col("type") == "segmentation", F.to_json(segmentation)).when(F.col("type") == "annotation", F.to_json(annotation))
    layer = layer.otherwise(F.raise_error(F.concat(F.lit("unknown layer type: "), "type")))
    return rows.select("name", "type", layer.alias("layer"))


#: Upper bound of a wavelength band (nm, exclusive) and its colour.
WAVELENGTH_COLOURS = [
    (460, 0x690AFE),
    (470, 0x3F2EFE),
    (480, 0x4B90FE),
    (490, 0x59D5F8),
    (500, 0x5DF8D6),
    (520, 0x5AFEB8),
    (540, 0x58FEA1),
    (560, 0x51FF1E),
    (565, 0xBBFB01),
    (575, 0xE9EC02),
    (580, 0xF5C503),
    (590, 0xF39107),
    (600, 0xF15211),
    (620, 0xF0121E),
    (750, 0xF00050),
]


def wavelength_colour(nm: Column) -> Column:
    """Colour of the first band whose bound exceeds the wavelength, else of the last band."""
    pick = F
    for upper, colour in WAVELENGTH_COLOURS:
        pick = pick.when(nm < upper, F.lit(colour).cast("long"))
    return pick.otherwise(F.lit(WAVELENGTH_COLOURS[-1][1]).cast("long"))


_PREFIXES = {"": 1.0, "kilo": 1e3, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12}
_SYMBOLS = {"": "", "kilo": "k", "centi": "c", "milli": "m", "micro": "u", "nano": "n", "pico": "p"}
_BASES = {"m": ("meter", "metre"), "s": ("second",)}


def _units() -> dict[str, tuple[float, str]]:
    """Names of lengths and times with their factors to metres and seconds."""
    units = {"micron": (1e-6, "m"), "microns": (1e-6, "m"), "angstrom": (1e-10, "m"), "inch": (0.0254, "m"), "foot": (0.3048, "m"), "minute": (60.0, "s"), "hour": (3600.0, "s"), "day": (86400.0, "s")}
    for prefix, factor in _PREFIXES.items():
        for base, names in _BASES.items():
            units[_SYMBOLS[prefix] + base] = factor, base
            for n in names:
                units[prefix + n] = units[prefix + n + "s"] = factor, base
    return units | {"µm": (1e-6, "m"), "µs": (1e-6, "s")}


UNITS = _units()


def unit_factor(unit: str) -> float:
    return UNITS[unit][0]


def unit_base(unit: str) -> str:
    return UNITS[unit][1]


def in_base_unit(value: Column, unit: Column) -> tuple[Column, Column]:
    """A quantity in metres or seconds, and which of them; null for an unknown unit."""
    table = lambda i: F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[i])])
    return value * table(0)[unit], table(1)[unit]


def voxel_resolution(acquisition: Column) -> Column:
    """[z, y, x] of an acquisition's JSON text: the scale of the first tile of version 1 (``tiles``), or
    of the first image of version 2 and later (``data_streams``); null where there is none."""
    old = F.from_json(acquisition, "schema_version string, tiles array<struct<coordinate_transformations: array<struct<type: string, scale: array<string>>>>>")
    scales = F.flatten(F.transform(old["tiles"], lambda t: F.filter(t["coordinate_transformations"], lambda c: c["type"] == "scale")))
    images = "array<struct<image_to_acquisition_transform: array<struct<object_type: string, scale: array<string>>>>>"
    new = F.from_json(acquisition, f"data_streams array<struct<configurations: array<struct<images: {images}>>>>")
    nested = F.flatten(F.transform(new["data_streams"], lambda s: F.flatten(F.transform(s["configurations"], lambda c: F.coalesce(c["images"], F.array().cast(images))))))
    placed = F.flatten(F.transform(nested, lambda i: F.filter(i["image_to_acquisition_transform"], lambda c: F.lower(c["object_type"]) == "scale")))
    major = F.try_element_at(F.split(old["schema_version"], r"\."), F.lit(1)).try_cast("int")
    found = F.when(major >= 2, F.get(placed, F.lit(0))["scale"]).otherwise(F.get(scales, F.lit(0))["scale"])
    return F.reverse(F.transform(found, lambda v: v.try_cast("double")))
