"""Project descriptors: XML scans into typed tables, checks, and the writer.

The scans use Spark's XML reader with explicit schemas, one row tag a section, so a descriptor is
read where Spark can reach it and malformed numbers become nulls that the checks report.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "_view_setup string, _timepoint string, _series string, _channel string, file struct<_VALUE string, _type string>"
_ZGROUP = "_setup string, _timepoint string, path struct<_VALUE string, _type string>"
_SETUP = "id string, name string, size string, voxelSize struct<unit string, size string>, attributes string"
_REGISTRATION = "_timepoint string, _setup string, ViewTransform array<struct<_type string, Name string, affine string>>"
_POINTS = "_VALUE string, _timepoint string, _setup string, _label string, _params string"
SECTIONS = ["ImageLoader", "ViewSetups", "ViewRegistrations", "ViewInterestPoints"]


def _scan(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def numbers(text: Column) -> Column:
    """Blank- or comma-separated numbers of a text as doubles."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"[\s,]+", " ")), " "), lambda v: v.cast("double"))


def _value(c: str) -> Column:
    return F.trim(F.col(f"{c}._VALUE"))


def views(spark: SparkSession, path: str) -> DataFrame:
    """timepoint, setup, series, channel, file_path, of either loader: files of a file map, or groups
    of a chunked store, whose channel stands in the path and whose series is 1."""
    tiff = _scan(spark, path, "FileMapping", _FILE).select(
        F.col("_timepoint").cast("int").alias("timepoint"), F.col("_view_setup").cast("int").alias("setup"), F.col("_series").cast("int").alias("series"),
        F.col("_channel").alias("channel"), F.coalesce(_value("file")).alias("file_path"),
    )
    p = _value("path")
    zarr = _scan(spark, path, "zgroup", _ZGROUP).select(
        F.col("_timepoint").cast("int").alias("timepoint"), F.col("_setup").cast("int").alias("setup"), F.lit(1).alias("series"),
        F.regexp_extract(p, r"_ch_(.*?)\.ome\.zarr", 1).alias("channel"), p.alias("file_path"),
    )
    return tiff.unionByName(zarr)


def view_setups(spark: SparkSession, path: str) -> DataFrame:
    """id, name, size, voxel_unit, voxel_size, attributes (a map of whatever elements there are)."""
    s = _scan(spark, path, "ViewSetup", _SETUP)
    pairs = F.regexp_extract_all("attributes", F.lit(r"<(\w+)>\s*([^<]*?)\s*</\w+>"), 1)
    values = F.regexp_extract_all("attributes", F.lit(r"<(\w+)>\s*([^<]*?)\s*</\w+>"), 2)
    return s.filter("id IS NOT NULL").select(
        F.trim("id").cast("int").alias("id"), "name", F.transform(numbers(F.col("size")), lambda v: v.cast("int")).alias("size"),
        F.col("voxelSize.unit").alias("voxel_unit"), numbers(F.col("voxelSize.size")).alias("voxel_size"),
        F.when(F.col("attributes").isNotNull(), F.map_from_arrays(pairs, values)).alias("attributes"),
    )


def view_transforms(spark: SparkSession, path: str) -> DataFrame:
    """timepoint, setup, seq, type, name, affine: the ordered models of each view."""
    r = _scan(spark, path, "ViewRegistration", _REGISTRATION)
    rows = r.select(F.col("_timepoint").cast("int").alias("timepoint"), F.col("_setup").cast("int").alias("setup"), F.posexplode("ViewTransform").alias("seq", "t"))
    return rows.select("timepoint", "setup", "seq", F.col("t._type").alias("type"), F.trim("t.Name").alias("name"), numbers(F.col("t.affine")).alias("affine"))


def point_sets(spark: SparkSession, path: str) -> DataFrame:
    p = _scan(spark, path, "ViewInterestPointsFile", _POINTS)
    return p.select(F.col("_timepoint").cast("int").alias("timepoint"), F.col("_setup").cast("int").alias("setup"), F.col("_label").alias("label"), F.col("_params").alias("params"), F.trim("_VALUE").alias("path"))


def check(spark: SparkSession, path: str) -> None:
    """Raise ValueError unless the sections exist, files are listed, and the counts agree: one
    registration a file and two registrations a setup."""
    text = spark.read.text(path, wholetext=True)
    has = text.select(*[F.col("value").contains(f"<{s}").alias(s) for s in SECTIONS]).agg(*[F.max(s).alias(s) for s in SECTIONS]).first()
    if has is None or not all(has):
        raise ValueError("Required labels do not exist")
    files, setups = views(spark, path).count(), view_setups(spark, path).count()
    registrations = _scan(spark, path, "ViewRegistration", _REGISTRATION).count()
    if not files:
        raise ValueError("There are no files in this XML")
    if files != registrations or setups * 2 != registrations:
        raise ValueError(f"Counts do not match: {files} files, {registrations} registrations, {setups} setups")


def view_sizes(views_df: DataFrame, setups: DataFrame) -> DataFrame:
    """timepoint, setup, size, voxel_size of every timepoint and setup with a known size."""
    axis = views_df.agg(F.array_sort(F.collect_set("timepoint")).alias("timepoints"))  # one row
    sized = setups.filter("size IS NOT NULL").select(F.col("id").alias("setup"), "size", "voxel_size")
    return sized.join(F.broadcast(axis)).select(F.explode("timepoints").alias("timepoint"), "setup", "size", "voxel_size")


def labels(points: DataFrame) -> DataFrame:
    """The labels of each view, in their order."""
    return points.groupBy("timepoint", "setup").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def with_models(transforms: DataFrame, models: DataFrame, name: str) -> DataFrame:
    """The transform lists with a solved model (timepoint, setup, affine) put before each; identity where a view has none."""
    identity = F.array(*[F.lit(float(i % 5 == 0)) for i in range(12)])
    views_ = transforms.select("timepoint", "setup").distinct()
    first = views_.join(models, ["timepoint", "setup"], "left").select(
        "timepoint", "setup", F.lit(0).alias("seq"), F.lit("affine").alias("type"), F.lit(name).alias("name"), F.coalesce("affine", identity).alias("affine")
    )
    return first.unionByName(transforms.withColumn("seq", F.col("seq") + 1))


def split_tables(views_df: DataFrame, setups: DataFrame, transforms: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(setups, transforms) of a descriptor whose views are the ``parts`` (id, new_id, lower, upper) of
    others: a part has its own size, the attributes of its whole and its number as ``tile``; its
    transforms are those of the whole, then its place in it."""
    of = parts.select("id", "new_id", "lower", "upper")
    size = F.transform(F.arrays_zip("lower", "upper"), lambda b: (b["upper"] - b["lower"] + 1).cast("int"))
    tile = F.map_from_arrays(F.array(F.lit("tile")), F.array(F.col("new_id").cast("string")))
    kept = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, v: k != "tile")
    new_setups = setups.join(of, "id").select(F.col("new_id").cast("long").alias("id"), F.concat_ws(" part ", "name", "new_id").alias("name"), size.alias("size"), "voxel_unit", "voxel_size", F.map_concat(kept, tile).alias("attributes"))
    own = transforms.join(of.withColumnRenamed("id", "setup"), "setup")
    moved = own.select("timepoint", F.col("new_id").alias("setup"), "seq", "type", "name", "affine")
    shift = F.array(*[F.lit(float(i % 5 == 0)) if i % 4 < 3 else F.get("lower", F.lit(i // 4)).cast("double") for i in range(12)])
    last = own.groupBy("timepoint", "new_id").agg((F.max("seq") + 1).alias("seq"), F.first("lower").alias("lower"))
    place = last.select("timepoint", F.col("new_id").alias("setup"), "seq", F.lit("affine").alias("type"), F.lit("part of the whole view").alias("name"), shift.alias("affine"))
    return new_setups, moved.unionByName(place)


def _split_loader(inner: list[str], parts: DataFrame) -> list[str]:
    """The loader of the whole views wrapped with the parts that come from them."""
    out = ['    <ImageLoader format="split.viewerimgloader">', *["  " + x for x in inner], "      <SetupIds>"]
    text = lambda vs: " ".join(str(v) for v in vs)
    for r in parts.orderBy("new_id").toLocalIterator():
        out.append(f"        <SetupIdDefinition><NewId>{r.new_id}</NewId><OldId>{r.id}</OldId><min>{text(r.lower)}</min><max>{text(r.upper)}</max></SetupIdDefinition>")
    return [*out, "      </SetupIds>", "    </ImageLoader>"]


def split_parts(spark: SparkSession, path: str) -> DataFrame:
    """id, new_id, lower, upper of a descriptor of parts."""
    d = _scan(spark, path, "SetupIdDefinition", "NewId long, OldId long, min string, max string")
    box = lambda c: F.transform(numbers(F.col(c)), lambda v: v.cast("int"))
    return d.select(F.col("OldId").alias("id"), F.col("NewId").alias("new_id"), box("min").alias("lower"), box("max").alias("upper"))


def tiles_in(spark: SparkSession, folder: str) -> DataFrame:
    """name, channel of the tile folders (*.zarr) directly below a folder, in order of names. The driver lists
    one folder; its rows are metadata."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    names = sorted(i.base_name for i in where.get_file_info(fs.FileSelector(path, recursive=False)) if i.base_name.endswith(".zarr"))
    found = spark.createDataFrame([(n,) for n in names], "name string")
    channel = F.regexp_extract("name", r"(?:ch|CH)_(\d+)", 1)
    return found.select("name", F.when(channel != "", channel.cast("int")).alias("channel"))


def channels(tiles: DataFrame) -> DataFrame:
    """channel, first (name): the channels of tiles, in the order in which they first appear."""
    return tiles.filter("channel IS NOT NULL").groupBy("channel").agg(F.min("name").alias("first")).orderBy("first")


def _text(values) -> str:
    return " ".join(str(v) for v in values)


def _file(r) -> str:
    return f'        <FileMapping view_setup="{r.setup}" timepoint="{r.timepoint}" series="{r.series}" channel={quoteattr(str(r.channel))}><file type="relative">{escape(r.file_path)}</file></FileMapping>'


def _setup(r) -> str:
    attributes = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in sorted(dict(r.attributes or {}).items()))
    return f"      <ViewSetup><id>{r.id}</id><name>{escape(r.name or '')}</name><size>{_text(r.size)}</size><voxelSize><unit>{escape(r.voxel_unit or '')}</unit><size>{_text(r.voxel_size)}</size></voxelSize><attributes>{attributes}</attributes></ViewSetup>"


def _registration(r) -> str:
    inner = "".join(f"<ViewTransform type={quoteattr(t['type'])}><Name>{escape(t['name'])}</Name><affine>{_text(t['affine'])}</affine></ViewTransform>" for t in r.t)
    return f'    <ViewRegistration timepoint="{r.timepoint}" setup="{r.setup}">{inner}</ViewRegistration>'


def _point_set(r) -> str:
    return f'    <ViewInterestPointsFile timepoint="{r.timepoint}" setup="{r.setup}" label={quoteattr(r.label)} params={quoteattr(r.params or "")}>{escape(r.path)}</ViewInterestPointsFile>'


def _whole(base: str, loader: list[str], setups: list[str], registrations: list[str], points: list[str]) -> str:
    return "\n".join([
        '<?xml version="1.0" encoding="UTF-8"?>', '<SpimData version="0.2">', f'  <BasePath type="relative">{escape(base)}</BasePath>', "  <SequenceDescription>", *loader,
        "    <ViewSetups>", *setups, "    </ViewSetups>", "  </SequenceDescription>", "  <ViewRegistrations>", *registrations, "  </ViewRegistrations>",
        "  <ViewInterestPoints>", *points, "  </ViewInterestPoints>", "</SpimData>", "",
    ])


def _loader(files: list[str]) -> list[str]:
    return ['    <ImageLoader format="spimreconstruction.filemap2">', "      <files>", *files, "      </files>", "    </ImageLoader>"]


def _lists(transforms: DataFrame) -> DataFrame:
    return transforms.groupBy("timepoint", "setup").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "name", "affine"))).alias("t"))


def to_xml(views_df: DataFrame, setups: DataFrame, transforms: DataFrame, points: DataFrame | None = None, base: str = ".", parts: DataFrame | None = None) -> str:
    """One descriptor from its tables; with ``parts`` one of a split project, whose ``views_df`` are the whole
    views. A descriptor is small metadata (a few rows a view), streamed to the driver, which alone
    writes the one file; ``write_descriptors`` writes many."""
    rows = lambda df, *by: df.orderBy(*by).toLocalIterator()
    loader = _loader([_file(r) for r in rows(views_df, "timepoint", "setup")])
    sets = [_point_set(r) for r in rows(points, "timepoint", "setup", "label")] if points is not None else []
    return _whole(base, loader if parts is None else _split_loader(loader, parts), [_setup(r) for r in rows(setups, "id")], [_registration(r) for r in rows(_lists(transforms), "timepoint", "setup")], sets)


def write_descriptors(views_df: DataFrame, setups: DataFrame, transforms: DataFrame, points: DataFrame, project: DataFrame, folder: str, base: str = ".") -> int:
    """A descriptor file for each project below ``folder``, written by executors; their number. ``project``: setup and
    name of the project that it belongs to. Rows become lines where they lie, and a project's lines meet in the
    task that writes its file. ``views`` and the other scans read the folder as they read a file."""

    def lines(df: DataFrame, section: int, form, order: list[str]) -> DataFrame:
        def run(frames):
            import pandas as pd

            for f in frames:
                yield pd.DataFrame({"project": f["project"], "section": section, "at": f["at"], "line": [form(r) for r in f.itertuples(index=False)]})

        named = df.join(project.select("setup", F.col("name").alias("project")), "setup").withColumn("at", F.concat_ws(" ", *[F.lpad(F.col(c).cast("string"), 20, "0") if c != "label" else F.col(c) for c in order]))
        return named.mapInPandas(run, "project string, section int, at string, line string")

    files = lines(views_df, 0, _file, ["timepoint", "setup"])
    owned = setups.withColumn("setup", F.col("id"))
    rest = [lines(owned, 1, _setup, ["id"]), lines(_lists(transforms), 2, _registration, ["timepoint", "setup"]), lines(points, 3, _point_set, ["timepoint", "setup", "label"])]

    def write(f):
        import pandas as pd
        from pyarrow import fs

        of = [f.loc[f["section"] == k].sort_values("at")["line"].tolist() for k in range(4)]
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/{f['project'].iloc[0]}.xml", compression=None) as out:
            out.write(_whole(base, _loader(of[0]), *of[1:]).encode())
        return pd.DataFrame({"n": [1]})

    for df in rest:
        files = files.unionByName(df)
    return files.groupBy("project").applyInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def markers(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of cell markers."""
    m = _scan(spark, path, "Marker", "MarkerX double, MarkerY double, MarkerZ double")
    return m.select(F.col("MarkerX").alias("x"), F.col("MarkerY").alias("y"), F.col("MarkerZ").alias("z"))


def curated_links(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Links of the JSON files below a folder that have one, written as CSV; unreadable files are skipped."""
    links = (
        spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).schema("ng_link string").json(folder)
        .withColumn("file", F.input_file_name()).filter(F.col("ng_link").isNotNull()).select("file", "ng_link")
    )
    links.write.mode("overwrite").option("header", True).csv(out)
    return links


def upsert_metric(current: str | None, key: str, value: dict) -> str:
    """JSON text of a metrics file with one key set; missing or damaged text starts anew."""
    import json

    try:
        found = json.loads(current or "{}")
    except ValueError:
        found = {}
    return json.dumps((found if isinstance(found, dict) else {}) | {key: value}, indent=2)
