"""Maps of a screen: where each value stands on it, exported as documents, valid until the next one, laid on captured frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.scalars import iso_time
from ..sources import snapshots
from . import asof, versions
from .geometry import CELL_COLUMNS, CELL_ROWS, COLUMNS

#: Fixed: the kind of map whose boxes are the values' own, not the cells' around them.
VALUE_BOXES = "value_widget_bbox_screen"
#: Fixed: vitals whose boxes are widened to the right, and by what share of their width.
WIDENED, WIDER = ["VTi", "VTe"], 0.30
SIDES = ("x", "y", "w", "h")


@dataclass(frozen=True)
class Slice:
    """The part of a cell in which its value stands, as shares of its width and height; each is brought into 0 to 1, and a pair into order."""

    x1: float = 0.60
    x2: float = 0.98
    y1: float = 0.10
    y2: float = 0.92

    def spans(self) -> tuple[float, float, float, float]:
        x1, x2, y1, y2 = (min(max(r, 0.0), 1.0) for r in (self.x1, self.x2, self.y1, self.y2))
        return min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)


def _between(value: Column, least: Column, most: Column) -> Column:
    return F.greatest(least, F.least(most, value))


def export(widgets: DataFrame, keys: Sequence[str], at: str, roi_type: str = VALUE_BOXES, title: str = "") -> DataFrame:
    """``keys``, ``at`` (an instant) and ``document``: a map for each of them, of rows with ``bed``, ``vital`` and a box ``x, y, w, h``.

    Boxes without width or height, or with a null in them, are left out, and so are beds without boxes; of a bed's vital
    given twice the greatest box counts. A map whose boxes all go has no items. A map has at most beds times vitals boxes.
    """
    there = (F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("bed").isNotNull() & F.col("vital").isNotNull()
    box = F.struct(*[F.col(s).cast("int").alias(s) for s in SIDES])
    own = widgets.groupBy(*keys, at, "bed", "vital").agg(F.max(F.when(there, box)).alias("box"))
    entry = F.when(F.col("box").isNotNull(), F.struct(F.col("vital"), F.col("box")))
    beds = own.groupBy(*keys, at, "bed").agg(F.map_from_entries(F.collect_list(entry)).alias("boxes"))
    kept = F.when(F.size("boxes") > 0, F.struct(F.col("bed"), F.col("boxes")))
    maps = beds.groupBy(*keys, at).agg(F.map_from_entries(F.collect_list(kept)).alias("items"))
    stamp = F.date_format(F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    return maps.select(*keys, at, F.to_json(F.struct(stamp.alias("generated_at"), F.lit(title).alias("window_title"), F.lit(roi_type).alias("roi_type"), "items")).alias("document"))


def load(documents: DataFrame, keys: Sequence[str], text: str = "document") -> DataFrame:
    """``keys``, ``generated_at``, ``roi_type`` (lower case, trimmed) and ``items`` (JSON, members in order of names) of each map.

    A text that is no JSON object, or whose ``items`` is none, is no map; null and empty texts neither. A map
    without a time that can be read has a null one. Other columns are dropped.
    """
    snapshots.prepare(documents.sparkSession)
    doc = documents.select(*keys, F.try_parse_json(text).alias("_doc"))
    doc = doc.where(snapshots.is_object(F.col("_doc"))).withColumn("_items", F.try_variant_get("_doc", "$.items", "variant")).where(snapshots.is_object(F.col("_items")))
    text_of = lambda name: F.try_variant_get("_doc", f"$.{name}", "string")
    return doc.select(*keys, iso_time(text_of("generated_at")).alias("generated_at"), F.lower(F.trim(F.coalesce(text_of("roi_type"), F.lit("")))).alias("roi_type"), F.to_json("_items").alias("items"))


def load_folder(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """``path`` and the columns of ``load`` for the maps in a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    return load(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")), ["path"])


def validity(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for as long as a screen's map does not change: ``keys``, ``roi_type``, ``items``, ``valid_from``, ``valid_to`` (null for the last).

    A map stands until the next one of its screen. Of maps of one time the greatest counts; maps without a time do not.
    """
    # A screen's own maps are its snapshots: those of other screens do not end it. So its map is told from a change alone, by what came before.
    stood = versions.changes(maps, list(keys), "generated_at", ["roi_type", "items"])
    return stood.select(*keys, "roi_type", "items", "valid_from", "valid_to")


def capture(rect: Column, fallback: Column) -> Column:
    """The rectangle that is captured (a struct ``left, top, width, height``): the configured one if none of it is null and it has an extent, else the fallback."""
    usable = (rect["width"] > 0) & (rect["height"] > 0) & rect["left"].isNotNull() & rect["top"].isNotNull()
    return F.when(F.coalesce(usable, F.lit(False)), rect).otherwise(fallback)


def _whole(box: Column, side: str) -> Column:
    """A member of a box as a whole number: numbers are cut off at the point, texts count if they are whole numbers; null for anything else."""
    member = F.try_variant_get(box, f"$.{side}", "variant")
    text = F.try_variant_get(member, "$", "string")
    number = F.try_variant_get(member, "$", "double").cast("long")
    return F.when(F.schema_of_variant(member) == "STRING", F.when(text.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(text).try_cast("long"))).otherwise(number)


def boxes(maps: DataFrame) -> DataFrame:
    """A row for each box of a known bed and vital: ``maps`` with ``bed, vital, x, y, w, h`` in place of ``items``. Boxes that cannot be read, or have no extent, are left out."""
    beds = snapshots.members(maps.withColumn("_items", F.try_parse_json("items")), "_items", "bed", "_bed").where(F.col("bed").isin(dims.BEDS) & snapshots.is_object(F.col("_bed")))
    found = snapshots.members(beds, "_bed", "vital", "_box").where(F.col("vital").isin(dims.VITAL_NAMES) & snapshots.is_object(F.col("_box")))
    read = found.withColumns({s: _whole(F.col("_box"), s) for s in SIDES})
    return read.where("w > 0 and h > 0 and x is not null and y is not null").drop("items", "_items", "_bed", "_box")


def equal_split(width: Column, height: Column, header: int = 0, columns: int = COLUMNS) -> Column:
    """The cells of a frame without a map: an array of ``bed, vital, x1, y1, x2, y2``, as ``geometry.grid`` has them."""
    rows = -(-len(dims.BEDS) // columns)
    w, h = F.floor(width / columns), F.floor((height - header) / rows)
    cw, ch = F.floor(w / CELL_COLUMNS), F.floor(h / CELL_ROWS)
    cells = F.array(*[F.struct(F.lit(b).alias("bed"), F.lit(v).alias("vital"), F.lit(i).alias("b"), F.lit(j).alias("v")) for i, b in enumerate(dims.BEDS) for j, v in enumerate(dims.VITAL_NAMES)])  # 6 x 20 fixed cells

    def cell(e: Column) -> Column:
        x = (e["b"] % columns) * w + (e["v"] % CELL_COLUMNS) * cw
        y = F.floor(e["b"] / columns) * h + header + F.floor(e["v"] / CELL_COLUMNS) * ch
        return F.struct(e["bed"].alias("bed"), e["vital"].alias("vital"), x.alias("x1"), y.alias("y1"), (x + cw).alias("x2"), (y + ch).alias("y2"))

    return F.transform(cells, cell)


def on_frame(rows: DataFrame, part: Slice = Slice(), left: str = "left", top: str = "top", width: str = "width", height: str = "height") -> DataFrame:
    """``x1, y1, x2, y2`` (the box within the frame) and ``rx1, ry1, rx2, ry2`` (where the value is read) of rows with a box ``x, y, w, h`` on the screen.

    Boxes that lie outside the frame are dropped. Where ``roi_type`` says that boxes are the values' own, they are
    read as they are, else in a part of them; some vitals are read wider.
    """
    c, one = F.col, F.lit(1)
    x, y, fw, fh = c("x") - c(left), c("y") - c(top), c(width), c(height)
    inside = rows.withColumns({"_x": x, "_y": y}).where((c("_x") + c("w") > 0) & (c("_y") + c("h") > 0) & (c("_x") < fw) & (c("_y") < fh))
    inside = inside.withColumns({"x1": _between(c("_x"), F.lit(0), fw - 1), "y1": _between(c("_y"), F.lit(0), fh - 1), "x2": F.least(c("_x") + c("w"), fw), "y2": F.least(c("_y") + c("h"), fh)})
    sx1, sx2, sy1, sy2 = part.spans()
    bw, bh = c("x2") - c("x1"), c("y2") - c("y1")
    cut = lambda from_, size, share: from_ + F.floor(size * F.lit(share))
    own = c("roi_type") == VALUE_BOXES
    inside = inside.withColumns({"_a": _between(cut(c("x1"), bw, sx1), c("x1"), c("x2") - 1), "_b": _between(cut(c("y1"), bh, sy1), c("y1"), c("y2") - 1)})
    inside = inside.withColumns({"_c": _between(cut(c("x1"), bw, sx2), c("_a") + 1, c("x2")), "_d": _between(cut(c("y1"), bh, sy2), c("_b") + 1, c("y2"))})
    whole, sliced = ("x1", "y1", "x2", "y2"), ("_a", "_b", "_c", "_d")
    inside = inside.withColumns({r: F.when(own, c(w)).otherwise(c(s)) for r, w, s in zip(("rx1", "ry1", "rx2", "ry2"), whole, sliced, strict=True)})
    more = F.greatest(one, F.bround((c("rx2") - c("rx1")) * F.lit(WIDER), 0).cast("long"))
    inside = inside.withColumn("rx2", F.when(c("vital").isin(WIDENED), _between(c("rx2") + more, c("rx1") + 1, fw)).otherwise(c("rx2")))
    return inside.drop("_x", "_y", *sliced)


def cells(frames: DataFrame, stood: DataFrame, keys: Sequence[str], at: str, part: Slice = Slice(), header: int = 0) -> DataFrame:
    """A row for each frame and value on it: ``frames``' columns, ``source``, ``bed``, ``vital``, the box in the frame and where the value is read.

    ``frames`` has ``keys`` (its screen), a time, and the captured rectangle ``left, top, width, height``. The map that
    stood at its time is laid on it (``source`` is exported; a map without boxes gives none), else the equal split (split).
    A frame without an extent has no cells. Frames look a map up by one ordered pass; the boxes of maps then
    join frames by screen and time of the map. Columns of frames other than these must differ in name from what is added.
    """
    keys, own = list(keys), frames.columns
    frames = frames.where((F.col("width") > 0) & (F.col("height") > 0))
    found = asof.asof(frames, stood.select(*keys, F.col("valid_from").alias("_since")), at, "_since", keys)
    laid = boxes(stood.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("valid_from").alias("_from"), "roi_type", "items"))
    same = F.col("_since") == F.col("_from")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    with_map = found.join(laid, same).select(*own, "roi_type", "bed", "vital", *SIDES)
    exported = on_frame(with_map, part).withColumn("source", F.lit("exported"))
    split = found.where(F.col("_since").isNull()).select(*own, F.explode(equal_split(F.col("width"), F.col("height"), header)).alias("_c")).select(*own, "_c.*").where("x2 > x1 and y2 > y1")
    split = split.withColumns({f"r{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")} | {"source": F.lit("split")})
    columns = [*own, "source", "bed", "vital", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2", "rx1", "ry1", "rx2", "ry2")]]
    return exported.select(*columns).unionByName(split.select(*columns))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], tile: int = 128) -> DataFrame:
    """Pairs of boxes of equal ``keys`` that share some area: columns of both (those of ``right`` but keys must differ in name) and ``area``.

    ``left`` has ``x1, y1, x2, y2`` (right and lower side excluded), ``right`` ``u1, v1, u2, v2``. An equi-join on the
    tiles of the screen that boxes reach into; a pair is made in one tile only, that of the corner where its
    overlap begins. Boxes with a null or no area meet nothing. A box stands in as many tiles as it covers.
    """

    def tiled(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
        reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile)))
        return df.where((F.col(x2) > F.col(x1)) & (F.col(y2) > F.col(y1))).withColumn("_tx", reach(x1, x2)).withColumn("_ty", reach(y1, y2))

    pairs = tiled(left, "x1", "y1", "x2", "y2").join(tiled(right, "u1", "v1", "u2", "v2"), [*keys, "_tx", "_ty"])
    x, y = F.greatest("x1", "u1"), F.greatest("y1", "v1")
    area = (F.least("x2", "u2") - x) * (F.least("y2", "v2") - y)
    meet = (F.least("x2", "u2") > x) & (F.least("y2", "v2") > y) & (F.floor(x / tile) == F.col("_tx")) & (F.floor(y / tile) == F.col("_ty"))
    return pairs.where(meet).withColumn("area", area.cast("long")).drop("_tx", "_ty")
