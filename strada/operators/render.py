"""Maps as SVG rows, and overlays as coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strada.functions.segment import COORDS, described, displayed, scaled
from strada.functions.transform import perspective, similarity, similarity_inverse, transformed
from strada.operators.conditioning import bounds
from strada.operators.raster import drawn_pixels


def svg_line() -> Column:
    return F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f" />', *COORDS)


def svg_document(segs: DataFrame, width: int = 1, background=(0, 0, 0), stroke=(255, 255, 255), box: tuple | None = None) -> DataFrame:
    """(map_id, part, line): the lines of each map's document in order of part; a row a segment, so maps of any size can be written."""
    ends = bounds(segs)
    if box is not None:
        x, y = sorted((box[0], box[2])), sorted((box[1], box[3]))
        ends = ends.select("map_id", *[F.lit(float(v)).alias(n) for v, n in zip((x[0], y[0], x[1], y[1]), ("xmin", "ymin", "xmax", "ymax"))])
    w, h = F.round(F.col("xmax") - F.col("xmin")).cast("int"), F.round(F.col("ymax") - F.col("ymin")).cast("int")
    rgb = lambda c: "rgb({},{},{})".format(*c)
    head = F.format_string(f'<svg height="%d" width="%d"><rect width="%d" height="%d" style="fill:{rgb(background)}" /><g stroke-linecap="round" stroke-width="{width}" stroke="{rgb(stroke)}">', h, w, w, h)
    first = ends.select("map_id", F.lit(-1).cast("long").alias("part"), head.alias("line"))
    last = ends.select("map_id", F.lit(2**63 - 1).cast("long").alias("part"), F.lit("</g></svg>").alias("line"))
    return first.unionByName(segs.select("map_id", F.col("seg_id").cast("long").alias("part"), svg_line().alias("line"))).unionByName(last)


def drawn(segs: DataFrame, size: int, show: float = 0.01, describe: float = 0.04) -> DataFrame:
    """Normalised segments at `size` pixels: those drawn, with a mark on those long enough to be described."""
    marked = segs.withColumns({"is_displayed": displayed(show), "is_described": described(describe)}).where("is_displayed")
    return marked.select("map_id", "seg_id", *scaled(float(size)), "is_described")


def drawn_in_perspective(segs: DataFrame, size: int, angles: tuple[float, float, float], x_max: float, y_max: float, show: float = 0.01, describe: float = 0.04) -> DataFrame:
    """As `drawn`, seen from an angle; lengths are judged before, on the normalised map."""
    m, _ = perspective(y_max * size, x_max * size, size, angles)
    flat = segs.withColumns({"is_displayed": displayed(show), "is_described": described(describe)}).where("is_displayed").select("map_id", "seg_id", *scaled(float(size)), "is_described")
    return flat.select("map_id", "seg_id", *transformed(m), "is_described")


def truncated_ends(segs: DataFrame) -> DataFrame:
    """Pixel ends by cutting off, as the raw drawing routine does."""
    return segs.withColumns({c: F.col(c).cast("int") for c in COORDS})


def box_corners(models: DataFrame, width: float, height: float) -> DataFrame:
    """(ref_id, corner, x, y): the test map's corners on the reference, rounded half to even."""
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)))])
    each = models.withColumn("c", F.explode(corners))
    x, y = similarity(F.col("c.x"), F.col("c.y"), *[F.col(c) for c in ("tx", "ty", "s", "o")])
    return each.select("ref_id", F.col("c.corner").alias("corner"), F.rint(x).cast("long").alias("x"), F.rint(y).cast("long").alias("y"))


def map_image(segs: DataFrame, size: int, width: int, height: int, line_width: int = 2, show: float = 0.01) -> DataFrame:
    """(map_id, y, x): the lit pixels of a normalised map drawn at `size` pixels."""
    return drawn_pixels(drawn(segs, size, show), width, height, line_width, cut_off=True)


def perspective_image(segs: DataFrame, size: int, angles: tuple[float, float, float], x_max: float, y_max: float, width: int, height: int, line_width: int = 2, show: float = 0.01) -> DataFrame:
    """As `map_image`, seen from an angle."""
    return drawn_pixels(drawn_in_perspective(segs, size, angles, x_max, y_max, show), width, height, line_width, cut_off=True)


def match_picture(matches: DataFrame, ref_width: int, lines: bool = True, circles: bool = True) -> DataFrame:
    """(ref_id, qid, shape, x1, y1, x2, y2, radius): a line between the two keypoints of each match, the test map
    standing to the right of the reference, and a circle of its scale around either. Numbers are cut off."""
    whole = lambda c: F.col(c).cast("int")
    xt, none = whole("xt") + ref_width, F.lit(None).cast("int")
    shape = lambda name, *v: F.struct(F.lit(name).alias("shape"), *[x.alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2", "radius"))])
    shapes = [shape("line", whole("xr"), whole("yr"), xt, whole("yt"), none)] if lines else []
    if circles:
        shapes += [shape("ref", whole("xr"), whole("yr"), none, none, whole("sr")), shape("test", xt, whole("yt"), none, none, whole("st"))]
    if not shapes:
        raise ValueError("nothing to draw")
    return matches.withColumn("__s", F.explode(F.array(*shapes))).select("ref_id", "qid", "__s.*")


def overlay(segs: DataFrame, tx: float, ty: float, s: float, o: float) -> DataFrame:
    """Reference segments on the test image: ends through the inverse model, rounded half to even."""
    values = [F.lit(float(v)) for v in (tx, ty, s, o)]
    ends = []
    for n in "12":
        x, y = similarity_inverse(F.col("x" + n), F.col("y" + n), *values)
        ends += [F.rint(x).cast("long").alias("x" + n), F.rint(y).cast("long").alias("y" + n)]
    return segs.select("map_id", "seg_id", *ends)
