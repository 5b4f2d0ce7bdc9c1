"""Boxes and regions of page images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_to_polygon(box: Column) -> Column:
    """x0, y0, x1, y1 as four corner points; null if it has other than four numbers."""
    x0, y0, x1, y1 = (F.get(box, k).cast("int") for k in range(4))
    return F.when(F.size(box) == 4, F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]))


def xywh_to_polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    return flat_to_polygon(F.array(x, y, x + w, y + h))


def region_kind(w: Column, h: Column) -> Column:
    """Near squares are stamps, the rest signatures."""
    return F.when(F.abs(w - h) < F.greatest(w, h) * 0.45, F.lit("stamp")).otherwise(F.lit("signature"))


def usable_region(area: Column, image_area: Column) -> Column:
    return (area >= 700) & (area <= image_area * 0.25)


def any_kind(regions: Column, kind: str) -> Column:
    """Null without regions."""
    return F.when(F.size(regions) > 0, F.exists(regions, lambda r: r["kind"] == kind))


def confidence_mean(confidences: Column, digits: int | None = 4) -> Column:
    """Mean of what isn't null; null if nothing is."""
    known = F.filter(confidences, lambda c: c.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known))
    return mean if digits is None else F.round(mean, digits)


#: Areas of an image that are looked at, before small and large ones are left out.
AREAS = 20


def regions(contours: Column, image_area: Column) -> Column:
    """place (from 1, among the first AREAS), kind and box (x0, y0, x1, y1) of the contours (x, y, w, h) of a usable size."""
    placed = F.transform(F.slice(contours, 1, AREAS), lambda c, i: F.struct((i + 1).alias("place"), c.alias("c")))
    usable = F.filter(placed, lambda p: usable_region((p["c"]["w"] * p["c"]["h"]).cast("double"), image_area))
    corners = lambda c: F.array(c["x"], c["y"], c["x"] + c["w"], c["y"] + c["h"])
    return F.transform(usable, lambda p: F.struct(p["place"].alias("place"), region_kind(p["c"]["w"], p["c"]["h"]).alias("kind"), corners(p["c"]).alias("box")))


def polygon(box: Column) -> Column:
    """Corner points of a box (VARIANT): four numbers, a list of points, or an object that has either under box or bbox; null for anything else."""
    inner = F.coalesce(*[F.try_variant_get(box, f"$.{k}", "variant") for k in ("box", "bbox")])
    v = F.when(F.schema_of_variant(box).startswith("OBJECT"), inner).otherwise(box)
    points = F.try_variant_get(v, "$", "array<array<double>>")
    whole = F.forall(points, lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
    listed = F.transform(points, lambda p: F.struct(F.get(p, 0).cast("int").alias("x"), F.get(p, 1).cast("int").alias("y")))
    return F.coalesce(flat_to_polygon(F.try_variant_get(v, "$", "array<double>")), F.when(whole, listed))


def text_of_boxes(boxes: Column) -> Column:
    """The boxes' texts, a line each."""
    return F.array_join(F.transform(boxes, lambda b: b["text"]), "\n")
