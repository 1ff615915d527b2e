"""Detector geometry as a small dimension table and column arithmetic on it."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTOR = "det int, name string, type string, role string, px double, py double, pz double, rx double, ry double, rz double, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, pad_rows int, pad_columns int, pad_pitch_x double, pad_pitch_y double, pad_size_x double, pad_size_y double, pad_plane int, radius double"
PLANE = "det int, plane int, angle_deg double, pitch double, n_strips int"


def rotation(rx: float, ry: float, rz: float) -> list[float]:
    """Row-major Rz * Ry * Rx."""
    cx, sx, cy, sy, cz, sz = math.cos(rx), math.sin(rx), math.cos(ry), math.sin(ry), math.cos(rz), math.sin(rz)
    return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]


def detector_row(d: dict[str, Any], shift: tuple[float, ...] = (0, 0, 0), turn: tuple[float, ...] = (0, 0, 0)) -> tuple:
    """A row of DETECTOR from configuration; shift and turn are alignment corrections added to the nominal values."""
    p = [a + b for a, b in zip(d.get("position", (0, 0, 0)), shift)]
    r = [a + b for a, b in zip(d.get("rotation", (0, 0, 0)), turn)]
    pads = d.get("pads") or {}
    if d.get("type") == "planar_pad":
        if min(pads.get("rows", 0), pads.get("columns", 0)) <= 0 or min(pads.get("pitchX", 0), pads.get("pitchY", 0)) <= 0:
            raise ValueError(f"detector {d['id']}: pads need positive rows, columns and pitches")
        for size, pitch in (("sizeX", "pitchX"), ("sizeY", "pitchY")):
            if not 0 < pads.get(size, pads[pitch]) <= pads[pitch]:
                raise ValueError(f"detector {d['id']}: {size} must lie between 0 and {pitch}")
    px, py = pads.get("pitchX"), pads.get("pitchY")
    as_float = lambda v: None if v is None else float(v)
    radius = float(d.get("radius", 65.0)) if d.get("type") == "cylinder" else None
    return (d["id"], d.get("name", str(d["id"])), d["type"], d.get("role", "tracker").lower(), *map(float, p), *map(float, r), *rotation(*r), pads.get("rows"), pads.get("columns"), as_float(px), as_float(py), as_float(pads.get("sizeX", px)), as_float(pads.get("sizeY", py)), pads.get("planeType"), radius)


def detectors(spark: SparkSession, config: list[dict[str, Any]], corrections: dict[int, tuple] | None = None) -> DataFrame:
    """The detector dimension; a repeated id or an unknown type is an error."""
    seen: set[int] = set()
    rows = []
    for d in config:
        if d["id"] in seen:
            raise ValueError(f"detector id {d['id']} is used twice")
        if d["type"] not in ("planar", "planar_pad", "cylinder"):
            raise ValueError(f"detector {d['id']}: unknown type {d['type']}")
        seen.add(d["id"])
        rows.append(detector_row(d, *(corrections or {}).get(d["id"], ())))
    return spark.createDataFrame(rows, DETECTOR)


def planes(spark: SparkSession, config: list[dict[str, Any]]) -> DataFrame:
    """The readout planes of strip detectors: by default plane 0 at 0 and plane 1 at 90 degrees, pitch 0.4, 256 strips."""
    rows = []
    for d in config:
        if d["type"] == "planar_pad":
            continue
        own = d.get("readoutPlanes") or {"0": {}, "1": {}}
        for key, p in own.items():
            rows.append((d["id"], int(key), float(p.get("angle", 90.0 * int(key))), float(p.get("pitch", 0.4)), int(p.get("num", 256))))
    return spark.createDataFrame(rows, PLANE)


def axis_planes(plane_dim: DataFrame, distinct: bool = False) -> DataFrame:
    """(det, plane_x, plane_y): the planes nearest to the x and y axes, the lowest number first on ties.

    distinct: leave out detectors whose two axes would be one plane.
    """
    phi = F.radians("angle_deg")
    # tiny differences of sin and cos at exact angles must not decide a tie
    near = lambda c: F.struct(F.round(F.abs(c), 12), "plane")
    out = plane_dim.groupBy("det").agg(F.min_by("plane", near(F.sin(phi))).alias("plane_x"), F.min_by("plane", near(F.cos(phi))).alias("plane_y"))
    return out.where("plane_x <> plane_y") if distinct else out


def to_global(x: Column, y: Column, z: Column) -> list[Column]:
    """Global coordinates of a local point, of columns of DETECTOR in scope."""
    c = F.col
    return [c(f"p{a}") + c(f"r{i}0") * x + c(f"r{i}1") * y + c(f"r{i}2") * z for i, a in enumerate("xyz")]


def to_local(x: Column, y: Column, z: Column) -> list[Column]:
    c = F.col
    dx, dy, dz = x - c("px"), y - c("py"), z - c("pz")
    return [c(f"r0{i}") * dx + c(f"r1{i}") * dy + c(f"r2{i}") * dz for i in range(3)]


def plane_crossing(df: DataFrame) -> DataFrame:
    """df (kx, ky, bx, by and detector columns) with pred_x, pred_y, pred_z: where the track meets the plane, in local coordinates.

    Rows without a crossing (along the plane, or backwards) are dropped. Each result holds the crossing's z once: filters on it
    are pushed through projections by substitution, and must stay small.
    """
    along, over = F.expr("kx * r02 + ky * r12 + r22"), F.expr("(px - bx) * r02 + (py - by) * r12 + pz * r22")
    df = df.withColumns({"__along": along, "__over": over}).where("abs(__along) >= 1e-12 AND __along * __over >= 0")
    df = df.withColumn("__z", F.col("__over") / F.col("__along"))
    pred = {f"pred_{a}": F.expr(f"__z * (kx * r0{i} + ky * r1{i} + r2{i}) + (bx - px) * r0{i} + (by - py) * r1{i} - pz * r2{i}") for i, a in enumerate("xyz")}
    return df.withColumns(pred).drop("__along", "__over", "__z")


def cylinder_crossing(df: DataFrame) -> DataFrame:
    """df with gx, gy, gz where the track meets a cylinder about the z axis: of two points the one nearest the detector's z.

    x and y stay in the detector's turned frame; alignment of the other angles does not enter.
    """
    df = df.withColumns({
        "__qx": F.expr("cos(rz) * (bx - px) + sin(rz) * (by - py)"), "__qy": F.expr("cos(rz) * (by - py) - sin(rz) * (bx - px)"),
        "__sx": F.expr("cos(rz) * kx + sin(rz) * ky"), "__sy": F.expr("cos(rz) * ky - sin(rz) * kx"),
    })
    df = df.withColumns({"__a": F.expr("__sx * __sx + __sy * __sy"), "__b": F.expr("2 * (__sx * __qx + __sy * __qy)"), "__k": F.expr("__qx * __qx + __qy * __qy - radius * radius")})
    df = df.withColumn("__root", F.expr("CASE WHEN __b * __b - 4 * __a * __k >= 0 THEN sqrt(__b * __b - 4 * __a * __k) END"))
    df = df.withColumns({"__z1": F.expr("CASE WHEN abs(__a) >= 1e-12 THEN (__root - __b) / (2 * __a) END"), "__z2": F.expr("CASE WHEN abs(__a) >= 1e-12 THEN (-__b - __root) / (2 * __a) END")})
    z = F.expr("CASE WHEN abs(__a) >= 1e-12 THEN (CASE WHEN abs(__z2 - pz) < abs(__z1 - pz) THEN __z2 ELSE __z1 END) WHEN abs(__b) > 1e-12 THEN -__k / __b END")
    df = df.withColumn("gz", z)
    df = df.withColumns({"gx": F.expr("px + __sx * gz + __qx"), "gy": F.expr("py + __sy * gz + __qy")})
    return df.drop("__qx", "__qy", "__sx", "__sy", "__a", "__b", "__k", "__root", "__z1", "__z2")


def predict(tracks: DataFrame, dets: DataFrame) -> DataFrame:
    """tracks x detectors with the predicted local point pred_x, pred_y, pred_z, where there is one. dets comes from a configuration, so it is small."""
    found = [(r["det"], r["type"]) for r in dets.select("det", "type").collect()]
    out = None
    for round_ in (False, True):
        ids = [d for d, t in found if (t == "cylinder") == round_]
        if not ids:
            continue
        both = tracks.withColumn("det", F.explode(F.array(*[F.lit(i) for i in ids]))).join(F.broadcast(dets), "det")
        if round_:
            both = cylinder_crossing(both)
            local = to_local(F.col("gx"), F.col("gy"), F.col("gz"))
            both = both.withColumns({f"pred_{a}": v for a, v in zip("xyz", local)}).drop("gx", "gy", "gz").where("pred_x IS NOT NULL")
        else:
            both = plane_crossing(both)
        out = both if out is None else out.unionByName(both)
    if out is None:
        raise ValueError("no detectors to predict for")
    return out


def active_area(x: Column, y: Column, plane_array: Column | None) -> Column:
    """Whether a local point lies in the active area: half-open in the pad rectangle, or in every strip plane's span.

    plane_array: array of (angle_deg, pitch, n_strips) of the detector's planes; None where all are pads.
    """
    pad = (x >= -F.col("pad_pitch_x") / 2) & (x < (F.col("pad_columns") - 0.5) * F.col("pad_pitch_x")) & (y >= -F.col("pad_pitch_y") / 2) & (y < (F.col("pad_rows") - 0.5) * F.col("pad_pitch_y"))

    def inside(p: Column) -> Column:
        u = x * F.cos(F.radians(p["angle_deg"])) + y * F.sin(F.radians(p["angle_deg"]))
        return (u >= -p["pitch"] / 2) & (u < (p["n_strips"] - 0.5) * p["pitch"])

    return pad if plane_array is None else F.when(F.col("type") == "planar_pad", pad).otherwise(F.forall(plane_array, inside))


def pad_position(row: Column, column: Column) -> tuple[Column, Column]:
    """Centre of a pad; outside the grid is an error."""
    ok = row.between(0, F.col("pad_rows") - 1) & column.between(0, F.col("pad_columns") - 1)
    fail = F.raise_error(F.lit("pad outside the grid")).cast("double")
    return F.when(ok, column * F.col("pad_pitch_x")).otherwise(fail), F.when(ok, row * F.col("pad_pitch_y")).otherwise(fail)


def in_pad(x: Column, y: Column) -> Column:
    """Whether a local point lies on a pad and not in the gap between two."""

    def on(v: Column, pitch: str, size: str, n: str) -> Column:
        at = v + F.col(pitch) / 2
        return (at >= 0) & (at < F.col(n) * F.col(pitch)) & (F.abs(F.pmod(at, F.col(pitch)) - F.col(pitch) / 2) <= F.col(size) / 2)

    return on(x, "pad_pitch_x", "pad_size_x", "pad_columns") & on(y, "pad_pitch_y", "pad_size_y", "pad_rows")
