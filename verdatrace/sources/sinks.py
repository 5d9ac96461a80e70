"""Results to files: records as CSV, summaries as JSON, patches as vectors."""

from __future__ import annotations

import csv
import json
import sqlite3
from collections.abc import Iterable
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from verdatrace.model import Grid
from verdatrace.operators.spatial import outlines, perimeter


def write_records(frames: Iterable[DataFrame], path: str) -> None:
    """Tables with partly different columns as one CSV folder; columns in order of first appearance."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole.write.mode("overwrite").option("header", True).csv(path)


def write_csv(records: list[dict[str, Any]], path: str | Path) -> Path:
    """A few records as one CSV file; none give an empty file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    keys = list(dict.fromkeys(k for r in records for k in r))
    with path.open("w", newline="") as f:
        if keys:
            w = csv.DictWriter(f, keys)
            w.writeheader()
            w.writerows(records)
    return path


def write_json(value: Any, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, default=str))
    return path


def vectors(patches: DataFrame, patch_pixels: DataFrame, grid: Grid) -> DataFrame:
    """Patches with outline, perimeter and shape index, largest first."""
    return patches.join(outlines(patch_pixels, grid), "patch_id").join(perimeter(patch_pixels, grid), "patch_id").orderBy("area_ha", ascending=False)


def write_geopackage(rows: list[dict[str, Any]], path: str | Path, layer: str, srs: int) -> Path:
    """A few patches (with ``wkt``) as a GeoPackage with simple polygons, through SQLite alone."""
    import re
    import struct

    path = Path(path)
    path.unlink(missing_ok=True)
    db = sqlite3.connect(path)
    db.executescript(f"""
        PRAGMA application_id = 0x47504B47; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('EPSG:{srs}', {srs}, 'EPSG', {srs}, 'undefined', NULL), ('undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('undefined geographic', 0, 'NONE', 0, 'undefined', NULL);
        INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES ('{layer}', 'features', '{layer}', {srs});
        INSERT INTO gpkg_geometry_columns VALUES ('{layer}', 'geom', 'POLYGON', {srs}, 0, 0);
    """)
    columns = [k for k in (rows[0] if rows else {}) if k not in ("wkt", "fid")]
    db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB' + "".join(f', "{c}"' for c in columns) + ")")
    for r in rows:
        rings = [[tuple(map(float, p.split())) for p in ring.split(", ")] for ring in re.findall(r"\(([^()]+)\)", r["wkt"])]
        wkb = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(g)) + b"".join(struct.pack("<dd", *p) for p in g) for g in rings)
        blob = b"GP\x00\x01" + struct.pack("<i", srs) + wkb
        db.execute(f'INSERT INTO "{layer}" VALUES (NULL, ?' + ", ?" * len(columns) + ")", [blob, *(r[c] for c in columns)])
    db.commit()
    db.close()
    return path
