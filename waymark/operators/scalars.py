"""Computed columns over whole tables, and what is left of small joins."""

from waymark.functions.sql import haversine, haversine_atan2, planar_m, tile_x, tile_y, whole
from waymark.operators import define

fn_haversine = define(
    "fn_haversine", "Whole metres between each entity's two positions by both earth models, and flat for near ones.",
    f"""SELECT id, {whole(haversine_atan2("lat", "lon", "wlat", "wlon"))} AS metres_a, {whole(haversine("lat", "lon", "wlat", "wlon"))} AS metres_b, {whole(planar_m("lat", "lon", "lat + 1e-2", "lon + 1e-2"))} AS flat FROM {{entities}}""",
)

fn_cell_cover = define(
    "fn_cell_cover", "Cells of each entity's line, over the date line where that is shorter.",
    f"""SELECT id, CAST(x % 256 AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT id, x, UNNEST(SEQ(y1, y2)) AS y FROM (SELECT id, y1, y2, UNNEST(SEQ(x1, CASE WHEN x2 < x1 THEN x2 + 256 ELSE x2 END)) AS x FROM (
        SELECT id, {tile_x("wlon")} AS x1, {tile_x("CASE WHEN wlon + 2e0 >= 180e0 THEN wlon - 358e0 ELSE wlon + 2e0 END")} AS x2, {tile_y("wlat + 1e0")} AS y1, {tile_y("wlat")} AS y2 FROM {{entities}}) c) d) e""",
)

