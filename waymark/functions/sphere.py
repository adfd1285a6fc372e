"""Great-circle distance from points to line segments, as expressions that Spark and DuckDB share.

Points and segment ends are unit vectors (px, py, pz), (ax, ay, az), (ex, ey, ez). The foot of the perpendicular on the great
circle of a segment is its nearest point if it lies between the ends; else the nearer end is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mean Earth radius in metres, and degrees to radians.
RADIUS = 6371008.8
RAD = "0.017453292519943295e0"


def unit(lon: str, lat: str, prefix: str) -> dict[str, str]:
    """Unit vector columns of lon/lat columns in degrees."""
    return {
        f"{prefix}x": f"cos({lat}*{RAD})*cos({lon}*{RAD})",
        f"{prefix}y": f"cos({lat}*{RAD})*sin({lon}*{RAD})",
        f"{prefix}z": f"sin({lat}*{RAD})",
    }


_CROSS = "({a}y*{b}z-{a}z*{b}y)*nx+({a}z*{b}x-{a}x*{b}z)*ny+({a}x*{b}y-{a}y*{b}x)*nz"
#: Steps of the distance; each uses columns of the steps before it.
STEPS: list[dict[str, str]] = [
    {"nx": "ay*ez-az*ey", "ny": "az*ex-ax*ez", "nz": "ax*ey-ay*ex"},
    {"nn": "nx*nx+ny*ny+nz*nz", "pn": "px*nx+py*ny+pz*nz"},
    {"cx": "px*nn-nx*pn", "cy": "py*nn-ny*pn", "cz": "pz*nn-nz*pn"},
    {
        "inside": f"nn>0 and ({_CROSS.format(a='a', b='c')})>=0 and ({_CROSS.format(a='c', b='e')})>=0",
        "da": "(px-ax)*(px-ax)+(py-ay)*(py-ay)+(pz-az)*(pz-az)",
        "de": "(px-ex)*(px-ex)+(py-ey)*(py-ey)+(pz-ez)*(pz-ez)",
    },
    {"distance_m": f"case when inside then {RADIUS}e0*asin(least(1e0,abs(pn)/sqrt(nn))) else 2e0*{RADIUS}e0*asin(least(1e0,sqrt(least(da,de))/2e0)) end"},
]
#: The point on the segment, as longitude and latitude in degrees.
CLOSEST: list[dict[str, str]] = [
    {
        "qx": "case when inside then cx/sqrt(cx*cx+cy*cy+cz*cz) when da<=de then ax else ex end",
        "qy": "case when inside then cy/sqrt(cx*cx+cy*cy+cz*cz) when da<=de then ay else ey end",
        "qz": "case when inside then cz/sqrt(cx*cx+cy*cy+cz*cz) when da<=de then az else ez end",
    },
    {"near_lon": f"atan2(qy,qx)/{RAD}", "near_lat": f"asin(greatest(-1e0,least(1e0,qz)))/{RAD}"},
]


def with_steps(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: F.expr(e) for name, e in step.items()})
    return df


def steps_sql(source: str, steps: list[dict[str, str]]) -> str:
    """The same steps as nested selects."""
    for step in steps:
        source = f"(select *, {', '.join(f'{e} as {n}' for n, e in step.items())} from {source})"
    return source


LOCATION_UNIT = unit("lon", "lat", "p")
SEGMENT_UNIT = unit("x1", "y1", "a") | unit("x2", "y2", "e")


def unit_sql(source: str, columns: dict[str, str]) -> str:
    return f"(select *, {', '.join(f'{e} as {n}' for n, e in columns.items())} from {source})"
