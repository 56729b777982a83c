"""Column names of the tables, and checks of them at plan time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.vec3 import Vec3, vec

MEAN, QUAT, SCALE, NORMAL = ("mx", "my", "mz"), ("qw", "qx", "qy", "qz"), ("sx", "sy", "sz"), ("nx", "ny", "nz")
BOX = (("gx0", "gy0", "gz0"), ("gx1", "gy1", "gz1"))
CONTACT = (("p0x", "p0y", "p0z"), ("p1x", "p1y", "p1z"), ("p2x", "p2y", "p2z"))
COVI = ("c0", "c1", "c2", "c3", "c4", "c5")
VOXEL = (("vx0", "vy0", "vz0"), ("vx1", "vy1", "vz1"))
EDGE = (("ax", "ay", "az"), ("bx", "by", "bz"))

_NUMBERS = {"double", "float", "int", "bigint", "smallint", "tinyint"}


def require(df: DataFrame, *names: str) -> None:
    """Raises ``ValueError`` if a column is missing or no number."""
    types = dict(df.dtypes)
    for n in names:
        if n not in types:
            raise ValueError(f"column {n} is missing; the table has {', '.join(df.columns)}")
        if types[n] not in _NUMBERS and not types[n].startswith("decimal"):
            raise ValueError(f"column {n} must be a number, not {types[n]}")


def iso_of(iso: float | str | Column) -> Column:
    """A level of the iso surface: one for all, or a column's."""
    if isinstance(iso, str):
        return F.col(iso).cast("double")
    return iso if isinstance(iso, Column) else F.lit(float(iso))


def box(names: tuple[tuple[str, str, str], tuple[str, str, str]]) -> tuple[Vec3, Vec3]:
    return vec(*names[0]), vec(*names[1])


def covi() -> tuple[Column, ...]:
    return tuple(F.col(c).cast("double") for c in COVI)
