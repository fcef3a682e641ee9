"""The registry of layer meanings: Spark type, undefined value and the kernel that makes a coarser value of four."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, LONG_MIN = -(2**31), -(2**63)


@dataclass(frozen=True)
class Semantic:
    name: str
    description: str
    kind: str  # float, double, int, long, or vector: components
    components: tuple[str, ...] = ()
    element: str = ""
    normalised: bool = False
    sentinel: object = None  # value that never overwrites another; None: the layer has none

    @property
    def id(self) -> str:
        """A stable identifier of the meaning, for stored metadata."""
        return str(uuid.uuid5(uuid.NAMESPACE_URL, "gridweft:" + self.name))

    @property
    def type(self) -> T.DataType:
        one = {"float": T.FloatType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "byte": T.ShortType(), "boolean": T.BooleanType()}
        if not self.components:
            return one[self.kind]
        return T.StructType([T.StructField(c, one[self.element]) for c in self.components])

    def undefined(self, c: Column) -> Column:
        """Whether a value counts as not there in merges. Nulls always do; NaN scalars never do."""
        if self.sentinel is None:
            return c.isNull()
        if self.sentinel == "nan":  # a vector all of whose components are NaN
            own = F.isnan(c.getField(self.components[0]))
            for f in self.components[1:]:
                own = own & F.isnan(c.getField(f))
        elif self.components:
            own = c.getField(self.components[0]) == self.sentinel
            for f in self.components[1:]:
                own = own & (c.getField(f) == self.sentinel)
        else:
            own = c == F.lit(self.sentinel)
        return c.isNull() | F.coalesce(own, F.lit(False))

    def coarser(self, a: Column, b: Column, c: Column, d: Column) -> Column:
        """The value of a cell from its quadrants in order 0 to 3; added in this order."""
        if not self.components:
            return self._mean(self.kind, a, b, c, d)
        parts = [self._mean(self.element, *(q.getField(f) for q in (a, b, c, d))) for f in self.components]
        if self.normalised:
            length = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
            parts = [(p / length).cast(self.element) for p in parts]
        return F.struct(*[p.alias(f) for p, f in zip(parts, self.components)])

    @staticmethod
    def _mean(kind: str, a: Column, b: Column, c: Column, d: Column) -> Column:
        if kind == "float":
            return ((a + b + c + d) * F.lit(0.25).cast("float")).cast("float")
        if kind == "double":
            return (a + b + c + d) * F.lit(0.25)
        # integers wrap and truncate towards zero
        wide = {"byte": "int", "int": "int", "long": "long"}[kind]
        total = a.cast("decimal(38,0)") + b.cast("decimal(38,0)") + c.cast("decimal(38,0)") + d.cast("decimal(38,0)")
        if wide == "int":
            total = total.cast("long")
            wrapped = F.pmod(total + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
        else:
            span = F.lit("18446744073709551616").cast("decimal(38,0)")
            half = F.lit("9223372036854775808").cast("decimal(38,0)")
            wrapped = (F.pmod(total + half, span) - half).cast("long")
        truncated = F.when(wrapped < 0, -F.floor(-(wrapped / 4))).otherwise(F.floor(wrapped / 4)) if wide == "int" else F.call_function("div", wrapped, F.lit(4).cast("long"))
        return truncated.cast({"byte": "short", "int": "int", "long": "long"}[kind])


def _v(n: str, text: str, element: str, parts: str, sentinel: object, normalised: bool = False) -> Semantic:
    return Semantic(n, text, "vector", tuple(parts), element, normalised, sentinel)


_ALL = [
    Semantic("heights1f", "height of a sample", "float"),
    Semantic("heights1d", "height of a sample", "double"),
    _v("heights_bilinear4f", "height as bilinear parameters", "float", "abcd", "nan"),
    _v("heights_bilinear4d", "height as bilinear parameters", "double", "abcd", "nan"),
    _v("normals3f", "normal vector", "float", "xyz", "nan", True),
    _v("normals3d", "normal vector", "double", "xyz", "nan", True),
    Semantic("height_std_devs1f", "standard deviation of a height", "float"),
    Semantic("height_std_devs1d", "standard deviation of a height", "double"),
    _v("colors3b", "colour, 0 to 255", "byte", "rgb", 0),
    _v("colors4b", "colour, 0 to 255", "byte", "rgba", 0),
    _v("colors3f", "colour", "float", "rgb", 0.0),
    _v("colors4f", "colour", "float", "rgba", 0.0),
    Semantic("intensities1i", "intensity", "int", sentinel=INT_MIN),
    Semantic("intensities1l", "intensity", "long", sentinel=LONG_MIN),
    Semantic("intensities1f", "intensity", "float"),
    Semantic("intensities1d", "intensity", "double"),
    Semantic("volumes1f", "difference of heights", "float"),
    Semantic("volumes1d", "difference of heights", "double"),
    _v("volumes_bilinear4f", "difference of heights as bilinear parameters", "float", "abcd", "nan"),
    _v("volumes_bilinear4d", "difference of heights as bilinear parameters", "double", "abcd", "nan"),
    _v("bilinear_params4f", "old name of heights_bilinear4f", "float", "abcd", "nan"),
    _v("bilinear_params4d", "old name of heights_bilinear4d", "double", "abcd", "nan"),
    Semantic("mask1b", "whether a sample is defined", "boolean"),
]
REGISTRY: dict[str, Semantic] = {s.name: s for s in _ALL}


def register(semantic: Semantic) -> Semantic:
    """Add a layer meaning; an existing name must stay what it is."""
    if REGISTRY.get(semantic.name, semantic) != semantic:
        raise ValueError(f"{semantic.name} is registered with another meaning")
    REGISTRY[semantic.name] = semantic
    return semantic


def semantic(name: str, type_: T.DataType | None = None) -> Semantic:
    """The registered meaning of a layer; columns of other names get a plain one by their Spark type."""
    if name in REGISTRY:
        return REGISTRY[name]
    kinds = {T.FloatType: "float", T.DoubleType: "double", T.IntegerType: "int", T.LongType: "long", T.BooleanType: "boolean"}
    if isinstance(type_, T.StructType):
        element = kinds.get(type(type_.fields[0].dataType), "double")
        return Semantic(name, "", "vector", tuple(f.name for f in type_.fields), element, sentinel="nan" if element in ("float", "double") else 0)
    if type(type_) in kinds:
        return Semantic(name, "", kinds[type(type_)])
    raise ValueError(f"no layer meaning for {name}")


def bilinear(v: Column, dx: Column, dy: Column) -> Column:
    """A + B x + C y + D x y at an offset from the cell's centre."""
    return v.getField("a") + v.getField("b") * dx + v.getField("c") * dy + v.getField("d") * dx * dy
