"""What the names of ground-truth files say: R12_C..., T3R_WO...: room or transition space, ramp, class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prefixes of the second part and their classes, WO before W
CLASSES = (("C", 0), ("F", 3), ("WO", 5), ("W", 4), ("IO", 2))
# fixed values: prefixes of benchmark files and the class of each
BENCHMARK_CLASSES = (("NC", 6), ("NF", 7), ("OC", 8), ("C", 0), ("F", 3), ("W", 4))


def is_ground_truth(name: Column) -> Column:
    return name.startswith("R") | name.startswith("T")


def room_id(name: Column) -> Column:
    """The number in the first part, negative for transition spaces; null without one."""
    digits = F.regexp_extract(F.split(name, "_")[0], r"(\d+)", 1)
    n = F.when(digits != "", digits.cast("int"))
    return F.when(name.startswith("T"), -n).otherwise(n)


def class_value(name: Column, table: tuple[tuple[str, int], ...] = CLASSES, part: int = 1) -> Column:
    """The class whose prefix the second part has; null for none."""
    text = F.get(F.split(name, "_"), F.lit(part))
    out = F.lit(None).cast("int")
    for prefix, value in reversed(table):
        out = F.when(text.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def is_ramp(name: Column) -> Column:
    return F.split(name, "_")[0].endswith("R")
