"""Voxel states: arrays of (room_id, classes). The last room removed leaves null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "array<struct<room_id:int,classes:array<int>>>"


def _one(room: Column | int, classes: Column) -> Column:
    room = room if isinstance(room, Column) else F.lit(room)
    return F.struct(room.cast("int").alias("room_id"), classes.cast("array<int>").alias("classes"))


def _all(state: Column) -> Column:
    return F.coalesce(state, F.array().cast(STATE))


def _or_null(state: Column) -> Column:
    return F.when(F.size(state) > 0, state)


def create(room: Column | int, classes: Column) -> Column:
    return F.array(_one(room, classes))


def has_room(state: Column, room: Column | int) -> Column:
    return F.exists(_all(state), lambda x: x["room_id"] == room)


def has_other_rooms(state: Column, room: Column | int) -> Column:
    return F.exists(_all(state), lambda x: x["room_id"] != room)


def room_count(state: Column) -> Column:
    return F.size(_all(state))


def room_ids(state: Column) -> Column:
    return F.transform(_all(state), lambda x: x["room_id"])


def other_room_ids(state: Column, room: Column | int) -> Column:
    return F.filter(room_ids(state), lambda x: x != room)


def classes_of(state: Column, room: Column | int) -> Column:
    """Classes of one room, empty when it is absent."""
    found = F.get(F.filter(_all(state), lambda x: x["room_id"] == room), F.lit(0))
    return F.coalesce(found["classes"], F.array().cast("array<int>"))


def all_classes(state: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_all(state), lambda x: x["classes"])))


def add_classes(state: Column, room: Column | int, classes: Column) -> Column:
    """Classes added to a room, new ones before the old ones."""
    new = lambda x: F.array_union(F.array_except(classes, x["classes"]), x["classes"])
    return F.transform(_all(state), lambda x: F.when(x["room_id"] == room, _one(x["room_id"], new(x))).otherwise(_one(x["room_id"], x["classes"])))


def add_room(state: Column, room: Column | int, classes: Column) -> Column:
    """A room with classes added; if the room is there, the classes are added to it."""
    return F.when(has_room(state, room), add_classes(state, room, classes)).otherwise(F.concat(_all(state), create(room, classes)))


def remove_room(state: Column, room: Column | int) -> Column:
    return _or_null(F.filter(_all(state), lambda x: x["room_id"] != room))


def change_classes(state: Column, room: Column | int, classes: Column) -> Column:
    """Classes of a room replaced; the room moves to the end."""
    return F.concat(F.filter(_all(state), lambda x: x["room_id"] != room), create(room, classes))


def remove_class(state: Column, room: Column | int, value: int) -> Column:
    """One class removed from a room, and the room with its only class."""
    left = lambda x: F.array_remove(x["classes"], value)
    cut = F.transform(_all(state), lambda x: F.when(x["room_id"] == room, _one(x["room_id"], left(x))).otherwise(_one(x["room_id"], x["classes"])))
    return _or_null(F.filter(cut, lambda x: (x["room_id"] != room) | (F.size(x["classes"]) > 0)))


def merge_classes(classes: Column) -> Column:
    """Classes of several rooms as one room's: surfaces if any, else object, else empty interior."""
    surfaces = F.filter(classes, lambda x: x.isin(0, 3, 4))
    return F.when(F.size(surfaces) > 0, F.array_distinct(surfaces)).when(F.array_contains(classes, 2), F.array(F.lit(2))).otherwise(F.array(F.lit(1)))


def shown_class(classes: Column) -> Column:
    """One number for a set of classes, for display: FLOOR with CEILING first, down to none (-1)."""
    has = lambda k: F.array_contains(classes, k)
    # fixed values: order of precedence
    return (
        F.when(has(3) & has(0), 6).when(has(3) & has(4), 7).when(has(0) & has(4), 8)
        .when(has(4), 4).when(has(3), 3).when(has(0), 0).when(has(2), 2).when(has(5), 5).when(has(1), 1).otherwise(-1)
    )
