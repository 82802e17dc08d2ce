"""Deeply nested records as related flat tables.

One pass over the records: a depth-first visitor, compiled from the schema
into higher-order functions, emits for the record and every array member a row
with the tag of its table, its own key, its parent's key and its payload.  The
rows are written partitioned by tag; each table's schema is applied when it is
read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WITH_NULLS = {"ignoreNullFields": "false"}


def array_paths(kind: T.DataType, path: str = "") -> list[str]:
    """Paths of all arrays of a schema, depth first; ``.element`` leads into an array of arrays."""
    if isinstance(kind, T.ArrayType):
        return [path, *array_paths(kind.elementType, f"{path}.element" if isinstance(kind.elementType, T.ArrayType) else path)]
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in array_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return []


def _without(value: Column, kind: T.DataType, path: str, tags: Mapping[str, str]) -> Column | None:
    """``value`` without the arrays that are tables of their own; all else stays, also arrays without a tag."""
    if path in tags:
        return None
    if isinstance(kind, T.StructType) and any(p.startswith(path + ".") for p in tags):
        parts = [(f.name, _without(value.getField(f.name), f.dataType, f"{path}.{f.name}", tags)) for f in kind.fields]
        kept = [part.alias(name) for name, part in parts if part is not None]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    return value


def _payload(fields: list[tuple[str, Column, T.DataType, str]], tags: Mapping[str, str]) -> Column:
    parts = [(name, _without(value, kind, path, tags)) for name, value, kind, path in fields]
    kept = [part.alias(name) for name, part in parts if part is not None]
    return F.to_json(F.struct(*kept), _WITH_NULLS) if kept else F.lit("{}")


def _member_payload(member: Column, kind: T.DataType, path: str, tags: Mapping[str, str]) -> Column:
    if isinstance(kind, T.StructType):
        return _payload([(f.name, member.getField(f.name), f.dataType, f"{path}.{f.name}") for f in kind.fields], tags)
    if f"{path}.element" in tags:
        return F.lit("{}")
    return F.to_json(F.struct(member.alias("value")), _WITH_NULLS)


def _leads_to_tag(path: str, tags: Mapping[str, str]) -> bool:
    return any(p == path or p.startswith(path + ".") for p in tags)


def _children(owner: Column | None, kind: T.StructType, path: str, tags: Mapping[str, str], parent: str, keys: list[Column], payload: bool) -> list[Column]:
    found = []
    for field in kind.fields:
        here = f"{path}.{field.name}" if path else field.name
        if not _leads_to_tag(here, tags):
            continue
        value = F.col(f"`{field.name}`") if owner is None else owner.getField(field.name)
        if isinstance(field.dataType, T.ArrayType):
            found.append(_visit(value, field.dataType.elementType, here, tags, parent, keys, payload))
        elif isinstance(field.dataType, T.StructType):  # a struct is part of its owner's row; its arrays are not
            found += _children(value, field.dataType, here, tags, parent, keys, payload)
    return found


def _row(tag: str, parent: str | None, keys: list[Column], payload: Column | None) -> Column:
    places = F.array(*keys) if keys else F.array().cast("array<int>")
    cells = [F.lit(tag).alias("tag"), F.lit(parent).cast("string").alias("parent_tag"), places.alias("positions")]
    return F.array(F.struct(*cells, *([payload.alias("payload")] if payload is not None else [])))


def _visit(array: Column, kind: T.DataType, path: str, tags: Mapping[str, str], parent: str, keys: list[Column], payload: bool) -> Column:
    """Array of emitted rows for one array and everything below it; null arrays and null members emit nothing."""
    tag = tags.get(path)

    def visit(member: Column, i: Column) -> Column:
        own_keys = [*keys, i.cast("int")]
        rows = []
        if tag is not None:
            rows.append(_row(tag, parent, own_keys, _member_payload(member, kind, path, tags) if payload else None))
        if isinstance(kind, T.StructType):
            rows += _children(member, kind, path, tags, tag or parent, own_keys, payload)
        elif isinstance(kind, T.ArrayType) and _leads_to_tag(f"{path}.element", tags):  # one more level of positions
            rows.append(_visit(member, kind.elementType, f"{path}.element", tags, tag or parent, own_keys, payload))
        emitted = F.concat(*rows) if len(rows) > 1 else rows[0]
        return F.when(member.isNotNull(), emitted)

    # flatten() of an array with a null gives null: members that emit nothing are dropped first
    return F.coalesce(F.flatten(F.filter(F.transform(array, visit), lambda x: x.isNotNull())), _nothing(payload))


def _nothing(payload: bool) -> Column:
    kind = "array<struct<tag:string,parent_tag:string,positions:array<int>" + (",payload:string>>" if payload else ">>")
    return F.array().cast(kind)


def emit_tagged(df: DataFrame, root_key: str, tags: Mapping[str, str], payload: bool = True, root_tag: str | None = None) -> DataFrame:
    """(tag, root_id, positions, parent_tag, payload) for every non-null member of the named arrays.

    ``tags`` maps the path of an array, such as ``senses.glosses``, to the name
    of its table; ``array_paths`` lists the paths of a schema.  Arrays within
    structs are reached through the struct's path; a path that names no array
    is an error.  A member's key is (root_id, positions): its 0-based places
    in the arrays above it, null members counted; its parent's key is the same
    without the last place.  With ``root_tag`` each record emits a row of its
    own as well, without positions and parent.  ``payload`` is the JSON of the
    member or record but for the arrays that have a table, nulls written, so
    nothing of a record is lost; a member that is no struct is
    ``{"value": ...}``.

    Null and empty arrays and null members emit nothing; an empty string is a
    member; records that come twice emit twice (see ``distinct_records``);
    columns that neither hold a named array nor go into a root row are not
    read.  It is one scan, one explode, no shuffle, and the widest row is that
    of one record.
    """
    known = array_paths(df.schema)
    if wrong := sorted(set(tags) - set(known)):
        raise ValueError(f"no arrays: {', '.join(wrong)}; there are {', '.join(known) or 'none'}")
    top = root_tag or "root"
    lists = _children(None, df.schema, "", tags, top, [], payload)
    if root_tag is not None:
        fields = [(f.name, F.col(f"`{f.name}`"), f.dataType, f.name) for f in df.schema.fields]
        lists.insert(0, _row(root_tag, None, [], _payload(fields, tags) if payload else None))
    every = F.concat(*lists) if len(lists) > 1 else lists[0]
    rows = df.select(F.col(root_key).alias("root_id"), F.explode(every).alias("_row"))
    return rows.select("_row.tag", "root_id", "_row.positions", "_row.parent_tag", *(["_row.payload"] if payload else []))


def distinct_records(df: DataFrame, root_key: str, columns: list[str]) -> DataFrame:
    """Records delivered twice (equal in key and ``columns``), once each: one shuffle of the records, not of their members."""
    return df.select(root_key, *columns).dropDuplicates()


def once(tagged: DataFrame) -> DataFrame:
    """Members of records delivered twice, once each (rows equal in every column)."""
    return tagged.dropDuplicates()


def write_tables(tagged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write all tables at once, partitioned by tag.

    There are as many tags as tables, a few, so a task keeps a file open for
    each of them in place of sorting its rows by tag.
    """
    conf = tagged.sparkSession.conf
    ours = {"spark.sql.maxConcurrentOutputFileWriters": "64", "spark.sql.optimizer.plannedWrite.enabled": "false"}
    before = {k: conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            conf.set(k, v)
        tagged.write.mode(mode).partitionBy("tag").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def as_table(tagged: DataFrame, tag: str, schema: str | T.StructType, depth: int) -> DataFrame:
    """One table with its schema: root_id, pos_1 .. pos_depth, and the payload's columns prefixed with ``v_``."""
    parsed = tagged.where(F.col("tag") == tag).select(
        "root_id", *[F.get("positions", i).alias(f"pos_{i + 1}") for i in range(depth)], F.from_json("payload", schema).alias("_p")
    )
    names = [f.name for f in parsed.schema["_p"].dataType.fields]
    return parsed.select("root_id", *[f"pos_{i + 1}" for i in range(depth)], *[F.col("_p")[n].alias(f"v_{n}") for n in names])


def read_table(spark: SparkSession, path: str, tag: str, schema: str | T.StructType, depth: int) -> DataFrame:
    """A table written by ``write_tables``; only its partition is read."""
    return as_table(spark.read.parquet(path), tag, schema, depth)
