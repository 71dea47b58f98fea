"""Keys of JSON texts of unknown schema in one pass, with the values that come first."""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of an example, and paths that a task holds before it passes on what it has.
LONGEST = 180
HELD = 50_000

FOUND = "path string, type string, n long, at long, place long, text string"


def walk(value, elements: int | None):
    """(path, key, value) below a parsed value, in the order of the text; lists are entered at ``[]``, of which at most ``elements``."""
    todo = [("", None, value)]
    while todo:
        path, key, own = todo.pop()
        if path:
            yield path, key, own
        if isinstance(own, dict):
            todo += [(f"{path}.{k}" if path else k, k, v) for k, v in reversed(own.items())]
        elif isinstance(own, list):
            todo += [(f"{path}[]", None, v) for v in reversed(own[:elements])]


class Firsts:
    """Counts by path and type, and of each path the ``most`` examples with the least place, whatever the order they come in."""

    def __init__(self, most: int, distinct: bool):
        self.most, self.distinct = most, distinct
        self.counts: Counter = Counter()
        self.examples: dict[str, dict] = {}

    def add(self, path: str, value, place: tuple[int, int]) -> None:
        self.counts[path, type(value).__name__] += 1
        if isinstance(value, (dict, list)):
            return
        held = self.examples.setdefault(path, {})
        text = repr(value)[:LONGEST]
        key = text if self.distinct else (text, place)
        held[key] = min(held.get(key, place), place)
        if len(held) > 4 * self.most:
            # One left out here has ``most`` others before it, unless it comes again at an earlier place.
            self.examples[path] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[: self.most])

    def rows(self) -> pa.RecordBatch:
        out = [(path, kind, n, None, None, None) for (path, kind), n in self.counts.items()]
        for path, held in self.examples.items():
            first = sorted(held.items(), key=lambda x: (x[1], x[0]))[: self.most]
            out += [(path, None, 0, *place, key if self.distinct else key[0]) for key, place in first]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["path", "type", "n", "at", "place", "text"])


def key_paths(documents: DataFrame, column: str, order: str | None = None, terms: list[str] | None = None, most: int = 3, elements: int | None = None, distinct: bool = True) -> DataFrame:
    """path, n, types and examples of the keys in JSON texts, whatever their schema; lists are entered at ``[]``.

    ``terms``: only keys that hold one of them in any case, else all, and the elements of lists. ``elements``: how many of a list are looked at (null: all). ``examples``: the ``most`` scalars
    that come first by the number in ``order`` (null last; without one, by their place in a text), then by place; each once, or
    with ``distinct=False`` as often as they come. Texts that are null or no JSON give nothing, an empty table no rows. Types
    and examples are told as Python tells them, in at most LONGEST characters. One pass; a task holds ``most`` examples a path.
    """
    wanted = [t.lower() for t in terms] if terms is not None else None

    def find(batches):
        found = Firsts(most, distinct)
        for batch in batches:
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                for place, (path, key, own) in enumerate(walk(value, elements)):
                    if wanted is None or (key is not None and any(t in key.lower() for t in wanted)):
                        found.add(path, own, (at, place))
            if len(found.counts) > HELD:
                yield found.rows()
                found = Firsts(most, distinct)
        yield found.rows()

    at = F.lit(0) if order is None else F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1))
    rows = documents.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("text"), at.cast("long").alias("at")).mapInArrow(find, FOUND)
    first = F.min(F.struct("at", "place"))
    one = rows.groupBy("path", "text", *([] if distinct else ["at", "place"])).agg(F.sum("n").alias("n"), F.collect_set("type").alias("types"), first.alias("first"))
    by_place = Window.partitionBy("path").orderBy(F.col("text").isNull(), "first", "text")
    near = F.when(F.col("text").isNotNull() & (F.row_number().over(by_place) <= most), F.struct("first", "text"))
    each = one.select("path", "n", "types", near.alias("example")).groupBy("path")
    examples = F.transform(F.array_sort(F.collect_list("example")), lambda x: x["text"])
    return each.agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), examples.alias("examples"))


def first_values(rows: DataFrame, fields: list[str], order: list[str], most: int = 20) -> DataFrame:
    """field, type and first_values: the first ``most`` different values of each field by ``order``, as text; nulls and empty texts don't count.

    Values are distinct before they are ordered, and only ``most`` of a field come together.
    """
    place = F.struct(*order)
    types = dict(rows.dtypes)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(types[f]).alias("type"), F.col(f).cast("string").alias("v")) for f in fields])
    long = rows.select(place.alias("at"), F.explode(cells).alias("x")).select("at", "x.*")
    one = long.groupBy("field", "type", F.nullif("v", F.lit("")).alias("v")).agg(F.min("at").alias("at"))
    by = Window.partitionBy("field", "type").orderBy(F.col("v").isNull(), "at", "v")
    near = one.withColumn("i", F.row_number().over(by)).where(F.col("i") <= most)
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("i", "v")))), lambda x: x["v"])
    return near.groupBy("field", "type").agg(values.alias("first_values"))
