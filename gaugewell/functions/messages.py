"""JSON text to readings and back."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.schema import SENSORS, reading_schema

_STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def encode_reading(sensors: list[str] = SENSORS, status: bool = True) -> Column:
    """One JSON object per reading; NULL sensors are left out by ``to_json``."""
    fields = ["machine_id", *sensors] + (["machine_status"] if status else [])
    return F.to_json(F.struct(*fields))


def encode_batches(rows: DataFrame, sensors: list[str] = SENSORS, batch: str = "batch_id", seq: str = "seq") -> DataFrame:
    """One JSON array per batch, in order and without the machine state.

    A batch has a fixed small size (see ``assign_batches``), so the list is bounded.
    """
    item = F.struct(F.col(seq), F.struct("machine_id", *sensors).alias("reading"))
    return rows.groupBy(batch).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["reading"])).alias("body")
    )


def _filled(parsed: str, schema: T.StructType) -> list[Column]:
    """Absent and null numbers read as zero, as a decoder with zero values gives them."""

    def text(field: T.StructField) -> str:
        kind = field.dataType.simpleString()
        zero = f"CAST(0 AS {kind})" if isinstance(field.dataType, T.NumericType) else "NULL"
        return f"coalesce({parsed}.`{field.name}`, {zero}) AS `{field.name}`"

    return [F.expr(text(f)) for f in schema.fields]


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class _Strict:
    """How a text is read: its typed fields, and two names that no text can hold.

    A parser stops behind the first value of a text. So the text is put into a list
    before an end mark, ``{name: [text, {name: 1}]}``, and read as a whole: it is one
    value of the right form if the list has two members and the second one is the
    mark. Anything else in it, a wrong type included, fills column ``bad``.
    """

    schema: T.StructType
    name: str
    bad: str

    @classmethod
    def of(cls, schema: T.StructType) -> _Strict:
        return cls(schema, f"m{uuid.uuid4().hex}", f"b{uuid.uuid4().hex}")

    @property
    def options(self) -> dict[str, str]:
        return {"columnNameOfCorruptRecord": self.bad, **_STRICT}

    @property
    def item(self) -> T.StructType:
        own = [T.StructField(self.name, T.IntegerType()), T.StructField(self.bad, T.StringType())]
        return T.StructType([*self.schema.fields, *own])

    def parse(self, text: Column, listed: bool) -> Column:
        """``text`` and the end mark as a typed list; ``listed``: the text is a list of objects, not an object."""
        member = T.ArrayType(self.item) if listed else self.item
        whole = T.StructType([T.StructField(self.name, T.ArrayType(member)), T.StructField(self.bad, T.StringType())])
        mark = f'{{"{self.name}":1}}'
        parts = [F.lit(f'{{"{self.name}":['), text, F.lit(f",{f'[{mark}]' if listed else mark}]}}")]
        return F.from_json(F.concat(*parts), whole, self.options)

    def value(self, parsed: Column, listed: bool) -> Column:
        """What the text holds; NULL unless all of it could be read."""
        members = parsed[self.name]
        end = F.get(members, F.lit(1))
        mark = F.get(end, F.lit(0))[self.name] if listed else end[self.name]
        sound = parsed[self.bad].isNull() & (F.size(members) == 2) & (mark == 1)
        return F.when(sound, F.get(members, F.lit(0)))

    def malformed(self, row: str) -> Column:
        """Whether the object could not be read, or holds a fractional number too large for its type."""
        parsed = F.col(row)
        names = [f.name for f in self.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        broken = parsed.isNull() | parsed[self.bad].isNotNull()
        if not names:
            return broken
        values = ", ".join(f"CAST({row}.`{n}` AS DOUBLE)" for n in names)
        return broken | F.expr(f"exists(array({values}), v -> coalesce(isnan(v) OR abs(v) = double('infinity'), false))")


def _only_value(text: Column) -> Column:
    """The text of the one JSON value in ``text``; NULL if it is malformed or something follows the value."""
    mark = uuid.uuid4().hex
    both = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{mark}"]')), T.ArrayType(T.StringType()), _STRICT)
    return _once(both, lambda b: F.when((F.size(b) == 2) & (F.get(b, F.lit(1)) == mark), F.get(b, F.lit(0))))


def decode_messages(messages: DataFrame, value: str = "value", schema: T.StructType | None = None) -> DataFrame:
    """One object per message. Adds the reading's fields and ``malformed``; each message is parsed once.

    A field of the wrong type makes the whole message malformed. So do a second
    value or other text behind the object, NaN, numbers beyond the type's range and
    single-quoted text. Fields outside the schema are ignored.
    """
    schema = schema or reading_schema()
    strict = _Strict.of(schema)
    # an outer explode lets no filter through, in which the parse would be repeated for every part of the condition
    parsed = messages.select(*messages.columns, F.explode_outer(F.array(strict.parse(F.col(value), False))).alias("_parsed"))
    rows = parsed.withColumn("_row", strict.value(F.col("_parsed"), False))
    return rows.select(*messages.columns, strict.malformed("_row").alias("malformed"), *_filled("_row", schema))


def decode_arrays(bodies: DataFrame, value: str = "value", schema: T.StructType | None = None) -> DataFrame:
    """One array of objects per body, exploded to readings with their position.

    A body is parsed once. Only one that cannot be read as a whole is looked at
    again, object by object, to tell which of them are malformed. A body that is
    not an array, or has text behind it, comes back as one malformed row; an
    empty array gives no rows.
    """
    schema = schema or reading_schema()
    strict = _Strict.of(schema)
    texts = _once(
        _only_value(F.col(value)),
        lambda body: F.when(F.ltrim(body).startswith("["), F.from_json(body, T.ArrayType(T.StringType()), _STRICT)),
    )
    again = F.transform(F.coalesce(texts, F.array(F.lit(None).cast("string"))), lambda t: F.from_json(t, strict.item, strict.options))
    kept = [c for c in bodies.columns if c != value]
    parsed = bodies.withColumn("_parsed", strict.parse(F.col(value), True))
    lists = parsed.select(*kept, F.coalesce(strict.value(F.col("_parsed"), True), again).alias("_items"))
    # an inner explode would put a filter on the list below it, for which the body would be parsed once more
    rows = lists.select(*kept, F.posexplode_outer("_items").alias("position", "_row")).where("position IS NOT NULL")
    return rows.select(*kept, "position", strict.malformed("_row").alias("malformed"), *_filled("_row", schema))


def rejects(decoded: DataFrame, value: str = "value") -> DataFrame:
    """Messages that could not be read, with their text."""
    return decoded.where("malformed").select(*[c for c in decoded.columns if c in (value, "seq", "batch_id", "id", "ts")])


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(~F.col("malformed")).drop("malformed")


def strict_batches(decoded: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Keep only readings of batches without a malformed message.

    The bad batches are one row each after a partial aggregate; the readings
    meet them in an anti join, so no window sorts the readings.
    """
    bad = decoded.where("malformed").select(batch).distinct()
    return accepted(decoded.join(bad, batch, "left_anti"))
