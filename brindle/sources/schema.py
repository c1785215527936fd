"""What is registered about a type of document."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def camel_case(name: str) -> str:
    """``FirstName`` or ``first_name`` as ``firstName``."""
    first, *rest = re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", name)
    return first.lower() + "".join(p.capitalize() for p in rest)


@dataclass(frozen=True)
class DocumentType:
    """A registered type: where its rows are, which column is the id, and which columns are metadata.

    Metadata columns that are not named do not exist, and filters that need them are errors.
    """

    name: str
    table: str
    id: str
    body: StructType | None = None  # of a JSON column ``data``, parsed once at the scan
    tenant: str | None = None
    deleted: str | None = None  # a condition in SQL: the row is softly deleted
    deleted_at: str | None = None
    modified_at: str | None = None
    created_at: str | None = None
    version: str | None = None
    alias: tuple[str, str] | None = None  # a column and the value it has for this type, when types share a table
    enums: dict[str, dict[str, int]] = field(default_factory=dict)  # stored as numbers

    def scan(self, frame: DataFrame) -> DataFrame:
        """Rows of the type, with JSON bodies parsed to typed members."""
        if self.body is not None:
            frame = frame.withColumn("data", F.from_json("data", self.body))
        if self.alias:
            frame = frame.where(F.col(self.alias[0]) == self.alias[1])
        return frame

    def enum(self, member: str, value: str) -> int:
        """The stored number of an enum value."""
        return self.enums[member][value]

    def enum_column(self, member: str) -> Column:
        """The stored number of a member that is a text; a text that is no value of the enum is an error where it is met."""
        values = self.enums[member]
        numbers = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        known = F.try_element_at(numbers, F.col(member))
        return F.when(F.col(member).isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit(f"no value of {member}: "), F.col(member))).cast("int"))
