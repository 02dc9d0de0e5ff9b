"""Field specifications: a line of comma-separated fields that becomes tokens and a loss mask.

``f`` is a text column; ``a+b`` joins columns; ``[f]`` has no loss; ``<|bos|>``, ``<|eos|>`` and ``<|17|>`` are ids;
``{f}`` is a column of base64-coded little-endian 32-bit ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import let
from quern.functions.vocab import Vocabulary


def decoded_ids(column: Column) -> Column:
    """Ids of a base64-coded buffer of little-endian 32-bit integers."""
    def ids(h: Column) -> Column:
        def one(i: Column) -> Column:
            byte = lambda j: F.substring(h, i * 8 + 1 + 2 * j, 2)
            v = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")
            return F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")

        n = (F.length(h) / 8).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))

    return let(F.hex(F.unbase64(column)), ids)


@dataclass(frozen=True)
class FieldProcessor:
    fields: str
    vocabulary: Vocabulary
    subfield_separator: str = " "
    add_bos: bool = True
    add_eos: bool = True
    prepend_text: str = ""

    def __post_init__(self):
        if not self.fields:
            raise ValueError("fields must be given")

    def columns_by_row(self, spec: Column, specs: list[str]) -> tuple[Column, Column]:
        """Tokens and mask by the specification that a row's column names, one of ``specs``; another one fails the row."""
        made = {s: replace(self, fields=s).columns() for s in specs}
        out = []
        for i, kind in enumerate(("array<int>", "array<double>")):
            chosen = F.raise_error(F.concat(F.lit("no such field specification: "), F.coalesce(spec, F.lit("null")))).cast(kind)
            for s, columns in made.items():
                chosen = F.when(spec == s, columns[i].cast(kind)).otherwise(chosen)
            out.append(chosen)
        return out[0], out[1]

    def columns(self) -> tuple[Column, Column]:
        """Tokens and mask; the specification is read once, when the plan is built."""
        v = self.vocabulary
        tokens: list[Column] = []
        masks: list[Column] = []

        def add(x: Column, mask: float) -> None:
            tokens.append(x.cast("array<int>"))
            masks.append(F.array_repeat(F.lit(float(mask)), F.size(x)))

        if self.add_bos:
            add(F.array(F.lit(v.bos)), 0.0)
        for i, field in enumerate(self.fields.split(",")):
            mask = 1.0
            if field.startswith("[") and field.endswith("]"):
                field, mask = field[1:-1], 0.0
            if field.startswith("<|") and field.endswith("|>"):
                name = field[2:-2]
                add(F.array(F.lit({"bos": v.bos, "eos": v.eos}[name] if name in ("bos", "eos") else int(name))), mask)
            elif field.startswith("{") and field.endswith("}"):
                add(decoded_ids(F.col(field[1:-1])), mask)
            else:
                text = F.concat_ws(self.subfield_separator, *[F.col(c) for c in field.split("+")])
                add(v.encode(F.concat(F.lit(self.prepend_text), text) if i == 0 else text), mask)
        if self.add_eos:
            add(F.array(F.lit(v.eos)), 1.0)
        return F.concat(*tokens), F.concat(*masks)
