"""Several values packed in one field, one value per row with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Marks of the masked text; where the text itself holds the first one it is escaped beforehand.
_MARK, _END = "\u0001", "\u0002"
DELIMITERS = "|;,\t"


def split_packed(col: Column, delimiters: str = DELIMITERS) -> Column:
    """Array of the values packed in a string column.

    Values are separated by any character of ``delimiters``; spaces around a value are dropped. A
    value that begins with a double quote runs to the next double quote that is not doubled, and what
    lies inside is the value, with doubled quotes standing for one; text between that quote and the
    next delimiter is ignored. A quote that is never closed is ordinary text, as are quotes elsewhere.
    Empty values (also quoted ones) are dropped. NULL and blank text give an empty array.

    Quoted spans are replaced by indexed placeholders (the mark is escaped in the text first, so none
    can collide), the rest is split, and the spans are put back through array lookup. All of it runs
    in the JVM; the patterns are possessive, so long texts need no stack.
    """
    cls = "[" + "".join("\\" + c if c in "|;,[]^-\\" else c for c in delimiters) + "]"
    span = f'(\\A|{cls})( *+)"([^"]*+(?:""[^"]*+)*+)"[^{cls[1:-1]}]*+'
    text = F.regexp_replace(F.coalesce(col, F.lit("")), _MARK, _MARK + "e")
    spans = F.regexp_extract_all(text, F.lit(span), F.lit(3))
    pieces = F.split(F.regexp_replace(text, span, f"$1{_MARK}q"), f"{_MARK}q")
    marked = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(_MARK), i.cast("string"), F.lit(_END), p))), "")
    restore = lambda v: F.when(
        v.rlike(f"\\A{_MARK}[0-9]+{_END}"),
        F.replace(F.get(spans, F.regexp_extract(v, f"\\A{_MARK}([0-9]+){_END}", 1).cast("int") - 1), F.lit('""'), F.lit('"')),
    ).otherwise(v)
    values = F.transform(F.split(marked, cls), lambda v: F.replace(restore(F.trim(v)), F.lit(_MARK + "e"), F.lit(_MARK)))
    return F.filter(values, lambda v: v != "")


def explode_packed(df: DataFrame, key: str, fields: list[str], *, min_values: int = 1, delimiters: str = DELIMITERS) -> DataFrame:
    """One row ``(key, field_name, pos, val)`` for each value packed in ``fields``; ``pos`` counts from 1.

    Only fields with at least ``min_values`` values come out. No shuffle: rows are exploded in place.
    NULL keys are kept; an empty table gives no row.
    """
    per = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), split_packed(F.col(f), delimiters).alias("vals")) for f in fields]))
    x = df.select(F.col(key).alias("__hf_k"), per.alias("__hf_f")).where(F.size("__hf_f.vals") >= min_values)
    y = x.select("__hf_k", "__hf_f.field_name", F.posexplode("__hf_f.vals").alias("p", "val"))
    return y.select(F.col("__hf_k").alias(key), "field_name", (F.col("p") + 1).alias("pos"), "val")
