"""Column expressions used all over the library."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256
MAX_ZOOM = 10
PIXELS = TILE << MAX_ZOOM


def cell(coord, cells: int) -> Column:
    """The cell of a unit coordinate on a line of so many cells; 1.0 is in the last, null
    in none."""
    coord = F.col(coord) if isinstance(coord, str) else coord
    return F.when(coord.isNotNull(), F.least(F.lit(cells - 1), F.floor(coord * cells).cast("int")))


def placed() -> Column:
    """Whether a row of the map has a position: others take no part in pixels and tiles."""
    return F.col("xw").isNotNull() & F.col("yw").isNotNull()


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) that depends on the text alone, the same in any engine."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100000) / F.lit(100000.0)


def id_number(id_col) -> Column:
    """The digits after the last A of an author id; an id of another form is an error."""
    digits = F.regexp_extract(id_col, r"A(\d+)$", 1)
    wrong = F.raise_error(F.concat(F.lit("malformed author id: "), F.coalesce(F.col(id_col), F.lit("null"))))
    return F.when(digits != "", digits.cast("bigint")).otherwise(wrong.cast("bigint"))


def id_code(id_col) -> Column:
    """An author id (A and a number of up to 17 digits without leading zeros) as a number,
    in the order of the ids as texts: the digits, filled up to 17, and how many they are.
    Joins and sums by it move 8 bytes. An id of another form is an error."""
    text = F.col(id_col) if isinstance(id_col, str) else id_col
    wrong = F.raise_error(F.concat(F.lit("malformed author id: "), F.coalesce(text, F.lit("null"))))
    code = F.rpad(F.substring(text, 2, 17), 17, "0").cast("bigint") * 18 + F.length(text) - 1
    return F.when(text.rlike("^A(0|[1-9][0-9]{0,16})$"), code).otherwise(wrong.cast("bigint"))


def code_id(code) -> Column:
    """The author id that id_code() made a number of."""
    code = F.col(code) if isinstance(code, str) else code
    digits = F.call_function("div", code, F.lit(18)).cast("string")
    return F.concat(F.lit("A"), F.substring(digits, F.lit(1), (code % 18).cast("int")))


def byte_of(value: Column, top: int = 255) -> Column:
    """Rounded half to even and clipped to 0..top."""
    return F.greatest(F.lit(0), F.least(F.lit(top), F.rint(value).cast("int")))


def size_byte(citations: Column) -> Column:
    return byte_of(size_value(citations))


def size_value(citations: Column) -> Column:
    return F.sqrt(F.greatest(citations.cast("double"), F.lit(0.0))) / F.lit(700.0) * 255


def citation_tier(citations: Column, bottom: int = 5_000) -> Column:
    """Splat radius at the largest zoom; null below the bottom threshold."""
    return F.when(citations >= 200_000, 3).when(citations >= 60_000, 2).when(citations >= bottom, 1)
