"""Column expressions with the reference semantics.

Floating-point rules differ from Spark's defaults on purpose: ``minimum`` and
``maximum`` are the comparisons ``a < b ? ...`` in which any comparison with
NaN is false, division gives inf or NaN instead of raising, and ``log`` of zero
is minus infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def less(a: Column, b: Column) -> Column:
    """IEEE ``a < b``: false if either is NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def equal(a: Column, b: Column) -> Column:
    """IEEE ``a == b``: NaN equals nothing."""
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def minimum(a: Column, b: Column) -> Column:
    return F.when(less(a, b), a).otherwise(b)


def maximum(a: Column, b: Column) -> Column:
    return F.when(less(a, b), b).otherwise(a)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity of x's sign, 0/0 and NaN are NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def inverse(a: Column) -> Column:
    return divide(F.lit(1.0), a)


def log(a: Column) -> Column:
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).otherwise(F.log(a))


def log10(a: Column) -> Column:
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).otherwise(F.log10(a))


UNARY = {
    "acos": F.acos,
    "asin": F.asin,
    "atan": F.atan,
    "ceil": lambda c: F.ceil(c).cast("double"),
    "cos": F.cos,
    "cosh": F.cosh,
    "exp": F.exp,
    "fabs": F.abs,
    "floor": lambda c: F.floor(c).cast("double"),
    "log": log,
    "log10": log10,
    "sin": F.sin,
    "sinh": F.sinh,
    "sqrt": F.sqrt,
    "tan": F.tan,
    "tanh": F.tanh,
    "neg": lambda c: -c,
    "inverse": inverse,
}

BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": divide,
    "minimum": minimum,
    "maximum": maximum,
    "pow": F.pow,
    "eq": equal,
    "lt": less,
    "gt": lambda a, b: less(b, a),
    "lte": lambda a, b: less(a, b) | equal(a, b),
    "gte": lambda a, b: less(b, a) | equal(a, b),
    "eor": lambda a, b: a | b,
    "eand": lambda a, b: a & b,
}


def unary(name: str, c) -> Column:
    return UNARY[name](col(c))


def binary(name: str, a, b) -> Column:
    return BINARY[name](col(a), col(b))


def ifelse(test: Column, yes: Column, no: Column) -> Column:
    """Each branch counts only where it is chosen."""
    return F.when(test, yes).otherwise(no)


def assign_where(old: Column, chosen: Column, new: Column) -> Column:
    """Scatter of ``new`` to the chosen rows; the others keep ``old``."""
    return F.when(chosen, new).otherwise(old)


# ------------------------------------------------------------ comparison with tolerance

#: Ten machine epsilons of each type.
DOUBLE_EPSILON, FLOAT_EPSILON = 10 * 2.0**-52, 10 * 2.0**-23


def nearly_equal(a: Column, b: Column, eps=DOUBLE_EPSILON) -> Column:
    """Equal, or differing by less than ``eps`` times the sum of magnitudes (strictly)."""
    d, size = F.abs(a - b), F.abs(a) + F.abs(b)
    return (d == 0) | (~F.isnan(d) & (d < lit(eps) * size))


def nearly_zero(a: Column, eps=DOUBLE_EPSILON) -> Column:
    """Absolute: ``|a| < eps``."""
    return less(F.abs(a), lit(eps))


def relative_difference(a: Column, b: Column) -> Column:
    """``|(a - b) / (|a| + |b|)|``, 0 if both are 0."""
    size = F.abs(a) + F.abs(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.abs(F.try_divide(a - b, size)))


#: Mantissa bits dropped when 9 to 14 decimal digits are kept (fixed values).
DROPPED_BITS = {9: 31, 10: 26, 11: 21, 12: 16, 13: 12, 14: 11}


def truncate_double(c: Column, digits: int) -> Column:
    """Keep ``digits`` decimal digits: all of them outside 1..14, a float's up to 8, else round the mantissa (halves away from zero)."""
    if digits <= 0 or digits >= 15:
        return c
    if digits <= 8:
        return c.cast("float").cast("double")
    size = F.abs(c)
    finite = ~F.isnan(c) & (size < F.lit(INF)) & (c != 0)
    guess = F.floor(F.log2(size)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(power > size, guess - 1).when(power * 2 <= size, guess + 1).otherwise(guess)
    unit = F.pow(F.lit(2.0), exponent - F.lit(float(52 - DROPPED_BITS[digits])))
    return F.when(finite, F.signum(c) * F.floor(size / unit + 0.5).cast("double") * unit).otherwise(c)


# ------------------------------------------------------------ units, text, configuration


def convert_unit(c: Column, factor: float, offset: float = 0.0) -> Column:
    """Linear conversion between units."""
    return c * F.lit(float(factor)) + F.lit(float(offset))


def name_matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search of a pattern."""
    return c.rlike("(?i)" + pattern)


def select_name(c: Column, names: list[str] | None = None, pattern: str | None = None, exclude_names: bool = False, exclude_pattern: bool = False) -> Column:
    """A listed name is decided by the list; others by the pattern; with neither, everything is chosen."""
    listed = c.isin(list(names)) if names else F.lit(False)
    if pattern is not None:
        hit = name_matches(c, pattern)
        rest = ~hit if exclude_pattern else hit
    else:
        rest = F.lit(not names or exclude_names)
    return F.when(listed, F.lit(not exclude_names)).otherwise(rest)


def replace_variables(c: Column, values: dict[str, str]) -> Column:
    """``@name@`` -> value, for the names given."""
    for name, value in values.items():
        c = F.replace(c, F.lit(f"@{name}@"), F.lit(value))
    return c


def parameters(c: Column) -> Column:
    """``a=1;b=2`` -> map."""
    return F.str_to_map(c, F.lit(";"), F.lit("="))


def duration(seconds: Column) -> Column:
    """Seconds as ``h:mm:ss``."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


# ------------------------------------------------------------ flags

FLAGS = {"own": 1 << 0, "shared": 1 << 1, "boundary": 1 << 2, "refine": 1 << 3, "coarsen": 1 << 4, "inactive": 1 << 5, "overlap": 1 << 6, "in_patch": 1 << 7, "user1": 1 << 8, "user2": 1 << 9}


def has_flag(c: Column, *names: str) -> Column:
    mask = 0
    for n in names:
        mask |= FLAGS[n]
    return c.bitwiseAND(F.lit(mask)) == mask


def set_flag(c: Column, name: str, on: bool = True) -> Column:
    return c.bitwiseOR(F.lit(FLAGS[name])) if on else c.bitwiseAND(F.lit(~FLAGS[name]))
