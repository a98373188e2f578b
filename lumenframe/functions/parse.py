"""Parsers and formatters of the small text forms: parameters, sizes, rates, specs and timecodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def params(text: Column) -> Column:
    """Map of the letter and value of space-separated ``Xvalue`` words; of equal letters the last counts."""
    words = F.filter(F.split(text, " +"), lambda w: w.rlike("^[A-Z]"))
    letters = F.transform(words, lambda w: F.substring(w, 1, 1))
    last = F.filter(words, lambda w, i: ~F.array_contains(F.slice(letters, i + 2, F.size(letters)), F.substring(w, 1, 1)))
    return F.map_from_entries(F.transform(last, lambda w: F.struct(F.substring(w, 1, 1), F.substr(w, F.lit(2)))))


def format_params(m: Column) -> Column:
    """The words again, in the order of their letters."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], e["value"])), " ")


def merged(under: Column, over: Column) -> Column:
    """Union of two maps; the second counts where both have a key."""
    return F.map_zip_with(under, over, lambda k, a, b: F.coalesce(b, a))


def frame_seconds(rate: Column) -> Column:
    """Seconds of a frame of a ``num:den`` rate; 0 without one, null where it is malformed."""
    ok = rate.rlike(r"^\d+:\d+$")
    value = F.split_part(rate, F.lit(":"), F.lit(2)).try_cast("double") / F.nullif(F.split_part(rate, F.lit(":"), F.lit(1)).try_cast("double"), F.lit(0.0))
    return F.when(rate.isNull(), 0.0).when(ok, value)


def size(text: Column) -> tuple[Column, Column]:
    """(width, height) of ``WxH`` or ``W:H``; nulls for anything else."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(\d{1,9})[x:](\d{1,9})$", i), F.lit("")).cast("int")
    return part(1), part(2)


def strict_double(text: Column) -> Column:
    """A number and nothing after it; null for anything else."""
    return F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds cut."""
    return clock(seconds * 1000)


def clock(millis: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds, which are cut after they are rounded to six decimals; null of null.

    Rounded as a double: scaled up, to a whole number, and down again. ``round`` to decimals goes by the digits of the number instead, and
    leaves large ones that lie a last bit under a whole millisecond there.
    """
    ms = F.floor(F.round(millis * 1e6) / 1e6).cast("long")
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs, by as many steps as the largest pair of longs can need."""
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0).cast("long"))).alias("y")))
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def sampler_spec(text: Column) -> tuple[Column, Column]:
    """(name, parameters) of ``name[:k=1,k='text',k="text",k=bare]``."""
    name = F.regexp_extract(text, "^([A-Za-z_][A-Za-z_0-9]*)", 1)
    rest = F.regexp_extract(text, "^[A-Za-z_][A-Za-z_0-9]*:(.*)$", 1)
    item = r"([A-Za-z_][A-Za-z_0-9]*)=(?:'([^']*)'|\"([^\"]*)\"|([^,]*))(?:,|$)"
    keys = F.regexp_extract_all(rest, F.lit(item), F.lit(1))
    got = [F.regexp_extract_all(rest, F.lit(item), F.lit(i)) for i in (2, 3, 4)]
    values = F.zip_with(F.zip_with(got[0], got[1], lambda a, b: F.concat(a, b)), got[2], lambda a, b: F.concat(a, b))
    return name, F.map_from_entries(F.arrays_zip(keys.alias("k"), values.alias("v")))


def format_spec(name: Column, m: Column) -> Column:
    """``name:k=v,...`` in the order of the keys, numbers bare and text quoted."""
    shown = lambda v: F.when(v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), v).otherwise(F.concat(F.lit("'"), v, F.lit("'")))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"]))), ",")
    return F.when(F.size(m) > 0, F.concat(name, F.lit(":"), body)).otherwise(name)


def chunks(text: Column, n: int) -> Column:
    """The text in pieces of n characters, the last as long as it is."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))
