import math

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import properties, series
from lumenframe.operators import timeline as tl


def sequence(spark, tags):
    return spark.createDataFrame([("s", i, (t, 3)) for i, t in enumerate(tags)], "sequence_id string, pos long, clip struct<tag:string,frames:long>")


def tags(df):
    return [r.clip.tag for r in df.orderBy("pos").collect()]


def test_map_and_reduce(spark):
    seq = sequence(spark, ["clip 1", "clip 2", "clip 3"])
    new = lambda c: F.struct(F.concat(F.lit("new "), c["tag"]).alias("tag"), c["frames"].alias("frames"))
    assert tags(tl.mapped(seq, lambda c, p: F.array(c))) == ["clip 1", "clip 2", "clip 3"]
    assert tags(tl.mapped(seq, lambda c, p: F.array(new(c)))) == ["new clip 1", "new clip 2", "new clip 3"]
    assert tags(tl.mapped(seq, lambda c, p: F.when(p % 2 == 1, F.array(new(c))))) == ["new clip 2"]
    assert tags(tl.mapped(seq, lambda c, p: F.array(new(c), c))) == ["new clip 1", "clip 1", "new clip 2", "clip 2", "new clip 3", "clip 3"]
    six = sequence(spark, [f"clip {i}" for i in range(1, 7)])
    pair = lambda a, b: F.struct(F.concat(a["tag"], F.lit(" and "), b["tag"]).alias("tag"), a["frames"].alias("frames"))
    assert tl.reduced(six, pair).first().clip.tag == "clip 1 and clip 2 and clip 3 and clip 4 and clip 5 and clip 6"
    skip = lambda a, b: F.when(b["tag"] != "clip 2", pair(a, b))
    assert tl.reduced(seq, skip).first().clip.tag == "clip 1 and clip 3"


def test_dissolve_by_hand(spark):
    got = tl.dissolve(spark.createDataFrame([(1, 6, 5)], "a long, na long, nb long"), 4, lambda x: x * x).collect()
    under = [r.alpha for r in sorted(got, key=lambda r: r.local_frame) if r.layer == "under"]
    over = {r.framenum: r.alpha for r in got if r.layer == "over"}
    assert under == [1, 1, 1, 1 - 1 / 16, 1 - 1 / 4, 1 - 9 / 16]
    assert over == {2: 0, 3: 1 / 16, 4: 1 / 4, 5: 9 / 16, 6: 1}


def test_transform_turns_about_its_origin(spark):
    m = tl.transform(320, 240, rotate=math.pi / 2)
    x, y = tl.moved(F.col("m"), F.lit(161.0), F.lit(120.0))
    r = spark.range(1).select(m.alias("m")).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(160), pytest.approx(121))


def test_rates_by_hand(spark):
    """Zero is a quarter; a value a tenth of a hundredth over it takes 100 ^ -0.1 of the greatest rate."""
    rows = [(1, i, v) for i, v in enumerate([0.251, 0.25, 0.0, 0.9, 1.099])]
    df = spark.createDataFrame(rows, "user_id long, i long, v double")
    assert sum(v for _, _, v in rows) / 5 == pytest.approx(0.5)
    got = [r.rate for r in series.bend_rates(df).orderBy("i").collect()]
    assert got == pytest.approx([50 * 100**-0.1, 50, 50, 1, 1])


def test_kernel_of_one_coefficient(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], "user_id long, i long, v double")
    assert all(math.isnan(r.out) for r in series.pitch_convolve(df, ([1.0],)).collect())


def test_properties_read_each_other(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.5)], "framenum long, portion double")
    props = {"y": lambda s: s.x * 2 + s.base, "x": lambda s: s.portion * s.width, "width": 10.0, "base": F.col("framenum"), "text": "t", "portion2": lambda s: s.portion}
    got = [(r.x, r.y, r.text, r.portion2) for r in properties.bind(df, props).orderBy("framenum").collect()]
    assert got == [(0.0, 0.0, "t", 0.0), (5.0, 11.0, "t", 0.5)]


@pytest.mark.parametrize("props", [{"a": lambda s: s.a}, {"a": lambda s: s.b, "b": lambda s: s.c + 1, "c": lambda s: s.a}])
def test_circular_properties_are_refused(spark, props):
    with pytest.raises(properties.CircularReference, match="a -> "):
        properties.bind(spark.range(1), props)


def test_unknown_names_are_refused(spark):
    with pytest.raises(KeyError):
        properties.bind(spark.range(1), {"a": lambda s: s.nothing})
