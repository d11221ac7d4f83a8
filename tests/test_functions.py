import math
import random

import pytest
from pyspark.sql import functions as F

from strataforge.functions import distance, sketches, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, want", [("kitten", "sitting", 3), ("", "abc", 3), ("flaw", "lawn", 2), ("saturday", "sunday", 3), ("habibs", "habib", 1)])
def test_levenshtein(spark, a, b, want):
    assert one(spark, distance.levenshtein(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("a, b, want", [("ab", "ba", 1), ("abcdef", "abcfed", 2), ("recieve", "receive", 1), ("ca", "abc", 3)])
def test_damerau_edits_no_part_twice(spark, a, b, want):
    assert one(spark, distance.damerau(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("a, b, want", [("MARTHA", "MARHTA", .961), ("DIXON", "DICKSONX", .813), ("DWAYNE", "DUANE", .840), ("", "abc", 0)])
def test_jaro_winkler(a, b, want):
    assert distance.jaro_winkler_similarity(a, b) == pytest.approx(want, abs=.01)


@pytest.mark.parametrize("a, b, want", [(["a", "b"], ["a", "b", "c"], 1 / 3), (["a"], ["b"], 1.0), ([], [], 0.0)])
def test_jaccard(spark, a, b, want):
    cast = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    assert one(spark, distance.jaccard(cast(a), cast(b))) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [("1010", "1011", 1), ("1010", "0101", 4), ("karolin", "kathrin", 3), ("", "", 0)])
def test_hamming(spark, a, b, want):
    assert one(spark, distance.hamming(F.lit(a), F.lit(b))) == want


def test_vectors_of_different_dimensions_raise(spark):
    with pytest.raises(Exception, match="dimension"):
        one(spark, distance.euclidean(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_cosine_of_a_zero_vector_is_one(spark):
    assert one(spark, distance.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 1.0


def test_distances_are_symmetric_and_zero_on_themselves(spark):
    rnd = random.Random(1)
    rows = [([rnd.uniform(-1, 1) for _ in range(4)], [rnd.uniform(-1, 1) for _ in range(4)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for name in ("cosine", "euclidean", "manhattan"):
        op = distance.operator(name)
        for r in df.select(op(F.col("a"), F.col("b")).alias("ab"), op(F.col("b"), F.col("a")).alias("ba"), op(F.col("a"), F.col("a")).alias("aa")).collect():
            assert r.ab == pytest.approx(r.ba) and r.aa == pytest.approx(0, abs=1e-12) and r.ab >= 0


@pytest.mark.parametrize("lat, lon, n, want", [(57.64911, 10.40744, 11, "u4pruydqqvj"), (48.858260, 2.294495, 7, "u09tunq"), (0, 0, 6, "s00000"), (45, -90, 1, "f"), (-45, 90, 1, "q")])
def test_geohash(spark, lat, lon, n, want):
    assert spatial.geohash_of(lat, lon, n) == want
    assert one(spark, spatial.geohash(F.lit(float(lat)), F.lit(float(lon)), n)) == want


def test_haversine(spark):
    far = one(spark, distance.haversine(F.lit(-23.5505), F.lit(-46.6333), F.lit(-23.9608), F.lit(-46.3336)))
    assert 50_000 < far < 60_000
    assert one(spark, distance.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * spatial.RADIUS)
    assert one(spark, distance.haversine(F.lit(91.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is None


def test_a_cover_holds_every_point_of_its_box():
    cells = set(spatial.cover(40.5, -73.6, 41.0, -73.0, 5))
    rnd = random.Random(42)
    for _ in range(500):
        assert spatial.geohash_of(rnd.uniform(40.5, 41.0), rnd.uniform(-73.6, -73.0), 5) in cells
    with pytest.raises(spatial.CoverTooLarge):
        spatial.cover(-80, -170, 80, 170, 6)


def test_neighbours_wrap_and_stop_at_the_poles():
    assert len(spatial.neighbours("s0")) == 8
    assert len(spatial.neighbours(spatial.geohash_of(89.9, 0, 3))) == 5
    assert spatial.geohash_of(0.1, -179.9, 2) in spatial.neighbours(spatial.geohash_of(0.1, 179.9, 2))


def test_z_order_interleaves(spark):
    x, y = F.lit(0b11).cast("long"), F.lit(0b00).cast("long")
    assert one(spark, spatial.z_order([x, y], bits=2)) == "a"


def test_sketches_keep_their_bounds(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("v"))
    assert sketches.cardinality(df, "v").first().estimate == pytest.approx(5000, rel=.04)
    cm = sketches.CountMin(.01, .01)
    assert (cm.width, cm.depth) == (272, 5)
    rows = cm.rows(df, "v")
    assert cm.total(rows).first().total == 20_000
    for r in cm.frequency(rows, df.limit(50), "v").collect():
        assert 4 <= r.frequency <= 4 + .01 * 20_000
    bloom = sketches.Bloom(1 << 16, 5)
    words = bloom.build(df, "v")
    assert bloom.probe(words, df.distinct(), "v").count() == 5000
    assert bloom.probe(words, spark.range(10**6, 10**6 + 1000).withColumnRenamed("id", "v"), "v").count() < 100


def test_a_cuckoo_filter_forgets():
    c = sketches.Cuckoo(256)
    for i in range(600):
        c.add(f"k{i}")
    assert all(f"k{i}" in c for i in range(600))
    for i in range(0, 600, 2):
        assert c.remove(f"k{i}")
    assert all(f"k{i}" in c for i in range(1, 600, 2)) and sum(f"k{i}" in c for i in range(0, 600, 2)) < 60
    small = sketches.Cuckoo(2)
    with pytest.raises(sketches.FilterFull):
        for i in range(50):
            small.add(str(i))


def test_circles_near_the_date_line_and_the_poles(spark):
    """The boxes before the exact test lose no point; they are the least of their kind elsewhere."""
    rnd = random.Random(21)
    points = [(math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for _ in range(4000)] + [(90.0, 3.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    df = spark.createDataFrame(points, "lat double, lon double").persist()
    for lat, lon, metres in [(0, 179.5, 900e3), (0, -179.5, 900e3), (85, 10, 1e6), (60, 0, 2e6), (-89, -170, 5e5), (90, 0, 3e6), (10, 20, 15e6), (0, 180, 2e7), (-45, 170, 3e6)]:
        def far(a, o):
            h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat)) * math.sin(math.radians(o - lon) / 2) ** 2
            return 2 * spatial.INDEX_RADIUS * math.asin(min(1, math.sqrt(h)))

        want = sum(far(a, o) <= metres for a, o in points)
        assert df.where(spatial.within(F.col("lat"), F.col("lon"), float(lat), float(lon), metres)).count() == want > 0


def test_z_ranges_hold_their_box_and_reach_the_scan(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    sides, dims = [(-90, 90), (-180, 180)], [spatial.normalise(F.col("lat"), -90, 90), spatial.normalise(F.col("lon"), -180, 180)]
    df.withColumn("z", spatial.z_order(dims)).sort("z").coalesce(1).write.parquet(f"{tmp_path}/z")
    stored = spark.read.parquet(f"{tmp_path}/z")
    for low, high in (([10, 20], [30, 60]), ([-1, -1], [1, 1]), ([-90, -180], [90, 180]), ([5, 5], [4, 4])):
        exact = spatial.in_z_box([F.col("lat"), F.col("lon")], sides, low, high)
        want = {i for i, y, x in rows if low[0] <= y <= high[0] and low[1] <= x <= high[1]}
        for at_most in (1, 8, 64):
            ranges = spatial.z_ranges(sides, low, high, at_most)
            assert len(ranges) <= at_most
            near = stored.where(spatial.in_z_ranges(F.col("z"), ranges))
            assert {r.id for r in near.where(exact).collect()} == want
        assert near.count() <= 4 * len(want) + 40
    for where, name in ((spatial.in_z_ranges(F.col("z"), spatial.z_ranges(sides, [10, 20], [30, 60], 4)), "z"), (spatial.within(F.col("lat"), F.col("lon"), 5, 179, 900_000), "lat")):
        plan = stored.where(where)._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual({name}," in plan.split("PushedFilters")[1]
