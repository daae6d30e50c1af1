"""Run analysis reproduces the published ratios from their own rows."""

import pytest

from labelpool.operators import runs as R

SPEED = [(40, 1, [68.12680721282959, 62.66765260696411, 70.36449027061462]),
         (100, 1, [212.39710068702698, 236.99455547332764, 225.9499809741974]),
         (40, 4, [35.52597451210022, 36.34609794616699, 36.15311551094055]),
         (100, 4, [58.587029218673706, 56.91337609291077, 58.84854984283447])]


@pytest.fixture()
def speed_runs(spark):
    rows = [("smart", p, c, t) for p, c, ts in SPEED for t in ts]
    return spark.createDataFrame(rows, "method string, percentage_set int, cores int, time double")


def test_speed_up_published(spark, speed_runs):
    out = {(r.percentage_set, r.cores): r.speed_up for r in R.speed_up(R.mean_runs(speed_runs)).collect()}
    assert round(out[(100, 4)], 3) == 3.874
    assert round(out[(40, 4)], 3) == 1.862
    assert out[(100, 1)] == 1.0


def test_size_and_scale_up(spark):
    rows = [("m", 10, 1, 10.0), ("m", 20, 2, 12.0), ("m", 10, 4, 5.0), ("m", 20, 4, 7.5)]
    df = spark.createDataFrame(rows, "method string, percentage_set int, cores int, time double")
    size = {(r.cores, r.percentage_set): r.size_up for r in R.size_up(df).collect()}
    assert size[(4, 20)] == 1.5 and size[(2, 20)] is None
    scale = {r.configuration: r.scale_up for r in R.scale_up(df).collect()}
    assert scale["2C / 20%"] == 10.0 / 12.0 and scale["1C / 10%"] == 1.0


def test_pivot_with_repeated_rows(spark):
    rows = [("smart", 5.0, 0.6), ("random", 5.0, 0.5), ("smart", 5.0, 0.7)]
    df = spark.createDataFrame(rows, "method string, labeled_percentage double, accuracy double")
    out = R.learning_curve_pivot(df, ["random", "smart"],
                                 {"random": "Random", "smart": "Uncertainty + Diversity"}).collect()
    assert out[0]["Random"] == 0.5 and out[0]["Uncertainty + Diversity"] == 0.65


# Published size-up and scale-up rows (method smart), typed inline.
SIZE = [(10, 4, 22.64598250389099), (10, 4, 19.853532314300537), (10, 4, 20.042223691940308),
        (20, 4, 26.760648250579834), (20, 4, 26.34012699127197), (20, 4, 29.412540435791016),
        (40, 4, 37.94397830963135), (40, 4, 39.83239555358887), (40, 4, 40.796621322631836),
        (80, 4, 52.31925320625305), (80, 4, 51.25798487663269), (80, 4, 52.851592779159546),
        (100, 4, 59.13970994949341), (100, 4, 54.59350895881653), (100, 4, 54.6358368396759)]
SCALE = [(10, 1, 38.2766535282135), (10, 1, 35.633076429367065), (10, 1, 34.03284168243408),
         (20, 2, 42.709325313568115), (20, 2, 46.92967772483826), (20, 2, 44.110934019088745),
         (40, 4, 55.10267114639282), (40, 4, 52.13399982452393), (40, 4, 58.00188827514648),
         (80, 8, 66.15709805488586), (80, 8, 66.51507115364075), (80, 8, 63.9985237121582),
         (100, 10, 78.559579610824585), (100, 10, 80.40509533882141), (100, 10, 88.95013117790222)]


def _runs(spark, rows):
    return spark.createDataFrame([("smart", p, c, t) for p, c, t in rows],
                                 "method string, percentage_set int, cores int, time double")


def test_size_up_published(spark):
    out = {r.percentage_set: r.size_up for r in R.size_up(R.mean_runs(_runs(spark, SIZE))).collect()}
    assert [round(out[p], 3) for p in (10, 20, 40, 80, 100)] == [1.0, 1.319, 1.896, 2.501, 2.692]


def test_scale_up_published(spark):
    out = {r.configuration: r.scale_up for r in R.scale_up(R.mean_runs(_runs(spark, SCALE))).collect()}
    assert [round(out[c], 3) for c in ("1C / 10%", "2C / 20%", "4C / 40%", "8C / 80%", "10C / 100%")] == \
        [1.0, 0.807, 0.653, 0.549, 0.435]


def test_pivot_has_every_method(spark):
    from labelpool.operators import runs as R_
    rows = [(5.0, "a", 0.5), (5.0, "b", 0.25), (6.0, "c", 0.75)]
    df = spark.createDataFrame(rows, "labeled_percentage double, method string, accuracy double")
    got = R_.learning_curve_pivot(df, ["b"])
    assert got.columns == ["labeled_percentage", "b", "a", "c"]
    assert sorted(map(tuple, got.collect())) == [(5.0, 0.25, 0.5, None), (6.0, None, None, 0.75)]
