"""Reports, and the sources that serving and testing read."""

import pytest

from quakeloom.operators import reports
from quakeloom.sources import raw

HEAD = "Date-Time,Latitude,Longitude,Depth,Magnitude,Location,Month,Year\n"
LINE = "2 May 2022 - 3:15 PM,7.5,126.5,12,4.5,Here,May,2022\n"


def test_html_report(spark):
    long = spark.createDataFrame([("forest", "any", "brier", 0.125), ("gbt", "any", "brier", None)], "family string, target string, metric string, value double")
    scores = spark.createDataFrame([("forest", "any", 1, 0.9), ("forest", "any", 0, 0.2)], "family string, target string, label int, probability double")
    page = reports.html_report("Spring", long, scores)
    assert page.startswith("<!DOCTYPE html><title>Spring</title>") and "<td>0.1250</td>" in page and "<td>-</td>" in page
    assert page.count("<tr>") == 2 + 2 + 2, "two heads, two metrics, two bins"


def test_scatter_sample(spark):
    scores = spark.range(101).selectExpr("id", "if(id = 7, null, id * 1D) AS actual", "id / 2D AS predicted")
    found = reports.scatter_sample(scores, 10).collect()
    assert len(found) == 10 and [r.axis for r in found] == pytest.approx([98.02 * 1.05] * 10)
    assert sorted(r.id for r in found) == sorted(r.id for r in reports.scatter_sample(scores.repartition(3), 10).collect())
    assert reports.scatter_sample(scores, 500).count() == 100


def test_single_event_csv(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text(HEAD + LINE + "never,7,126,1,2,There,May,2022\n", encoding="utf-8")
    two.write_text(HEAD + LINE * 2, encoding="utf-8")
    row = raw.single_event_csv(spark, str(one)).first()
    assert (row.event_id, row.sort_time, row.magnitude) == (0, 1651504500, 4.5)
    with pytest.raises(ValueError, match="exactly one"):
        raw.single_event_csv(spark, str(two))


def test_labelled(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 1577836800L, 3.0D, 1), (2, 1609459200L, 3.0D, 0), (3, 1640995200L, 3.0D, 1), (4, 1640995200L, 1.0D, 1), (5, 1640995200L, 3.0D, null) AS t(event_id, sort_time, magnitude, y)")
    ids = lambda *args: sorted(r.event_id for r in raw.labelled(rows, *args).collect())
    assert ids((2021, None), 2.0, ["y"]) == [2, 3] and ids((None, 2021), 2.0, ["y"]) == [1, 2] and ids((2022, 2022), 0.0, ["magnitude"]) == [3, 4, 5]
    with pytest.raises(ValueError, match="missing columns: z"):
        raw.labelled(rows, (None, None), 0.0, ["z"])
