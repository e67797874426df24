"""Alerts from a stream of ties, against the same rule over all rows at one time."""

import datetime
import random

from tieweave.streaming import alerts, ingest

DAY = datetime.datetime(2020, 1, 1)


def plain(rows, days):
    found = {}
    for tie, company, kind, at in sorted((r for r in rows if None not in r[1:] and r[2] in (alerts.GIFT, alerts.CONTRACT)), key=lambda r: (r[3], r[0])):
        mine = found.setdefault(company, {"told": None, "newest": {}})
        other = mine["newest"].get(alerts.CONTRACT if kind == alerts.GIFT else alerts.GIFT)
        if mine["told"] is None and other and (at - other[0]).days <= days:
            mine["told"] = (company, at, tie, other[1], kind)
        mine["newest"][kind] = (at, tie)
    return sorted(x["told"] for x in found.values() if x["told"])


def land(spark, rows, path):
    spark.createDataFrame(rows, alerts.TIES).coalesce(1).write.parquet(path)


def run(spark, tmp_path, days):
    stream = alerts.closing_loops(alerts.landed(spark, str(tmp_path / "in")), late="10 days", expiry_days=days)
    ingest.into(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    return sorted(tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out")).select("company_id", "closed_at", "tie_id", "other_id", "kind").collect())


def test_loops_close_once_over_batches_and_replays(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"t{i:03}", f"c{rng.randrange(25)}", rng.choice([alerts.GIFT, alerts.CONTRACT, alerts.GIFT, "OWNS"]), DAY + datetime.timedelta(days=rng.randrange(400))) for i in range(90)]
    rows += [("n1", None, alerts.GIFT, DAY), ("n2", "c1", None, DAY)]
    rows.sort(key=lambda r: (r[3], r[0]))
    for k in range(3):
        land(spark, rows[k * 31 : (k + 1) * 31], str(tmp_path / "in" / f"{k}"))
    first = run(spark, tmp_path, 30)
    assert first == plain(rows, 30) and 3 < len(first) < len({r[1] for r in rows})
    assert run(spark, tmp_path, 30) == first  # started again without new files
    last = rows[-1][3]
    land(spark, [r for r in rows[-20:] if r[3] >= last - datetime.timedelta(days=9)], str(tmp_path / "in" / "again"))  # rows that land again
    assert run(spark, tmp_path, 30) == first
    told = first[0][0]
    new = [("z1", told, alerts.GIFT, last), ("z2", told, alerts.CONTRACT, last), ("z3", "fresh", alerts.GIFT, last)]
    land(spark, new, str(tmp_path / "in" / "new"))
    land(spark, [("z4", "fresh", alerts.CONTRACT, last + datetime.timedelta(days=30)), ("z5", "never", alerts.GIFT, last + datetime.timedelta(days=500))], str(tmp_path / "in" / "newer"))
    land(spark, [("z6", "never", alerts.CONTRACT, last + datetime.timedelta(days=531))], str(tmp_path / "in" / "newest"))  # its other half has expired
    assert run(spark, tmp_path, 30) == sorted([*first, ("fresh", last + datetime.timedelta(days=30), "z4", "z3", alerts.CONTRACT)])
