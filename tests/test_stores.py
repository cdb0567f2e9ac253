"""Metrics, calibration, stores and gates on fixed values."""

import csv
import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import audit, calibrate, governance, metrics
from newsloom.operators.ruleset import REVIEW, Policy
from newsloom.sources import feeds, sinks


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("b", REVIEW), ("c", "b")], "gold string, pred string")
    m = metrics.overall(df, ["a", "b", "c"]).first()
    assert m["accuracy"] == pytest.approx(1 / 3) and m["review_rate"] == pytest.approx(1 / 3) and m["wrong_decided_count"] == 1
    rows = [("A", m, f, u) for m, f, u in zip("ABABB", ["A", "A", "B", "B", REVIEW], [True] * 4 + [False])]
    c = metrics.rule_corrections(spark.createDataFrame(rows, "gold string, model string, pred string, applied boolean")).first()
    assert (c["rule_applied_count"], c["rule_changed_count"], c["wrong_rule_count"], c["wrong_rule_rate"], c["corrected_count"], c["harmful_change_count"]) == (4, 2, 2, 0.5, 1, 1)


@pytest.mark.parametrize("n,steps", [(0, 5), (1, 5), (60, 4), (400, 10_000)])
def test_sweep_equals_all_pairs(spark, n, steps, monkeypatch):
    """Every pair of observed values against every sample, few values and many; a task holds a few cells at a time."""
    monkeypatch.setattr(calibrate, "CELLS", 700)
    r = random.Random(n)
    rows = []
    for _ in range(n):
        score = r.randrange(1, steps + 1) / steps
        rows.append((score, min(score, r.randrange(steps + 1) / steps), r.random() < 0.4 + score / 2))
    df = spark.createDataFrame(rows, "score double, margin double, correct boolean")
    want = {}
    for s in {x[0] for x in rows}:
        for m in {x[1] for x in rows}:
            inside = [x[2] for x in rows if x[0] >= s and x[1] >= m]
            if len(inside) >= 5:
                k, c, p = len(inside), sum(inside), sum(inside) / len(inside)
                low = (p + 1.9208 / k - 1.96 * math.sqrt(p * (1 - p) / k + 0.9604 / (k * k))) / (1 + 3.8416 / k)
                if low >= 0.6:
                    want[s, m] = (k, c)
    got = calibrate.threshold_grid(df, 0.6, 5).collect()
    assert {(x["score"], x["margin"]): (x["support"], round(x["accuracy"] * x["support"])) for x in got} == want and len(got) == len(want)
    best = calibrate.best_threshold(calibrate.threshold_grid(df, 0.6, 5, best=True)).collect()
    top = sorted(want, key=lambda x: (-want[x][0], -want[x][1], *x))[:1]
    assert [(x["score"], x["margin"]) for x in best] == top


def test_tiers(spark):
    rows = [(0.9, 0.3, True)] * 20 + [(0.6, 0.1, i < 18) for i in range(20)] + [(0.3, 0.01, i < 5) for i in range(20)]
    r = calibrate.tiers(spark.createDataFrame(rows, "score double, margin double, correct boolean"), 0.80, 0.60).first()
    assert (r["high_support"], r["medium_support"]) == (20, 20)
    with pytest.raises(ValueError):
        calibrate.gated(Policy(), 0.6, 0.05)


def test_csv_and_store(spark, tmp_path):
    row = {c: "x" for c in feeds.RESULT} | {"published_at": None}
    df = spark.createDataFrame([tuple(row.values()), tuple((row | {"published_at": "2026", "title": "é,\n"}).values())], ", ".join(f"{c} string" for c in row))
    path = sinks.write_csv(df, str(tmp_path / "r.csv"))
    with open(path, encoding="utf-8-sig", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == feeds.RESULT and [r[3] for r in got[1:]] == ["2026", ""] and got[1][1] == "é,\n"
    with pytest.raises(FileNotFoundError):
        sinks.write_csv(df, str(tmp_path / "no" / "r.csv"))
    assert feeds.read_results(spark, str(tmp_path / "none.csv")).columns == feeds.RESULT
    store = sinks.Store(str(tmp_path / "store"))
    (tmp_path / "store").mkdir()
    store.save(df.withColumn("ord", F.lit(1).cast("long")))
    store.save(df.where("title = 'x'").withColumns({"ord": F.lit(1).cast("long"), "link": F.lit("new")}))
    assert {(r["title"], r["link"]) for r in store.load(spark).collect()} == {("x", "new"), ("é,\n", "x")}
    assert sorted(x.name for x in (tmp_path / "store" / "versions").iterdir() if not x.name.startswith(".")) == ["1.json", "2.json"]


def test_store_by_address(spark, tmp_path):
    """A store named by a URI, in a folder that is not there yet; rows that are lost on the way leave the version before."""
    store = sinks.Store((tmp_path / "a" / "b").as_uri())
    rows = spark.createDataFrame([("k", "x", "s", "one", 0)], "keyword string, title string, source string, link string, ord long")
    assert store.load(spark) is None
    store.save(rows.limit(0))
    assert store.load(spark) is None
    store.save(rows)
    with pytest.raises(Exception):
        store.save(rows.withColumn("link", F.raise_error(F.lit("lost"))))
    assert [(r["link"], r["batch_seq"]) for r in store.load(spark).collect()] == [("one", 1)]
    store.save(rows.withColumn("link", F.lit("two")))
    assert [(r["link"], r["batch_seq"]) for r in store.load(spark).collect()] == [("two", 2)]


def _batch(spark, keys, link):
    return spark.createDataFrame([("k", str(x), "s", f"{link}{i}", i) for i, x in enumerate(keys)], "keyword string, title string, source string, link string, ord long")


def _files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in (path / "data").rglob("*.parquet")}


def test_a_save_writes_what_its_rows_fall_in(spark, tmp_path):
    store = sinks.Store(str(tmp_path), buckets=16)
    assert store.save(_batch(spark, range(500), "a")) == 1 and len(store.manifest(spark)["at"]) == 16
    before, first = _files(tmp_path), store.manifest(spark)["at"]
    assert store.save(_batch(spark, [7, 7, 1000], "b")) == 2
    after, second = _files(tmp_path), store.manifest(spark)["at"]
    changed = {b for b in second if second[b] != first[b]}
    assert 1 <= len(changed) <= 2 and len(set(after) - set(before)) <= 2 and all(after[f] == t for f, t in before.items())  # nothing else was touched
    got = {r["title"]: r["link"] for r in store.load(spark).collect()}
    assert len(got) == 501 and got["7"] == "b1" and got["1000"] == "b2" and got["8"] == "a8"  # the last of a batch counts
    assert {r["title"]: r["link"] for r in store.load(spark, 1).collect()}["7"] == "a7"  # the version before can still be read
    assert store.save(_batch(spark, [7], "c")) == 3 and store.versions(spark) == [2, 3] and all((tmp_path / p).exists() for v in (2, 3) for p in store.manifest(spark, v)["at"].values())
    assert sum(p.is_dir() for p in (tmp_path / "data").glob("*/bucket=*")) == len({p for v in (2, 3) for p in store.manifest(spark, v)["at"].values()})


def test_of_two_writers_one_loses(spark, tmp_path):
    store = sinks.Store(str(tmp_path), buckets=4)
    store.save(_batch(spark, range(10), "a"))
    seen = store.manifest(spark)
    assert sinks.Store(str(tmp_path)).save(_batch(spark, [1], "b"), on=seen) == 2  # the number of buckets is the store's
    with pytest.raises(sinks.StoreConflict):
        store.save(_batch(spark, [1, 2], "c"), on=seen)
    got = {r["title"]: r["link"] for r in store.load(spark).collect()}
    assert got["1"] == "b0" and got["2"] == "a2" and store.versions(spark) == [1, 2] and len(list((tmp_path / "data").iterdir())) == 2
    assert store.save(_batch(spark, [1, 2], "c")) == 3 and store.load(spark).where("title = '2'").first()["link"] == "c1"


def test_feed(spark, tmp_path):
    item = "<item><title>T{0} &amp;amp; x</title><link>http://a.example/{0}</link><pubDate>Sun, 04 Oct 2026 10:00:00 GMT</pubDate><source url='u'>S</source><description>&lt;b&gt;two words&lt;/b&gt;</description></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format(1) + "<item><title>no link</title></item>" + item.format(2) + item.format(3) + "</channel></rss>")
    got = feeds.read_feed(spark, str(tmp_path / "f.xml"), "k", 3).collect()
    assert [(r["title"], r["published_at"], r["source"], r["description"]) for r in got] == [(f"T{i} & x", "2026-10-04T10:00:00+00:00", "S", "two words") for i in (1, 2)]
    (tmp_path / "bad.xml").write_text("<html></html>")
    with pytest.raises(feeds.FeedError):
        feeds.read_feed(spark, str(tmp_path / "bad.xml"), "k")


def test_gates(spark, tmp_path):
    rows = [("1", "development", "k", "t1", "d", "a", "confirmed", "me"), ("2", "development", "k", "t2", "d", "b", "confirmed", "me")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in governance.CASE_COLUMNS))
    assert governance.require_cases(df, "development", ["a", "b"]).count() == 2
    for labels, frame in ((["a", "b", "c"], df), (["a", "b"], df.union(df.limit(1)))):
        with pytest.raises(governance.Rejected):
            governance.require_cases(frame, "development", labels)
    path = str(tmp_path / "p.json")
    governance.write_new_json(path, {"a": 1})
    with pytest.raises(FileExistsError):
        governance.write_new_json(path, {})
    governance.replace_json(path, {"b": 2})
    with pytest.raises(ValueError):
        governance.replace_json(path, {"b": float("nan")})


def test_first_of_each(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "m"), ("", 9, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string").select("v", "k", "o").repartition(3)
    got = audit.first_of_each(df, ["k"], ["o"])
    assert got.columns == ["v", "k", "o"] and sorted(map(tuple, got.collect()), key=str) == sorted([("y", "a", 1), ("m", None, 4), (None, "", 9)], key=str)
    assert audit.first_of_each(df.where("false"), ["k"], ["o"]).count() == 0


def test_round_robin(spark):
    def picked(rows, target=10):
        df = spark.createDataFrame(rows, "query_ord int, place int, event_id string")
        return [r["event_id"] for r in feeds.round_robin(df, 40, target).orderBy("turn", "query_ord").collect()]

    assert picked([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "d")]) == ["a", "c", "d", "b"]
    r = random.Random(2)
    rows = [(q, k, f"e{r.randrange(40)}") for q in range(6) for k in range(r.randrange(12))]
    queues, seen, want = {q: [e for p, _, e in rows if p == q] for q in range(6)}, set(), []
    while any(queues.values()):  # a plain loop: each query gives its first event that was not met
        for queue in queues.values():
            while queue:
                e = queue.pop(0)
                if e not in seen:
                    seen.add(e)
                    want.append(e)
                    break
    assert picked(rows, 100) == want and picked(rows, 7) == want[:7]
