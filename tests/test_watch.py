"""Listings of trees in tasks, changes between manifests, and what a rescan replaces."""

import os

import pytest

from wirechart.sources import files as sources
from wirechart.streaming import watch as W


def tree(root, names):
    for name in names:
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)
    return root


@pytest.mark.parametrize("parts,looks", [(256, 4096), (3, 4096), (256, 5), (1, 1)])
def test_trees_are_listed_once_whatever_the_parts(tmp_path, monkeypatch, parts, looks):
    names = [f"{a}/{b}/f{i}.py" for a in "abc" for b in "xyz" for i in range(3)] + ["top.py", "a/m.py", ".hid/_n.py"]
    root = tree(tmp_path / "r", [*names, "dist/no.py", "a/vendor/no.py"])
    (root / "link").symlink_to(root / "a")
    monkeypatch.setattr(sources, "PARTS", parts)
    monkeypatch.setattr(sources, "LOOKS", looks)
    reader = sources._Names(sources.options_of({"s": str(root), "t": str(root)}, r"\.py$"))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted((r[0], r[2]) for r in rows) == sorted((s, n) for s in "st" for n in names)
    assert all(r[3] == len(r[2]) and r[5] is None for r in rows)
    assert len(reader.partitions()) <= max(parts, 1)


def test_a_missing_root_is_a_row_with_an_error(spark, tmp_path):
    root = tree(tmp_path / "r", ["a.py"])
    found = {(r.service, r.path): r for r in sources.source_files(spark, {"s": str(root), "gone": str(tmp_path / "gone")}, r"\.py$").collect()}
    assert set(found) == {("s", "a.py"), ("gone", ".")}
    assert found["s", "a.py"].content == "a.py" and found["gone", "."].error.startswith("FileNotFoundError")


def test_changes_between_manifests(spark):
    form = "service string, path string, bytes bigint, modified_ns bigint"
    before = spark.createDataFrame([("s", "same", 1, 5), ("s", "older", 1, 5), ("s", "size", 1, 5), ("s", "gone", 1, 5), ("t", "same", None, None)], form)
    after = spark.createDataFrame([("s", "same", 1, 5), ("s", "older", 1, 4), ("s", "size", 2, 5), ("t", "new", 3, 9), ("t", "same", None, None)], form)
    rows = sorted(tuple(r) for r in W.changed_files(before, after).collect())
    assert rows == [("s", "gone", "removed", 1, 5), ("s", "older", "altered", 1, 4), ("s", "size", "altered", 2, 5), ("t", "new", "added", 3, 9)]
    assert W.changed_files(before, before).isEmpty()


def test_a_burst_ends_with_two_equal_listings(spark, tmp_path):
    a, b = tree(tmp_path / "a", ["x.py", "y.py"]), tree(tmp_path / "b", ["z.py"])
    held, calls, count = W.Manifests(spark, f"file://{tmp_path}/m"), [], iter(range(99))

    def turn(**over):
        listing = sources.source_names(spark, {"a": str(a), "b": str(b)}, W.SOURCES)
        return W.settle(held, over.get("listing", listing), next(count), over.get("since", 1 << 62), lambda _, s: calls.append(s))

    assert turn() == [] and turn() == []  # what was there is known
    (a / "y.py").unlink()
    assert turn() == []  # a change, but the burst may go on
    os.utime(b / "z.py", (1, 1))  # to an older time
    assert turn() == []
    assert turn() == ["a", "b"] and turn() == []
    (a / "x.py").rename(a / "w.py")
    turn()
    # a turn that failed after its rescan is made again
    n = next(count)
    listing = sources.source_names(spark, {"a": str(a), "b": str(b)}, W.SOURCES)

    def fails(_, services):
        calls.append(services)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        W.settle(held, listing, n, 0, fails)
    assert W.settle(held, listing, n, 0, lambda _, s: calls.append(s)) == ["a"]
    assert calls == [["a", "b"], ["a"], ["a"]]
    # a tree that can't be listed says nothing about its files; one that is gone has none
    rows = spark.createDataFrame([("a", "r", "sub", None, None, "PermissionError: no"), ("b", "r", ".", None, None, "FileNotFoundError: no")], sources.NAMES)
    turn(listing=rows)
    assert turn(listing=rows) == ["b"]
    assert turn() == [] and turn() == ["b"]


def test_only_changed_services_are_replaced(spark, tmp_path):
    from wirechart.streaming.refresh import replace, stored

    at = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "service string, n int")
    replace(rows(("1", 1), ("b", 2), ("b", 3), ("x", 9)), ["1", "b"], at)
    assert sorted((r.service, r.n) for r in stored(spark, at).collect()) == [("1", 1), ("b", 2), ("b", 3)]
    replace(rows().withColumn("more", __import__("pyspark").sql.functions.lit("m")), ["b"], at)
    assert sorted((r.service, r.n) for r in stored(spark, at).collect()) == [("1", 1)]
    replace(spark.createDataFrame([("c", 4, "y")], "service string, n int, more string"), ["c"], at)
    assert sorted((r.service, r.n, r.more) for r in stored(spark, at).collect()) == [("1", 1, None), ("c", 4, "y")]


def test_a_refresh_equals_a_scan(spark, tmp_path):
    import wirechart

    shop, stock = tmp_path / "shop", tmp_path / "stock"
    shop.mkdir(), stock.mkdir()
    (shop / "requirements.txt").write_text("fastapi")
    (shop / "main.py").write_text("@app.get('/carts')\ndef carts():\n    return requests.get('http://stock/items')\n")
    (stock / "requirements.txt").write_text("fastapi")
    (stock / "main.py").write_text("@app.get('/items')\ndef items():\n    return 1\n")
    roots, out = {"shop": str(shop), "stock": str(stock)}, f"file://{tmp_path}/out"
    tables = wirechart.refresh(spark, roots, ["shop", "stock"], out)
    assert [(r.from_service, r.to_service, r.to_endpoint) for r in tables["edges"].collect()] == [("shop", "stock", "GET /items")]
    (stock / "main.py").write_text("@app.get('/items')\ndef items():\n    return 1\n@app.post('/items')\ndef more():\n    return 1\n")
    (shop / "main.py").unlink()
    tables = wirechart.refresh(spark, roots, ["stock"], out)
    assert sorted((r.service, r.method) for r in tables["endpoints"].collect()) == [("shop", "GET"), ("stock", "GET"), ("stock", "POST")]
    tables = wirechart.refresh(spark, roots, ["shop"], out)
    scanned = wirechart.scan(spark, roots)
    for name in ("endpoints", "calls", "edges"):
        assert tables[name].count() == scanned[name].count()
    assert {r.service for r in tables["endpoints"].collect()} == {"stock"} and tables["edges"].isEmpty()
