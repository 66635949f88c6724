"""URL rules and the cascade of Bloom filters under them, against plain versions."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetbooks.llm import cascade, urlfilter

RULE = "host string, path string, verdict string"


def plain(url, rules, otherwise="allow"):
    """Host, path, rule and verdict by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    best = None
    for h, p, v in rules:
        if not h or v not in ("allow", "block"):
            continue
        p = p or ""
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, v))
    return (host, path, best[2], best[3]) if best else (host, path, None, otherwise)


def rows(found):
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found.orderBy("id").collect()]


@pytest.mark.parametrize("seed, part_bytes", [(1, 8_000_000), (2, 40)])
def test_rules_against_all_of_them(spark, seed, part_bytes):
    draw = random.Random(seed)
    label = lambda: draw.choice(["a", "b", "c", "org", "net", ""])
    host = lambda most: ".".join(label() for _ in range(draw.randint(1, most)))
    path = lambda most: "".join(draw.choice("/ab") for _ in range(draw.randint(0, most)))
    rules = {(host(3), path(3)): draw.choice(["allow", "block"]) for _ in range(120)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host(5).upper()}/{path(5)}{draw.choice(['', '?q=/a', '#/b', '/?x#y'])}" for _ in range(400)]
    urls += [f"x://{host(4)}{draw.choice(['', '?a/b', '#c'])}" for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    fitted = urlfilter.fit(spark.createDataFrame(rules, RULE), frame, part_bytes=part_bytes)
    assert (len(fitted.parts) > 1) == (part_bytes < 1000)
    assert rows(urlfilter.judge(frame, fitted)) == [plain(u, rules) for u in urls]


def test_odd_rows_and_rules(spark):
    odd = [
        None, "", "no scheme", "://", "http://", "http:///fr/1", "HTTP://EXAMPLE.COM", "http://example.com/FR/x",
        "http://x.com/fr/", "http://com/fr/1", "http://xcom/fr/1", "a://b://com/fr/", "http://a.com:80/fr/",
        "http://u@com/fr/", "http://x.com/fr/", "http://\u00c4.com/fr/\u00e4?\u00fc", "http://" + "a." * 50_000 + "com/fr/" + "x" * 200_000,
        "http://x.com/fr", "http://a.com/de/x\ny#z", "http://com./fr/",
    ]
    rules = [
        ("COM", "/fr/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "/", "allow"),
        (None, "/", "block"), ("", "/", "block"), ("com", "/x", None), ("com", "/fr/1", "maybe"), ("u@com", None, "block"),
        ("co", "m/fr/", "block"), ("com/fr", "/", "block"), ("a.com", "/x?y", "block"),
    ]
    lower = [((h or "").lower(), p, v) for h, p, v in rules if (h, v) != ("com", "allow")]
    frame = spark.createDataFrame(
        [(i, u, "x", 1, "rule") for i, u in enumerate(odd)], "id long, url string, host string, verdict long, key string"
    )
    found = urlfilter.judge(frame, urlfilter.fit(spark.createDataFrame(rules, RULE), frame), otherwise="block")
    assert found.columns == ["id", "url", "key", "host", "path", "rule", "verdict"]
    assert rows(found) == [plain(u, lower, "block") for u in odd]
    assert {r["key"] for r in found.collect()} == {"rule"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], RULE)
    assert urlfilter.judge(none, urlfilter.fit(rules, none)).collect() == []
    some = spark.createDataFrame([(1, "http://com/"), (1, "http://com/")], "id long, url string")
    assert rows(urlfilter.judge(some, urlfilter.fit(rules.limit(0), some))) == [("com", "/", None, "allow")] * 2


def _keyed(spark, low, high):
    keys = spark.range(low, high).select(F.col("id").cast("string").alias("key"))
    return keys.select("key", *cascade.hashes(F.col("key")))


def _hashes(df):
    found = df.select("a", "b").toPandas()
    return tuple(found[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))


def test_cascade_is_exact_over_its_universe(spark):
    universe, listed = _keyed(spark, 0, 60_000), _keyed(spark, 59_000, 61_000)
    levels = cascade.build(listed, universe.union(universe.limit(500)), 60_000)
    # Odd levels hold listed keys, even ones the others; each is smaller than the one before it on its side.
    assert len(levels) > 4 and [x[0] for x in levels] == list(range(1, len(levels) + 1))
    assert cascade.is_listed(levels, *_hashes(listed)).all()
    assert not cascade.is_listed(levels, *_hashes(_keyed(spark, 0, 59_000))).any()
    # About log2 of universe to listed, and a few bits more, for each listed key.
    assert sum(bits for _, bits, _, _ in levels) < 2_000 * 16


def test_cascade_of_nothing_and_of_all(spark):
    some = _keyed(spark, 0, 100)
    assert cascade.build(some.limit(0), some, 100) == []
    assert not cascade.is_listed([], *_hashes(some)).any()
    assert cascade.is_listed(cascade.build(some, some, 100), *_hashes(some)).all()


def test_equal_hashes_of_two_keys_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(cascade, "MOST_LEVELS", 4)
    listed = spark.createDataFrame([("x", 1, 2)], "key string, a long, b long")
    universe = spark.createDataFrame([("x", 1, 2), ("y", 1, 2)], "key string, a long, b long")
    with pytest.raises(ValueError, match="128 bits"):
        cascade.build(listed, universe, 2)
