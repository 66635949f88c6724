"""Main text of pages, nearest neighbours, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetbooks.llm import ann, extract, wrappers

URL = "https://news.example.org/a/1"


def page(body, nav="Home", extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a='</p>';</script></head><body>"
        f"<header>Site</header><nav><ul><li><a href='/x'>{nav}</a></li><li>More</li></ul></nav>"
        f"<div class=\"top ad\">Buy <b>now</b></div><article>{body}</article>{extra}"
        f"<aside>Side</aside><form><input name=q>Search</form><div id='comments'><p>First!</p></div><footer>&copy; 2024</footer></body></html>"
    )


def texts(spark, rows):
    df = spark.createDataFrame([(k, u, h, 1, "x") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host int, text string")
    found = extract.extract(df)
    assert found.columns == ["page_id", "url", "text"]
    return {r["page_id"]: r["text"] for r in found.collect()}


def test_articles(spark):
    bodies = [
        "<h1>Title &amp; more</h1><p>One   two\n three</p><p>Four<br>five</p>",
        "<h1>Other</h1><p><b>Bold <i>text</i>.<br><p>Next &lt;b&gt; &#233; &nbsp; end</p><ul><li>a<li>b</ul>",
        "<header><h1>Inside</h1></header><div>Plain<div>deep</div>after</div><table><tr><td>c<td>d</table>",
        "<p>Short</p><div class='share-box'>Share</div><script>x</script><!-- <p>no</p> --><p>End",
    ]
    want = [
        "Title & more\nOne two three\nFour five",
        "Other\nBold text.\nNext <b> é end\na\nb",
        "Inside\nPlain\ndeep\nafter\nc\nd",
        "Short\nEnd",
    ]
    found = texts(spark, [(URL, page(b, nav=f"n{k}")) for k, b in enumerate(bodies)])
    assert found == dict(enumerate(want))


def test_broken_and_odd_pages(spark):
    rows = [
        (URL, None),
        (None, ""),
        ("no address", "just text & more <3"),
        (URL, page("<p>cut off")[:-40] + "<foo"),
        (URL, "<article><p>a</p>" + "<div>" * 3000 + "deep"),
        (URL, "<p>x</p" + "<p class='a\">y"),
        ("https://b.example.org", "<nav>menu</nav><p>No article here.</p><footer>f</footer>"),
        (URL, "<nav><ul><li>open menu<article><p>after</p></article>"),
    ]
    found = texts(spark, rows)
    assert (found[0], found[1], found[2]) == ("", "", "just text & more <3")
    assert found[3] == "cut off" and found[4] == "a\ndeep"
    assert found[6] == "No article here." and found[7] == "after"
    assert texts(spark, []) == {}


def test_names_of_elements(spark):
    rows = [
        (URL, "<body class='has-sidebar nav'><article class='with-comments'><p>a <span class=share>Share</span> b</p></article>"),
        ("https://c.example.org", "<div class='page with-sidebar'><p>kept</p><div class='left-sidebar'>no</div><p>too</p></div>"),
        ("https://d.example.org", "<div role='navigation'>no</div><p>x <a class='ad-link' href=#>ad</a>y</p><p id='cookie-notice'>no</p>"),
        ("https://e.example.org", "<nav>only a menu</nav><div class=ad>advert</div>"),
    ]
    assert texts(spark, rows) == {0: "a b", 1: "kept\ntoo", 2: "x y", 3: ""}


NAMES_OF_THEIR_OWN = ["related-work", "share-price", "social-policy", "menu-of-the-day", "comment-period", "notice-of-appeal", "ad-hoc"]
BOXES = ["ad", "related-posts", "share-buttons", "comment-list", "cookie-notice", "newsletter-box", "social", "ad_slot_2"]


def test_names_inside_an_article(spark):
    """One part of a name says little there; a name made of such words and of boxes does."""
    kept = [page(f"<p>a</p><div class='{name}'><p>{name}</p></div><p>b</p>") for name in NAMES_OF_THEIR_OWN]
    gone = [page(f"<p>a</p><div class='{name}'><p>{name}</p></div><p>b</p>") for name in BOXES]
    loose = page("<p>a <label>l</label> <button>x</button> <object>o</object></p><form><label>no</label></form>")
    found = texts(spark, [(URL, x) for x in (*kept, *gone, loose)])
    assert [found[k] for k in range(len(kept))] == [f"a\n{name}\nb" for name in NAMES_OF_THEIR_OWN]
    assert {found[len(kept) + k] for k in range(len(gone))} == {"a\nb"}
    assert found[len(kept) + len(gone)] == "a l x o"


def test_copies_and_long_pages(spark):
    long_ = "".join(f"<p>Paragraph {k} of it.</p>" for k in range(3000))
    found = texts(spark, [(URL, page(long_)), (URL, page(long_)), (URL, page("<p>a</p>"))])
    want = "\n".join(f"Paragraph {k} of it." for k in range(3000))
    assert found == {0: want, 1: want, 2: "a"}


def test_fixed_text_of_a_host_goes(spark):
    rows = [(URL, f"<body><p>Welcome to this site</p><h2>Story {k}</h2><p>Text {k}</p><p>and {k}</p></body>") for k in range(5)]
    found = texts(spark, rows)
    assert found == {k: f"Story {k}\nText {k}\nand {k}" for k in range(5)}


def test_fixed_text_inside_an_article_stays(spark):
    body = "<h1>Story {0}</h1><p>Text {0}</p><h2>Background</h2><blockquote>The same words</blockquote><p>End {0}</p>"
    found = texts(spark, [(URL, page(body.format(k))) for k in range(5)])
    assert found == {k: f"Story {k}\nText {k}\nBackground\nThe same words\nEnd {k}" for k in range(5)}


@pytest.mark.parametrize("copies", [1, 2, 3, 4])
def test_copies_of_a_page_with_a_layout_of_its_own(spark, copies):
    rows = [(URL, f"<body><h2>Story {k}</h2><p>Text {k}</p><p>and {k}</p></body>") for k in range(6)]
    rows += [(URL, "<body><h2>Own</h2><p>One</p><blockquote>Only here</blockquote><p>Two</p></body>")] * copies
    found = texts(spark, rows)
    assert {found[6 + k] for k in range(copies)} == {"Own\nOne\nOnly here\nTwo"}


def test_wrapper_has_optional_and_repeated():
    pages = [
        "<article><h1>a</h1><p>b</p></article>",
        "<article><h1>c</h1><p>d</p><p>e</p></article>",
        "<article><h1>f</h1><ul><li>g</li><li>h</li></ul><p>i</p></article><footer>z</footer>",
    ]
    whole = None
    for text in pages:
        own = [item for item, _ in wrappers.squashed(wrappers.stream(text))]
        whole = own if whole is None else wrappers.merged(whole, own)
    marks = {x.token: (x.optional, x.repeated) for x in whole}
    assert marks["#h1"] == (False, False) and marks["#p"] == (False, True)
    assert marks["#li"] == (True, True) and marks["#footer"] == (True, False)
    assert wrappers.loaded(wrappers.dumped(whole)) == whole


def test_groups_repeat():
    items = wrappers.squashed(wrappers.stream("<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"))
    assert [(x.token, x.repeated) for x, _ in items] == [("(#dt #dd)", True)]
    assert [t for _, own in items for _, t in own] == ["a", "b"] * 3


def vectors(n, d, seed, hot=0.3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)).astype(np.float32)
    x[draw.random(n) < hot] = x[0]
    return x


def nearest(spark, rows, k=10, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, list int")
    found = ann.nearest(df, df.filter("vec_id % 100 = 0"), k, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def brute(rows, k=10):
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x[q] - x) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_neighbours_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 300)
    monkeypatch.setattr(ann, "QUERIES", 5)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(3000, 40, 1))]
    found, want = nearest(spark, rows), brute(rows)
    assert set(found) == set(want)
    right = total = 0
    for q, own in want.items():
        right += len({i for i, _ in own} & {i for i, _ in found[q]})
        total += len(own)
        assert [s for _, s in found[q]] == sorted(s for _, s in found[q]) and len(found[q]) == 10
    assert right / total >= 0.9
    # A query that equals a third of all vectors gets the smallest ids, at no distance.
    assert found[0] == want[0]


def test_all_when_few(spark):
    rows = [(i * 50, v.tolist()) for i, v in enumerate(vectors(6, 5, 2, hot=0))]
    found, want = nearest(spark, rows), brute(rows)
    assert {q: [i for i, _ in own] for q, own in found.items()} == {q: [i for i, _ in own] for q, own in want.items()}
    assert all(s == pytest.approx(w, abs=1e-12) for q in want for (_, s), (_, w) in zip(found[q], want[q]))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0])]
    rows += [(None, [1.0, 0.0]), (100, None), (200, []), (7, [1.0, 1.0, 1.0]), (300, [5.0, 5.0, 5.0])]
    rows += [(8, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [9.0, 9.0])]  # one id, the nearest counts
    found = nearest(spark, rows)
    assert found == {0: [(1, 1.0), (8, 1.0)], 300: [(7, pytest.approx(48**0.5))]}
    assert nearest(spark, [(1, [1.0])]) == {} and nearest(spark, []) == {} and nearest(spark, [(0, [1.0])]) == {}


@pytest.mark.parametrize("times", [2, 3])
def test_repeated_rows_take_one_place(spark, times):
    rows = [(i * 20, v.tolist()) for i, v in enumerate(vectors(35, 24, 5, hot=0))]
    assert nearest(spark, rows * times) == nearest(spark, rows)
    found, want = nearest(spark, rows * times), brute(rows)
    assert {q: [i for i, _ in own] for q, own in found.items()} == {q: [i for i, _ in own] for q, own in want.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_many_as_asked_for_among_small_lists(spark, seed):
    """Clusters of three, far from clusters of 66: the nearest lists hold too few."""
    draw = np.random.default_rng(seed)
    sizes = [66] * 60 + [3] * 13
    centres = draw.normal(size=(len(sizes), 32)) * 100
    x = np.concatenate([c + draw.normal(size=(n, 32)) * 0.1 for c, n in zip(centres, sizes)])
    # Queries are dealt so that small clusters have some.
    ids = draw.permutation(len(x))
    ids[np.flatnonzero(np.arange(len(x)) >= 60 * 66)[::4]] = 100 * (10_000 + np.arange(10))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x.astype(np.float32))]
    found, want = nearest(spark, rows), brute(rows)
    assert {len(own) for own in found.values()} == {10} and set(found) == set(want)
    right = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert right / (10 * len(want)) >= 0.9


def test_lists_probed_until_they_hold_enough(spark):
    far = np.array([[1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]])
    query, place = ann._probed(far, 1, np.array([2, 0, 5, 9]), 3)
    assert list(zip(query.tolist(), place.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 3)]
    # One id in several lists is one neighbour.
    rows = [(0, [0.0, 1.0])] + [(7, [10.0 * k, 1.0]) for k in range(1, 200)] + [(20 + k, [5000.0 + k, 1.0]) for k in range(15)]
    assert [i for i, _ in nearest(spark, rows)[0]] == [7, *range(20, 29)]


def test_neighbours_far_from_the_origin(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (1e4 + 1e-4 * v).tolist()) for i, v in enumerate(draw.normal(size=(2000, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows)
    assert sum(len(out[q] & {i for i, _ in own}) for q, own in want.items()) / (10 * len(want)) >= 0.9


def test_one_id_with_many_near_vectors(spark):
    # Fifteen different vectors of one id lie nearer than all others.
    rows = [(0, [1.0, 0.0]), *((7, [1.0, 0.01 * (k + 1)]) for k in range(15)), *((20 + k, [2.0 + k, 0.0]) for k in range(12))]
    found = nearest(spark, rows)
    assert [i for i, _ in found[0]] == [7, *range(20, 29)]
    assert found[0][0] == (7, pytest.approx(0.01))


def test_scan_counts_ids():
    x = vectors(600, 32, 6, hot=0).astype(np.float64)
    ids = np.concatenate([np.arange(100), np.full(500, 100)])
    x[100:] = x[0] + 0.001 * x[100:]
    a, b = ann.scan(x[:1], x, np.eye(32), 11, ids)
    near = sorted(range(100), key=lambda j: ((x[j] - x[0]) ** 2).sum())[:10]
    assert set(near) | {100} <= set(ids[b].tolist())


def test_scan_drops_only_far_ones():
    x = vectors(2000, 64, 3, hot=0).astype(np.float64)
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(64, 64)))[0]
    q, right = x[:50], 0
    a, b = ann.scan(q, x, turn, 11)
    for k in range(50):
        near = set(np.argsort(((x - q[k]) ** 2).sum(axis=1))[:11].tolist())
        right += len(near & set(b[a == k].tolist()))
    assert right >= 0.97 * 50 * 11
    assert len(a) < 0.5 * 50 * 2000


def test_pipeline_stages(spark, frame):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "tokens"]
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    draw = random.Random(1)
    extra = [(10_000 + k, " ".join(f"w{draw.randrange(900)}" for _ in range(60))) for k in range(3)]
    extra += [(10_010, extra[0][1]), (10_011, None), (None, "a row without an id and a few words")]
    columns = docs.columns
    docs = docs.unionByName(frame(extra).select(columns))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left[name] <= before
        if name != "tokens":
            assert docs.columns == columns
    clean = {10_000, 10_001, 10_002, None}
    assert all(clean <= kept for kept in left.values())
    assert left["line_dedup"] == left["toxicity"] and left["tokens"] == left["decontamination"]
    assert 10_010 not in left["near_dedup"] or 10_011 not in left["near_dedup"]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_keeps_clashing_columns(spark, frame):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    line = "these are five words here"
    docs = frame([(1, f"{line}\nand {k} more") for k in range(2)] + [(2, f"{line}\nown"), (3, None)]).withColumn("n_lines", F.lit(77))
    found = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert found.columns == docs.columns
    assert {(r["n_lines"], r["n_removed"]) for r in found.collect()} == {(77, 6)}
    assert {r["text"]: r["n_chars"] for r in found.filter("doc_id > 1").collect()} == {"own": 3, None: None}


def test_pipeline_of_an_empty_table(spark, frame):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame([])
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.collect() == [] and (name == "tokens" or docs.columns == before)
