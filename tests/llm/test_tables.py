"""Vector, url, archive and mixing operators."""

import hashlib
import base64

import numpy as np
from pyspark.sql import functions as F

from mzframe.llm import common, mtree, multi_index, raking, url_filter, warc


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, rank int").repartition(3)


def clustered(rng, groups=6, size=9, dim=16):
    rows, k = [], 0
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(size):
            v = base + rng.normal(size=dim) * rng.choice([0.05, 0.15, 1.0])
            rows.append((k, v.astype("float32").tolist(), int(g % 2), 1, 2))
            k += 1
    return rows


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = clustered(rng)
    rows += [(100, rows[0][1], rows[0][2], 1, 2), (101, rows[0][1], 1 - rows[0][2], 1, 2), (102, None, 0, 1, 2), (103, [0.0] * 16, 0, 1, 2), (104, [float("nan")] * 16, 0, 1, 2), (105, rows[0][1], None, 1, 2), (106, rows[0][1][:3] + [None], 0, 1, 2), (107, rows[0][1][:4], 0, 1, 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_duplicates(vectors(spark, rows), codewords=4, block=4).collect()}
    fine = [r for r in rows if r[0] < 102 or r[0] == 107]
    links = {r[0]: set() for r in rows}
    for a in fine:
        for b in fine:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], "float32").astype(float), np.array(b[1], "float32").astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a[0]].add(b[0])

    def reach(k):
        seen, todo = {k}, [k]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        return min(seen)

    want = {k: (len(v), reach(k), reach(k) == k) for k, v in links.items()}
    assert sum(a == b for a, b in zip((got[k] for k in sorted(got)), (want[k] for k in sorted(want)), strict=True)) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in range(102, 108))
    assert multi_index.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_links_of_many_vectors_at_the_threshold_are_found_with_production_parameters(spark):
    """Pairs of cosine 0.93 to 0.97 beside each other, a group of copies with noise, and vectors of other lengths."""
    rng = np.random.default_rng(11)
    base = multi_index.units(list(rng.normal(size=(900, 32))))
    rows = []
    for k, x in enumerate(base):
        noise = rng.normal(size=32)
        noise -= (noise @ x) * x
        c = rng.uniform(0.931, 0.97)
        rows += [x, c * x + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)]
    rows += [base[0] + 0.02 * rng.normal(size=32) for _ in range(300)]
    table = [(i, r.astype("float32").tolist(), 1, 1, 2) for i, r in enumerate(rows)] + [(10_000 + d, [1.0] * d, 1, 1, 2) for d in range(1, 30)] + [(20_000 + d, [2.0] * d, 1, 1, 2) for d in range(1, 30)]
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(vectors(spark, table), sample_rows=500, block=64).collect()}
    x = multi_index.units([np.array(r[1], "float32").astype(float) for r in table[: len(rows)]])
    want = ((x @ x.T) >= 0.93).sum(1) - 1
    assert sum(got[i] for i in range(len(rows))) >= 0.97 * want.sum() and all(got[i] <= w for i, w in enumerate(want))
    assert all(got[10_000 + d] == got[20_000 + d] == 1 for d in range(1, 30))


def test_traversal_meets_its_target_recall():
    rng = np.random.default_rng(2)
    x = multi_index.units(list(rng.normal(size=(2000, 32))))
    grid = multi_index.fit(x[:1500], 0.93, 24, 0.95)
    noise = rng.normal(size=(500, 32))
    noise -= (noise * x[1500:]).sum(1, keepdims=True) * x[1500:]
    y = 0.93 * x[1500:] + np.sqrt(1 - 0.93**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    cells, visits = grid.cell(y), grid.visits(x[1500:])
    assert np.mean([c in v for c, v in zip(cells, visits, strict=True)]) > 0.9
    assert all(own == v[0] for own, v in zip(grid.cell(x[1500:]), visits, strict=True))
    assert (grid.reaches(x[1500:], cells) == [c in v for c, v in zip(cells, visits, strict=True)]).all()


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 8, 30, 8)
    rows += [(300 + k, rows[0][1], 0, 1, 2) for k in range(60)] + [(400, None, 0, 1, 2), (401, [float("inf")] * 8, 0, 1, 2), (402, rows[0][1][:2], 0, 1, 2), (450, rows[1][1][:2], 0, 1, 2)]
    got = {}
    for r in mtree.top_k(vectors(spark, rows), k=5, every=10, shard_rows=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scaled = {r[0]: [int(np.floor(256 * float(np.float32(x)))) for x in r[1]] for r in rows if r[0] not in (400, 401)}
    want = {}
    for q, v in scaled.items():
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), o) for o, w in scaled.items() if o != q and len(w) == len(v))
            want[q] = [(k + 1, o, -s) for k, (s, o) in enumerate(scores[:5])]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert mtree.top_k(vectors(spark, rows).limit(0)).count() == 0


def test_tree_over_many_equal_vectors():
    v = np.tile(np.array([[3.0, 4.0]]), (1000, 1))
    ids = np.arange(1000)[::-1].copy()
    root = mtree.build(v, (v * v).sum(1), ids, v[0])
    assert mtree.search(root, v[0], v[0], 0, 3) == [(25, 1), (25, 2), (25, 3)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    ("http://a.COM/x", "a.com", "/x", "com/", "allow"), ("https://www.example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/2", "m.example.com", "/en/2", "example.com/en/", "block"), ("ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"), ("http://b.net/esx", "b.net", "/esx", None, None),
    ("http://a.com", "a.com", "", None, None), ("http://a.com?x/y", "a.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("://", "", "", None, None), ("x://y://z/p", "y:", "//z/p", None, None),
    ("http://ÄB.com/\n/e?", "Äb.com", "/\n/e", "com/", "allow"),
]


def test_url_rules(spark):
    from mzframe.llm.queries import URL_RULES

    df = spark.createDataFrame([(i, u[0], "<p>the cat sat</p>", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, html string, score double")
    got = {r["page_id"]: r for r in url_filter.judge(df, URL_RULES, url_filter.fit(df)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in (("allow", "block") if verdict is None else (verdict,))
    empty = df.limit(0)
    assert url_filter.judge(empty, URL_RULES, url_filter.fit(empty)).count() == 0


def test_host_segmentation_and_bayes(spark):
    html = "<p>" + "cheap pills casino best garden tools house of books " * 50 + "</p>"
    bad = [f"http://cheappillscasino{k}.example.org/buy/pills" for k in range(20)]
    good = [f"http://bestgardentools{k}.example.org/house/books" for k in range(60)]
    df = spark.createDataFrame([(i, u, html) for i, u in enumerate(bad + good)], "page_id long, url string, html string")
    model = url_filter.fit(df)
    assert model.segment("bestgardentools") == ["best", "garden", "tools"] and model.segment("") == []
    unseen = spark.createDataFrame([(1, "http://bestpills.example.org/buy", ""), (2, "http://gardenbooks.example.org/house", "")], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(unseen, [], model).collect()} == {1: "block", 2: "allow"}


def test_models_keep_rare_words_and_tokens(spark):
    common_ = [f"{a}{b}{c}q{d}" for a in "bcdfghjklmnprstvwx" for b in "aeiouy" for c in "bcdfghjklmnprstvwxz" for d in "aeioubcdfghjklmnprstvwxyz"][:50_001]
    rows = [(i, f"http://gardentools.example.org/{w}/{w}", f"<p>{w} {w}</p>") for i, w in enumerate(common_ + common_[:10_000])]
    rows.append((-1, "http://zebrafish.example.org/oncehere", "<p>zebra fish</p>"))
    model = url_filter.fit(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    assert model.segment("zebrafish") == ["zebra", "fish"]
    assert model.tokens.where("token in ('p:oncehere', 'h:zebra')").count() == 2


def test_archives_round_trip(spark):
    rows = [(3, "http://a/1?x", "<p>é</p>"), (1, "http://a/2", "<p>é</p>"), (2, None, None), (4, "http://a/\r\nX: y", ""), (5, "http://b", "WARC/1.1\r\n\r\nend\r\n\r\n"), (6, "http://b", "x" * 300_000), (7, "u", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = common.scratch_path(spark, "test")
    warc.write_archives(df, path, records_per_file=4)
    got = {r["metadata"]["capture_key"]: r for r in warc.transactions(warc.read_archives(spark, path)).collect()}
    assert len(got) == len(rows)
    first = {}
    for key, _, html in sorted(rows):
        first.setdefault(html or "", key)
    for key, _, html in rows:
        r, raw = got[str(key)], (html or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = first[html or ""] != key
        assert r["record_type"] == ("revisit" if again else "response")
        assert r["metadata"]["refers_to_key"] == (str(first[html or ""]) if again else None)
        assert r["refers_to_target"] == ({1: "http://a/2", 2: None}[first[html or ""]] if again else None)
        assert r["request"]["id"] and (again or bytes(r["payload"]) == raw)
    assert got["2"]["target_uri"] is None and got["4"]["target_uri"] == "http://a/%0D%0AX: y"
    small = common.scratch_path(spark, "test")
    warc.write_archives(df, small, min_revisit_bytes=5)
    kinds = {r["metadata"]["capture_key"]: r["record_type"] for r in warc.transactions(warc.read_archives(spark, small, with_payload=False)).collect()}
    assert kinds["4"] == kinds["2"] == "response" and kinds["3"] == kinds["7"] == "revisit"
    none = common.scratch_path(spark, "test")
    warc.write_archives(df.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0 and warc.transactions(warc.read_archives(spark, none)).count() == 0


def test_archives_of_odd_tables(spark):
    big = (1 << 53) + 1
    rows = [(big, "u", "a", "x"), (None, "u", "a", "y"), (big + 1, "v", "a", None), (big + 1, "v", "a", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumns({"id": F.lit(1), "body": F.lit("b"), "first": F.lit(2), "n": F.lit(3), "record_type": F.lit("w")})
    path = common.scratch_path(spark, "test")
    warc.write_archives(df, path)
    got = [(r["metadata"]["capture_key"], r["record_type"], r["metadata"]["refers_to_key"]) for r in warc.transactions(warc.read_archives(spark, path)).collect()]
    assert sorted(got, key=str) == sorted([(str(big), "response", None), (None, "response", None), *[(str(big + 1), "revisit", str(big))] * 2], key=str)


def test_raked_sums_meet_their_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), ["en", "de", None][i % 3], f"s{min(i % 7, 4)}", 0.1) for i in range(600)]
    df = spark.createDataFrame(rows + [(601, None, "en", "s0", 0.0), (601, None, "en", "s0", 0.0)], "doc_id long, text string, lang string, source string, probability double")
    targets = {"source": {"s0": 0.4, "s1": 0.3}, "lang": 0.5, "topic": 1.0}
    out = raking.sample(raking.describe(df), targets, budget_share=0.3, sweeps=30).toPandas()
    assert len(out) == 602
    weight = out["n_tokens"] * out["factor"]
    shares = (weight.groupby(out["source_group"]).sum() / weight.sum()).to_dict()
    assert abs(shares["s0"] - 0.4) < 1e-3 and abs(shares["s1"] - 0.3) < 1e-3
    assert abs((out["n_tokens"] * out["probability"]).sum() / out["n_tokens"].sum() - 0.3) < 1e-6
    assert set(out["lang_group"]) == {"en", "de", "unknown"} and abs(out["sampled"].mean() - out["probability"].mean()) < 0.08
    empty = raking.sample(raking.describe(df.limit(0)), targets)
    assert empty.count() == 0 and F is not None
