"""URL filters, WARC archives and exact top-k search."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickmill.llm import topk as TK
from kickmill.llm import url_filter as UF
from kickmill.llm import warc as WA
from kickmill.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_url_filter", "op8_warc", "op9_topk"])
def test_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SMALL)


def test_hosts_paths_and_rules(spark):
    urls = ["http://EXAMPLE.org/es/x?q", "https://a.example.org/en/12#f", "http://x.org", "http://x.org/", "ftp://b.com/fr/1", "//b.com/fr/", "http://notexample.com/de/", None, "", "http://a.com://b/c", "http://myexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, urls[0], "r"), (0, urls[0], "r")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in UF.judge(pages, none).collect()}
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block") == got[None]
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3][2] == "org/"
    assert got[4][2:] == ("com/fr/", "allow") and got[5] == ("", "", None, "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][:2] == got[8][:2] == ("", "") and got[9][:2] == ("a.com:", "//b/c")
    assert got[10][2] == "org/"
    many = [*UF.RULES, *(("block", f"h{i}.net/") for i in range(300))]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in UF.judge(pages, none, many).collect()} == got
    assert UF.judge(pages.limit(0), none).count() == 0


def test_rules_spelled_and_joined_agree(spark, monkeypatch):
    """Ties between rules of equal length and hosts of very many labels."""
    deep = "x." * 1200 + "net"
    pages = spark.createDataFrame([("a.org", "/b/c"), ("b.a.org", "/b/"), (deep, "/p"), ("c.com", "/")], "host string, path string")
    rules = [("allow", "a.org/b"), ("block", "org/b/c"), ("block", "net/"), ("allow", deep + "/")]
    read = lambda: {r.host: (r.rule, r.rule_verdict) for r in UF.with_rule(pages, rules).collect()}
    spelled = read()
    assert spelled == {"a.org": ("a.org/b", "allow"), "b.a.org": ("a.org/b", "allow"), deep: (deep + "/", "allow"), "c.com": (None, None)}
    monkeypatch.setattr(UF, "MAX_SPELLED", 0)
    assert read() == spelled


def test_reputation_shrinks(spark):
    rows = [(f"bad{i % 3}.spam.net", 0) for i in range(60)] + [(f"w{i % 5}.good.com", 1) for i in range(100)] + [("one.good.com", 0)]
    pages = spark.createDataFrame([(i, f"http://{h}/p", g) for i, (h, g) in enumerate(rows)] + [(999, "http://new.spam.net/", None), (998, "http://new.good.com/", None)], "page_id long, url string, good int")
    got = {r.page_id: r for r in UF.judge(pages.select("page_id", "url"), pages.select("page_id", "good"), ()).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow"
    assert got[160].verdict == "allow"  # one bad page of a good domain
    assert got[999].good_bound < got[998].good_bound


def test_null_and_repeated_outcomes(spark):
    """Repeated outcomes count each, null ones not at all; repeated pages are judged alike."""
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.com/") for i in range(8)] + [(0, "http://h0.com/"), (None, "http://h1.com/")], "page_id long, url string")
    outcomes = [(0, 0)] * 40 + [(1, 1)] * 40 + [(2, None), (None, 0), (99, 0)]
    got = UF.judge(pages, spark.createDataFrame(outcomes, "page_id long, good int"), ()).collect()
    assert len(got) == 10 and {(r.host, r.verdict) for r in got} == {("h0.com", "block"), ("h1.com", "allow")}
    # page 0 stands twice, so its outcomes count for both rows
    plain = UF.judge(pages.dropDuplicates(), spark.createDataFrame([r for r in outcomes if None not in r], "page_id long, good int"), ()).collect()
    bound = {r.host: r.good_bound for r in got}
    assert bound["h0.com"] < {r.host: r.good_bound for r in plain}["h0.com"] < 0.5


def test_topk_of_repeated_ids(spark):
    """Rows that share an id are candidates each, but none of a query with that id; repeated queries answer as many times."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (0, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in TK.top_k(df, df.filter("vec_id = 0 AND embedding[0] = 1")).orderBy("rank").collect()]
    assert got == [(1, 1, 3 * 1024 * 1024), (2, 1, 2 * 1024 * 1024), (3, 1, 2 * 1024 * 1024)]


def test_topk_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[50:90] = x[40]  # ties
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)] + [(900, None, "l"), (901, [float("nan")] * 16, "l"), (902, [None] + [1.0] * 15, "l"), (None, x[0].tolist(), "l"), (903, [float("inf")] * 16, "l"), (905, [1.0, 2.0], "l"), (906, [], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = df.filter("vec_id % 100 = 0")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in TK.top_k(df, q).collect()}
    data = {i: np.floor(1024 * np.pad(np.array(v, float), (0, 16 - len(v)))).astype(np.int64) for i, v, _ in rows if v is not None and i is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for a in [i for i in data if i % 100 == 0]:
        best = sorted(((int(data[a] @ data[b]), b) for b in data if b != a), key=lambda t: (-t[0], t[1]))[:10]
        want |= {(a, k + 1): (b, s) for k, (s, b) in enumerate(best)}
    assert got == want
    large = spark.createDataFrame([(0, [3e7] * 4), (1, [3e7] * 4), (2, [1e4] * 4), (2, [-3e7] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit into a long"):
        TK.top_k(large, large.filter("vec_id = 0")).collect()
    large = large.filter("embedding[0] < 2e7")
    got = [(r.vec_id, r.score) for r in TK.top_k(large.union(spark.createDataFrame([(0, [2e8, -2e8, 1.5, 3.0])], large.schema)), spark.createDataFrame([(0, [2e8, -2e8, 1.5, 3.0])], large.schema)).orderBy("rank").collect()]
    assert got == [(2, 1024 * 10000 * 1024 * 9 // 2), (2, -1024 * 30000000 * 1024 * 9 // 2)]
    with pytest.raises(Exception, match="does not fit into a long"):
        TK.top_k(large.select("vec_id", F.array(F.lit(1e17)).alias("embedding")), large.limit(0)).collect()
    few = df.filter("vec_id IN (0, 1, 2)")
    assert TK.top_k(few, few.filter("vec_id = 0")).count() == 2
    assert TK.top_k(df.limit(0), q).count() == 0 and TK.top_k(df, q.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, "http://b/", "same"), (9, None, "same"), (4, "u", None), (7, "v", ""), (1, "w", "é" * 70000), (3, "http://b/", "same"), (None, "n", "same"), (11, "z", "line\r\n\r\nline")]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    WA.archive(pages, path)
    got = spark.read.format("warc").option("verify", "true").load(path)
    back = got.collect()
    assert len(back) == len(rows)
    kinds = sorted((str(r.record_id), r.record_type, str(r.refers_to)) for r in back)
    response = lambda i: (f"<urn:page:{i}>", "response", "None")
    assert kinds == sorted([response(3), response(3), response(4), response(1), response(""), response(11), ("<urn:page:5>", "revisit", "<urn:page:3>"), ("<urn:page:9>", "revisit", "<urn:page:3>"), ("<urn:page:7>", "revisit", "<urn:page:4>")])
    payloads = {r.record_id: bytes(r.payload) for r in back if r.record_type == "response"}
    assert payloads["<urn:page:1>"] == ("é" * 70000).encode() and payloads["<urn:page:11>"] == b"line\r\n\r\nline" and payloads["<urn:page:4>"] == b""
    assert {r.payload_length for r in back if r.record_id == "<urn:page:5>"} == {4}
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(payloads[r.record_id]).digest()).decode() for r in back if r.record_type == "response")
    # any gzip reader can read the files
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows)


def test_pushed_filters_skip_payloads(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("text"), F.col("id") % 10).alias("html"))
    path = f"file://{tmp_path}/w"
    WA.archive(pages, path)
    plan = spark.read.format("warc").load(path).filter("record_type = 'revisit' AND record_id LIKE '<urn%'")
    assert plan.count() == 40
    # both tests are judged by the reader: no filter is left above the scan
    assert " Filter " not in plan._jdf.queryExecution().executedPlan().toString()
    reader = WA.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_length",), 3)])) == [EqualTo(("payload_length",), 3)]
    decoded = []
    old = WA.payload_of
    WA.payload_of = lambda block: decoded.append(1) or old(block)
    try:
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        WA.payload_of = old
    assert rows == len(decoded) == 40
    bare = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'response'").collect()
    assert len(bare) == 10 and all(r.payload is None for r in bare)


def test_plain_and_foreign_files(spark, tmp_path):
    records = [WA.record_bytes("response", f"<urn:page:{i}>", "u", WA.digest(b"x" * i), i, b"x" * i, None) for i in (0, 5, 9000)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    WA.register(spark)
    got = spark.read.format("warc").option("verify", "true").load(f"file://{tmp_path}").collect()
    assert sorted(len(r.payload) for r in got) == [0, 0, 5, 5, 9000, 9000]


def test_archives_grow_and_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    page = lambda i: spark.createDataFrame([(i, "u", f"text {i}")], "page_id long, url string, html string")
    ids = lambda: sorted(r.record_id for r in spark.read.format("warc").load(path).collect())
    WA.archive(page(1), path)
    WA.archive(page(2), path)
    assert ids() == ["<urn:page:1>", "<urn:page:2>"]
    WA.archive(page(3), path, overwrite=True)
    assert ids() == ["<urn:page:3>"] and len(list((tmp_path / "w").glob("*.warc.gz"))) == 1


def test_archive_of_many_revisits(spark, tmp_path, monkeypatch):
    """Beyond the bound revisits are joined by a shuffle, with equal results."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("text"), F.col("id") % 7).alias("html"))
    read = lambda p: sorted((r.record_id, r.record_type, str(r.refers_to)) for r in spark.read.format("warc").load(p).collect())
    WA.archive(pages, f"file://{tmp_path}/a")
    monkeypatch.setattr(WA, "MOST_SENT", 0)
    WA.archive(pages, f"file://{tmp_path}/b")
    assert read(f"file://{tmp_path}/a") == read(f"file://{tmp_path}/b")


def test_long_headers(spark, tmp_path):
    """URLs around and far beyond what is read at first, as responses and revisits, with short records behind."""
    import random

    r, rows = random.Random(8), []
    for k, n in enumerate([3900, 4050, 4096, 4200, 5250, 6000, 7000, 8100, 8192, 8300, 8750, 65_536, 300_000]):
        for copy in range(2):
            rows += [(100 * k + 10 * copy, "http://x/" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)), f"<p>{k}"), (100 * k + 10 * copy + 1, "http://short/", f"s{k}{copy}")]
    path = f"file://{tmp_path}/w"
    WA.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r.record_id: r for r in spark.read.format("warc").option("verify", "true").load(path).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        row = got[f"<urn:page:{page}>"]
        assert row.target_uri == url and row.payload_length == len(html) and row.record_type == ("revisit" if page % 100 == 10 else "response")
        assert row.payload is None or bytes(row.payload) == html.encode()


def test_header_names_have_no_case(spark, tmp_path):
    record = WA.record_bytes("response", "<urn:a>", "http://a/", WA.digest(b"body"), 4, b"body", None)
    head, rest = record.split(b"\r\n\r\n", 1)
    lower = b"\r\n".join(n.lower() + b":" + v for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\n" + lower + b"\r\n\r\n" + rest + record)
    got = spark.read.format("warc").option("verify", "true").load(f"file://{tmp_path}").filter("record_type = 'response'").collect()
    assert [(r.record_id, r.target_uri, bytes(r.payload), r.payload_digest) for r in got] == [("<urn:a>", "http://a/", b"body", WA.digest(b"body"))] * 2
    assert sorted(next(k for k in r.headers if k.lower() == "warc-type") for r in got) == ["WARC-Type", "warc-type"]


def test_empty_archive(spark, tmp_path):
    WA.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert spark.read.format("warc").load(f"file://{tmp_path}/w").count() == 0


def test_warc_query(spark):
    rows = QUERIES["op8_warc"](spark, SMALL).collect()
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    assert len(rows) == len(pages)
    for r in rows:
        p, f = pages[r.page_id], first[pages[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if f == r.page_id else ("revisit", f))


def test_levels_of_hosts(spark):
    from kickmill.llm.url_filter import domain_of, suffix_of

    hosts = {"a.b.co.za": ("b.co.za", "co.za"), "x.gov.uk": ("x.gov.uk", "gov.uk"), "www.a.com": ("a.com", "com"), "a.com:8080": ("a.com", "com"), "10.0.0.1": ("10.0.0.1", "address"), "192.168.0.1:80": ("192.168.0.1", "address"), "[::1]:8080": ("[::1]", "address"), "u:p@b.org": ("b.org", "org"), "a.org.": ("a.org", "org"), "localhost": ("localhost", "localhost"), "": ("", ""), "com.mx": ("com.mx", "com.mx")}
    got = {r.h: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain_of(F.col("h")).alias("d"), suffix_of(F.col("h")).alias("s")).collect()}
    assert got == hosts
