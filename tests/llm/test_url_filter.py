import duckdb

from pointloom.llm.url_filter import OWN_RULES, RULES, filter_urls, sql

URLS = [
    (1, "https://a.example.org/es/1?x#y"),
    (2, "http://example.org/en/12"),
    (3, "http://notexample.org/en/12"),
    (4, "HTTP://WWW.Example.ORG/EN/1"),
    (5, "https://x.com/fr/"),
    (6, "https://x.com/de/a"),
    (7, "https://x.com"),
    (8, "https://org"),
    (9, "ftp://org/"),
    (10, None),
    (11, "no scheme"),
    (12, ""),
    (13, "://"),
    (14, "https://cheap-pills.example.com?x=/de/"),
    (15, "https://cheap-pills.example.com/fr/x"),
    (16, "a://b://example.org/es/"),
    (17, "http://é.example.org/es/\nq"),
    (18, "http://" + "a." * 50 + "com/de/" + "z" * 3000),
    (1, "https://a.example.org/es/1?x#y"),
    (None, "https://x.com/de/a"),
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    for rules, named in ((RULES, True), (OWN_RULES, False)):
        if hits := [(len(h + p), v, h + p) for v, h, p in rules if fits(h, p)]:
            _, verdict, rule = max(hits)
            return host, path, rule if named else None, verdict
    return host, path, None, "block" if host == "" else "allow"


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")


def test_equals_brute_force_and_sql(spark):
    want = sorted(((i, *brute(u)) for i, u in URLS), key=str)
    frame = table(spark, URLS)
    assert sorted((tuple(r) for r in filter_urls(frame).collect()), key=str) == want
    con = duckdb.connect()
    con.register("pages", frame.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    assert sorted(con.sql(sql()).fetchall(), key=str) == want


def test_empty_table(spark):
    assert filter_urls(table(spark, URLS).limit(0)).count() == 0
