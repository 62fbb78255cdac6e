from collections import defaultdict

from pyspark.sql import functions as F

from bastion.llm import lines as L

from .helpers import SF, table

PAGES = "page_id long, url string, html string"


def test_lines_of_markup(spark):
    html = "<html><head><title>t</title></head><body><script>x</script><p>a  b<br>c &amp;lt; d</p><!-- n --><ul><li>e</li></ul><b>f</b>g</body></html>"
    df = spark.createDataFrame([(html,), (None,), ("",), ("<p> \t</p>",)], "html string")
    assert [r[0] for r in df.select(L.visible_lines(F.col("html"))).collect()] == [["a b", "c &lt; d", "e", "fg"], [], [], []]


def test_hosts(spark):
    urls = ["http://A.example.com:80/x", "https://u@b.org", "ftp://c/?q", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(L.host_of(F.col("u"))).collect()]
    assert got == ["a.example.com", "b.org", "c", "", ""]


def test_against_brute_force_on_whole_table(spark):
    pages = table("pages")
    got = {r["page_id"]: r for r in L.op2_site_line_dedup(spark, SF).collect()}
    split = {r["page_id"]: (r["host"], r["l"]) for r in spark.createDataFrame([(p["page_id"], p["url"], p["html"]) for p in pages], PAGES).select(
        "page_id", L.host_of(F.col("url")).alias("host"), L.visible_lines(F.col("html")).alias("l")).collect()}
    of, seen = defaultdict(int), defaultdict(set)
    for page, (host, lines) in split.items():
        of[host] += 1
        for x in lines:
            seen[host, x].add(page)
    for page, (host, lines) in split.items():
        kept = [x for x in lines if not (len(seen[host, x]) > 1 and len(seen[host, x]) / of[host] > 0.3)]
        r = got[page]
        assert (r["host"], r["text"], r["n_lines"], r["n_dropped"]) == (host, "\n".join(kept), len(lines), len(lines) - len(kept))


def test_ratio_and_edge_cases(spark):
    rows = [(i, "http://s/", f"<p>menu</p><p>own {i}</p><p>half</p>" if i < 5 else f"<p>menu</p><p>own {i}</p>") for i in range(10)]
    rows += [(10, "http://one/", "<p>menu</p>"), (11, None, None), (11, None, "<p>x</p><p>x</p>"), (None, "http://s/x", "<p>menu</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("lines", F.lit(2))
    got = L.drop_boilerplate(df, most=0.6).collect()
    by = {r["page_id"]: r for r in got if r["page_id"] not in (11, None)}
    assert by[0]["text"] == "own 0\nhalf" and by[7]["text"] == "own 7" and by[10]["text"] == "menu"
    assert sorted(r["text"] for r in got if r["page_id"] == 11) == ["", "x\nx"]
    assert [r["text"] for r in got if r["page_id"] is None] == [""]
    assert L.drop_boilerplate(spark.createDataFrame([], PAGES)).count() == 0


def test_small_hosts_and_a_very_long_page(spark):
    rows = [(i, "http://four/", f"<p>own {i}</p><p>footer</p>") for i in range(4)] + [(10 + i, "http://two/", f"<p>both</p><p>own {i}</p>") for i in range(2)]
    rows += [(20, "http://one/", "<p>alone</p><p>alone</p>"), (21, "http://four/", "".join(f"<p>line {k}</p>" for k in range(60_000)) + "<p>footer</p>")]
    got = {r["page_id"]: r for r in L.drop_boilerplate(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i]["text"] == f"own {i}" and got[i]["n_dropped"] == 1 for i in range(4))
    assert [got[i]["text"] for i in (10, 11)] == ["own 0", "own 1"] and got[20]["text"] == "alone\nalone"
    assert got[21]["n_lines"] == 60_001 and got[21]["n_dropped"] == 1
