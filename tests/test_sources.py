import random
from email.message import EmailMessage
from pathlib import Path

from letterloom.operators import graph
from letterloom.runtime import shared_folder
from letterloom.sources import mail
from letterloom.sources.paged import PagedSource


def pages(number, options):
    rows = [{"id": i, "title": f"t{i}"} for i in range(10)]
    return rows[(number - 1) * 4 : number * 4], 3


def test_messages(spark):
    m = EmailMessage()
    m["Subject"], m["From"] = "Grüsse", "A <a@x.example>"
    m.set_content("Guten Tag\n")
    m.add_alternative("<p>nein</p>", subtype="html")
    m.add_attachment(b"123", maintype="application", subtype="pdf", filename="a.pdf")
    h = EmailMessage()
    h.set_content("<style>x</style><p>Eins &amp; zwei<br>drei</p><script>no()</script>", subtype="html")
    rows = [(1, bytes(m)), (2, bytes(h)), (3, None), (4, b"")]
    got = {r["id"]: r["message"] for r in mail.messages(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id int, raw binary"), "raw").collect()}
    assert (got[1]["subject"], got[1]["body"], got[1]["attachments"][0]["name"], got[1]["attachments"][0]["size"]) == ("Grüsse", "Guten Tag", "a.pdf", 3)
    assert got[2]["body"] == "Eins & zwei\ndrei"
    assert got[3]["body"] is None and got[4]["body"] is None


def test_pages_of_a_service(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").schema("title string, id long, extra string").option("fetch", "tests.test_sources:pages").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["id"], r["title"], r["extra"]) for r in df.collect()) == [(i, f"t{i}", None) for i in range(10)]


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["x"] == got["y"] == "x" and got["z"] == "z" and len(got) == 44
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_in_many_rounds(spark):
    """The plan of a round doesn't carry the sizes of all rounds before, and their files are removed."""
    order = [f"n{i:03d}" for i in range(40)]
    random.Random(4).shuffle(order)
    there = set(Path(shared_folder(spark)).glob("component-*"))
    labels = graph.components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a string, b string"))
    assert labels.where("label <> 'n000'").count() == 0 and labels.count() == 40
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**9
    assert len(set(Path(shared_folder(spark)).glob("component-*")) - there) == 1
