"""Author notes, links and headers, nearest titles, the refetched allow-list."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import authority, bylines, headers
from folio.streaming.allowlist import Refetched

BIO = "A writer on economic affairs who has served on several commissions and lives with two cats in Nagpur."


#: Headings of an archive that stand in bold like names.
HEADINGS = ["Introduction", "References", "Conclusion", "Background", "Way forward", "Summing Up", "The Witch-hunt", "Need for Two Fleets"]


def bio_block(c):
    return bylines.bio_block(c, HEADINGS)


def without_bio(c):
    return bylines.without_bio(c, HEADINGS)


def one(spark, text, c):
    return spark.createDataFrame([(text,)], "x string").select(c(F.col("x")).alias("y")).first().y


def test_bio_blocks(spark):
    photo = f"Prose.\n\n![](https://x.org/a.jpg)\n\n**Asha Rao **\n\n{BIO}\n"
    named = f"Prose.\n\n**Ravi Das**\n\n{BIO}\n"
    assert tuple(one(spark, photo, bio_block)) == ("Asha Rao", BIO, "https://x.org/a.jpg")
    assert tuple(one(spark, named, bio_block)) == ("Ravi Das", BIO, None)
    assert one(spark, f"Prose.\n\n**References**\n\n{BIO}\n", bio_block) is None
    assert one(spark, named + "\n**Mina Sen**\n\n" + BIO, bio_block).name == "Mina Sen"
    assert one(spark, photo + named, bio_block).name == "Asha Rao"
    assert one(spark, None, bio_block) is None and one(spark, "", bio_block) is None
    assert one(spark, photo, without_bio) == "Prose.\n" and one(spark, named, without_bio) == "Prose.\n"
    assert one(spark, "Prose.", without_bio) == "Prose." and one(spark, None, without_bio) is None
    many = "\n**Ravi Das**\n\n" + BIO + "\nline" * 100_000
    assert one(spark, many, bio_block).name == "Ravi Das" and one(spark, many, without_bio) == "\n"


def test_contributors(spark):
    rows = [(1, f"a\n![](https://x.org/a.png)\n**Asha Raó**\n{BIO}"), (2, f"a\n**Nobody Known**\n\n{BIO}"), (3, None), (4, f"a\n![](https://x.org/a.png)\n**No One**\n\n**Asha Rao**\n\n{BIO}")]
    got = bylines.wire_contributors(spark.createDataFrame(rows, "k int, body string"), "k", "body", spark.createDataFrame([("asha-rao",), ("asha-rao",)], "s string"), "s")
    assert sorted((r.k, r.author) for r in got.collect()) == [(1, "asha-rao"), (2, None), (3, None), (4, "asha-rao")]


def test_url_insert(spark):
    put = lambda text, force=False: tuple(one(spark, text, lambda c: headers.insert_url(c, F.lit("u$1"), force)))
    assert put("---\nid: a\n---\nB") == ("---\nid: a\npdf_url: u$1\n---\nB", "inserted")
    assert put("---\nid: a\npdf_url: x\n---\nB") == ("---\nid: a\npdf_url: x\n---\nB", "skip-existing")
    assert put("---\npdf_url: x\nid: a\n---\nB\n---\n", True) == ("---\npdf_url: u$1\nid: a\n---\nB\n---\n", "replaced")
    assert put("B", True) == ("B", "skip-no-frontmatter")
    assert put("---\nprovenance:\n  a: 1\n  b: 2\nid: a\n---\nB") == ("---\nprovenance:\n  a: 1\n  b: 2\npdf_url: u$1\nid: a\n---\nB", "inserted")
    assert put("---\nprovenance:\n  a: 1\n  b: 2\n---\n")[0] == "---\nprovenance:\n  a: 1\n  b: 2\npdf_url: u$1\n---\n"


def test_nearest_titles(spark):
    titles = ["the road to freedom", "road to ruin", "freedom at midnight", "on liberty", "liberty and freedom", "a road"]
    inventory = [(i, x) for i, x in enumerate(titles * 2)]
    misses = ["road to freedom", "liberty", "road to freedom", "zebra"]
    got = authority.nearest_titles(spark.createDataFrame(list(enumerate(misses)), "k int, t string"), "k", "t", spark.createDataFrame(inventory, "o int, u string"), "o", "u")
    want = []
    for k, m in enumerate(misses):
        scored = sorted((-int(tx.token_set_ratio(m, u)), o) for o, u in inventory)
        want += [(k, o, -s, r) for r, (s, o) in enumerate(scored[:3], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_refetched(spark, tmp_path):
    clock, said = [0.0], {"rows": [("a",)], "error": None}

    def read():
        if said["error"]:
            raise said["error"]
        return spark.createDataFrame(said["rows"], "email string")

    allowed = Refetched(spark, read, "email string", 60, str(tmp_path / "list"), now=lambda: clock[0])
    emails = lambda: sorted(r.email for r in allowed().collect())
    said["error"] = OSError("away")
    assert emails() == []
    said["error"] = None
    assert emails() == ["a"]
    said["rows"] = [("b",)]
    assert emails() == ["a"]
    clock[0] = 61
    said["error"] = OSError("away")
    assert emails() == ["a"]
    said["error"] = None
    assert emails() == ["b"]
    clock[0], said["rows"] = 200, [(f"c{i}",) for i in range(20_000)]
    assert allowed().count() == 20_000
    said["error"] = OSError("away")
    again = Refetched(spark, read, "email string", 60, str(tmp_path / "list"), needed=True)
    assert again().count() == 20_000 and again.failed is said["error"]
    with pytest.raises(OSError):
        Refetched(spark, read, "email string", 60, str(tmp_path / "other"), needed=True)()
