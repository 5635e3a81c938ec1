"""Files, dumps, feeds, pages; mirror, resume, commits, breaker."""

import json

import pytest
from pyspark.sql import functions as F

from folio.functions import names
from folio.sources import dump, files, pages
from folio.streaming import breaker, mirror, versions


def test_entries(spark, tmp_path):
    (tmp_path / "musings").mkdir()
    (tmp_path / "musings/a.md").write_text("---\nid: \"one\"\ntitle: T\ntags: [x, y]\ndraft: true\n---\nBody\n---\nrule\n")
    (tmp_path / "musings/b.mdx").write_text("no header")
    (tmp_path / "musings/c.md").write_text("---\nbad: [unclosed\n---\nB")
    got = {r.slug: r for r in files.entries(spark, str(tmp_path), "title string, tags array<string>, draft boolean").collect()}
    assert set(got) == {"one", "b", "c"}
    assert (got["one"].collection, got["one"].fm.title, got["one"].fm.tags, got["one"].fm.draft, got["one"].body) == ("musings", "T", ["x", "y"], True, "Body\n---\nrule\n")
    assert got["b"].body == "no header" and got["b"].header == "" and got["c"].fm.title is None


def test_json_lines_and_priority(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\nnot json\n[1]\n{"id": "b"\n{"id": "c", "n": 2}\n')
    assert sorted(map(tuple, files.json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n int").collect())) == [("a", 1), ("c", 2)]
    rows = spark.createDataFrame([("w", "{broken", 0), ("w", '{"v": 2}', 1), ("w", '{"v": 3}', 2)], "work string, txt string, rank int")
    assert files.first_that_parses(rows, ["work"], "txt", "rank").select(F.variant_get("record", "$.v", "int").alias("v")).first().v == 2
    (tmp_path / "e.json").write_text(json.dumps({"edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "c"}]}))
    assert files.collection_edges(spark, str(tmp_path / "e.json"), "struct<`from`:string,`to`:string>").count() == 2


def test_manifests(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("slug\tconfidence\tpdf_url\tnotes\na\texact\tu\t\nb\tlow\tu\t\nc\thigh\t\t\nd\thigh\tu\tDuplicate of a\n")
    assert [r.slug for r in files.confident_links(spark, str(tmp_path / "m.tsv"), ["exact", "high"]).collect()] == ["a"]
    (tmp_path / "media/sub").mkdir(parents=True)
    (tmp_path / "media/sub/p.JPG").write_bytes(b"12345")
    (tmp_path / "media/n.txt").write_text("x")
    assert [(r.name, r.extension, r.size) for r in files.media_manifest(spark, str(tmp_path / "media"), ["jpg"]).collect()] == [("p.JPG", "jpg", 5)]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:dc="d" xmlns:content="c"><channel><item><title>A</title><link>http://x/a</link><category>p</category><category>q</category><dc:creator>Ann</dc:creator><content:encoded><![CDATA[<p>full</p>]]></content:encoded><description>d</description></item>'
        "<item><title>B</title><link>http://x/b</link><guid>g</guid><author>Bob</author><description>only</description></item><item><title>no link</title></item></channel></rss>"
    )
    got = {r.title: r for r in files.feed(spark, str(tmp_path / "f.xml")).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].guid, got["A"].author, got["A"].content_html, got["A"].categories) == ("http://x/a", "Ann", "<p>full</p>", ["p", "q"])
    assert (got["B"].guid, got["B"].author, got["B"].content_html, got["B"].categories) == ("g", "Bob", "only", [])


def test_mined_entities(spark):
    a = spark.createDataFrame([("A.D. Shroff",), ("X Y",)], "name string")
    b = spark.createDataFrame([("ad shroff",), ("Minoo Masani",)], "name string")
    got = {r.key: (r.name, r.sources, r.confidence) for r in files.mined_entities([("seed", a), ("db", b)], names.n5_seed_key).collect()}
    assert got == {"ad shroff": ("A.D. Shroff", ["db", "seed"], "canonical"), "minoo masani": ("Minoo Masani", ["db"], "db")}
    df = spark.createDataFrame([("planning-by-b-r-shenoy-march-1956.pdf",), ("x-by-various-authors-1950.pdf",), ("nothing.pdf",)], "f string")
    assert [r.b for r in df.select(files.byline_of_file_name(F.col("f")).alias("b")).collect()] == ["B R Shenoy", None, None]


DUMP = """-- dump
CREATE TABLE `il_posts` (
  `ID` bigint(20) NOT NULL,
  `title` text,
  `score` double,
  PRIMARY KEY (`ID`),
  KEY `title` (`title`)
) ENGINE=InnoDB;
INSERT INTO `il_posts` VALUES (1,'a (b), \\'c\\' d\\n',1.5),(2,NULL,-3e2),(3,'it''s; ok',NULL);
INSERT INTO `other` VALUES (9,'x',1);
INSERT INTO `il_posts` (`ID`, `title`, `score`) VALUES (4,'x'),(5,'日本 \\\\ y',0);
"""


@pytest.fixture
def splits_of(spark):
    """Lets Spark cut files into splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}

    def cut(size: int) -> None:
        for k, v in zip(names, (size, 1, 1)):
            spark.conf.set(k, str(v))

    yield cut
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("split", [64 << 20, 40])
def test_dump(spark, tmp_path, splits_of, split):
    (tmp_path / "d.sql").write_text(DUMP)
    splits_of(split)
    df = dump.read_dump(spark, str(tmp_path / "d.sql"), "il_posts")
    assert df.dtypes == [("ID", "bigint"), ("title", "string"), ("score", "double"), ("_corrupt", "boolean")]
    rows = sorted(df.collect(), key=lambda r: r.ID or 0)
    assert [tuple(r) for r in rows] == [(None, None, None, True), (1, "a (b), 'c' d\n", 1.5, False), (2, None, -300.0, False), (3, "it's; ok", None, False), (5, "日本 \\ y", 0.0, False)]


LONG_DUMP = """-- it's a dump
CREATE TABLE `t` (
  `id` int NOT NULL,
  `body` longtext
);
INSERT INTO `u` VALUES
(1,'INSERT INTO `t` VALUES (99,''x'');
INSERT INTO `t` VALUES (98,1);
'),
(2,'b');
INSERT INTO `t` VALUES
(1,'one;
two -- it''s
INSERT INTO `t` VALUES (97,1);
'),
(2,'semi;colon'),
-- a comment that isn't read
(3,'back\\\\'),(4,NULL),
(5,'a \\' quote
');
/* it's over */
INSERT INTO `t` VALUES (6,'last');
"""


@pytest.mark.parametrize("split", [23, 150, 1 << 20])
def test_dump_split_inside_statements_and_literals(spark, tmp_path, splits_of, split):
    """Statements over many lines, statements inside literals, and splits that begin in the middle of either: each row comes once."""
    (tmp_path / "d").mkdir()
    for name in ("a.sql", "b.sql"):
        (tmp_path / "d" / name).write_text(LONG_DUMP)
    splits_of(split)
    rows = dump.read_dump(spark, str(tmp_path / "d"), "t").collect()
    one = [(1, "one;\ntwo -- it's\nINSERT INTO `t` VALUES (97,1);\n"), (2, "semi;colon"), (3, "back\\"), (4, None), (5, "a ' quote\n"), (6, "last")]
    assert sorted((r.id, r.body) for r in rows if not r._corrupt) == sorted(one * 2, key=lambda r: r[0]) and not any(r._corrupt for r in rows)
    with pytest.raises(ValueError):
        dump.read_dump(spark, str(tmp_path / "d"), "none")


def test_pages(spark):
    html = '<html><head><title>T 1950</title></head><body><script>x</script><h1 class="a">Head</h1><a href="/a/b?x=1">l</a> <a href="/a/b">m</a><a href="http://y/f.pdf?d">p</a><p>Text of 1961</p></body></html>'
    df = spark.createDataFrame([(1, "http://h.org/p", html)], "id int, url string, html string")
    assert [r.link for r in pages.links(df, "id", "html").collect()] == ["/a/b"]
    r = pages.details(df, "id", "url", "html").first()
    assert (r.title, r.heading, r.host, r.pdf, r.year, r.byline) == ("T 1950", "Head", "h.org", "http://y/f.pdf", 1961, "Head l m p Text of 1961")


def test_mirror_twice_is_once(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    schema = "slug string, link string, body string, seq long"
    item = lambda slug, body, seq=1: {"slug": slug, "link": f"http://X/{slug}", "body": body, "seq": seq}
    (src / "1.json").write_text("\n".join(json.dumps(x) for x in (item("a", "one\nimported_on: 2026-01-01"), item("b", "two"), item("c", "blocked"), item("a", "late", 0))))
    blocked = spark.createDataFrame([("http://x/C",)], "url string")
    state = lambda: {r.slug: r.body for r in mirror.mirror_table(spark, table).read().collect()}
    mirror.run(spark, str(src), schema, table, str(tmp_path / "cp"), blocked, "bot@x").awaitTermination()
    assert state() == {"a": "one\nimported_on: 2026-01-01", "b": "two"}
    mirror.run(spark, str(src), schema, table, str(tmp_path / "cp"), blocked, "bot@x").awaitTermination()
    assert set(state()) == {"a", "b"}
    (src / "2.json").write_text("\n".join(json.dumps(x) for x in (item("a", "one\nimported_on: 2026-02-02"), item("b", "changed"))))
    mirror.run(spark, str(src), schema, table, str(tmp_path / "cp"), blocked, "bot@x").awaitTermination()
    assert state() == {"a": "one\nimported_on: 2026-01-01", "b": "changed"}


def test_classify_guards(spark):
    items = spark.createDataFrame([("a", "u", "x"), ("b", "u", "x"), ("c", "u", "x")], "slug string, link string, body string")
    state = spark.createDataFrame([("a", "h", "other@x", "l"), ("b", "h", None, None)], "slug string, hash string, email string, login string")
    got = {r.slug: r.action for r in mirror.classify(items, spark.createDataFrame([], "url string"), state, "bot@x").collect()}
    assert got == {"a": "guarded", "b": "guarded", "c": "create"}


def test_commits(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": f"{k}-{i}"}) for i in range(9)))
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).json(str(src))
    calls = []
    ledger = mirror.commit_in_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda n, _: calls.append(n), least=15)
    assert calls == [18, 9] and ledger.read("id string").count() == 27
    assert mirror.new_ids(spark.createDataFrame([("0-0",), ("new",)], "id string"), ledger.read("id string")).count() == 1


def test_breaker_batch(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate([(0, "f"), (10, "f"), (20, "ok"), (30, "f"), (50, "f"), (89, "f"), (200, "f")])]
    df = spark.createDataFrame([("k", i, t, s == "f", s == "ok") for i, t, s in rows], "k string, i int, t long, bad boolean, good boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.t: r.tripped for r in breaker.tripped(df, "k", ["ts", "i"], failures=3).collect()}
    assert got == {0: False, 10: False, 20: False, 30: False, 50: False, 89: True, 200: False}


class Held:
    """State, timers and clock of one key, as the processor sees them."""

    def __init__(self):
        self.values, self.now, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Held()

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs

    def get(self):
        return iter(self.values)

    def put(self, values):
        self.values = values

    update = put

    def exists(self):
        return bool(self.values)

    def clear(self):
        self.values = []


def test_breaker_state():
    import pandas as pd

    held, b = Held(), breaker.Breaker(failures=3, seconds=60, pause=100)
    b.init(held)

    def rows(*said):
        return [tuple(x) for df in b.handleInputRows(("k",), iter([pd.DataFrame(said, columns=["at", "status"])]), held) for x in df.itertuples(index=False)]

    assert rows((0, "failed"), (10, "failed")) == []
    assert rows((20, "failed"), (25, "failed")) == [("k", 20, True)] and held.timers == [100_000]
    assert rows((30, "ok")) == [("k", 30, False)] and rows((40, "failed"), (95, "failed"), (130, "failed")) == []
    assert rows((140, "limited")) == [("k", 140, True)]
    held.now = 240_000
    assert [tuple(x) for df in b.handleExpiredTimer(("k",), held, held) for x in df.itertuples(index=False)] == [("k", 240, False)]
    assert list(b.handleExpiredTimer(("k",), held, held)) == [] and rows((250, "failed")) == []


class Crash(Exception):
    pass


def crashing(monkeypatch, owner, name: str, at: int):
    """Let the at-th call of a method die, before it does anything (odd) or after (even)."""
    calls, real = [0], getattr(owner, name)

    def dies(*args, **kwargs):
        calls[0] += 1
        if calls[0] == (at + 1) // 2 and at % 2:
            raise Crash
        out = real(*args, **kwargs)
        if calls[0] == at // 2 and at % 2 == 0:
            raise Crash
        return out

    monkeypatch.setattr(owner, name, dies)


FEED = "slug string, link string, body string, seq long"


@pytest.mark.parametrize(("name", "at"), [("append", 1), ("append", 2)])
def test_mirror_killed_at_any_step_counts_once(spark, tmp_path, monkeypatch, name, at):
    nobody = spark.createDataFrame([], "url string")
    put = lambda number, *rows: mirror.upsert(spark, spark.createDataFrame(list(rows), FEED), mirror.mirror_table(spark, str(tmp_path / "t"), buckets=4), f"feed-{number}", nobody, "bot@x")
    put(0, ("a", "l", "one", 1), ("b", "l", "one", 1))
    second = [("a", "l", "two", 1), ("c", "l", "new", 1), (None, "l", "x", 1), ("d", None, "x", 1), ("e", "l", None, 1)]
    with monkeypatch.context() as m:
        crashing(m, versions.Log, name, at)
        with pytest.raises(Crash):
            put(1, *second)
    for _ in range(2):  # the replay, and one more
        assert {r.action: r.n for r in put(1, *second).collect()} == {"update": 1, "create": 1, "failed": 3}
    table = mirror.mirror_table(spark, str(tmp_path / "t"))
    assert table.buckets == 4 and sorted((r.slug, r.body) for r in table.read().collect()) == [("a", "two"), ("b", "one"), ("c", "new")]


def test_mirror_writes_only_what_changes(spark, tmp_path):
    table, nobody = mirror.mirror_table(spark, str(tmp_path / "t"), buckets=8), spark.createDataFrame([], "url string")
    rows = [(f"s{i}", "l", "one", 1) for i in range(60)]
    mirror.upsert(spark, spark.createDataFrame(rows, FEED), table, "feed-0", nobody, "bot@x")
    mirror.upsert(spark, spark.createDataFrame([("s7", "l", "two", 1)], FEED), table, "feed-1", nobody, "bot@x")
    mirror.upsert(spark, spark.createDataFrame(rows[:3], FEED), table, "feed-2", nobody, "bot@x")
    written = table.log.last()["versions"]
    assert sorted(written.values()).count("1-feed-1") == 1 and set(written.values()) == {"0-feed-0", "1-feed-1"} and len(written) == 8
    assert table.read().filter("body = 'two'").count() == 1 and table.read().count() == 60


def test_two_writers_cannot_make_one_entry(spark, tmp_path, monkeypatch):
    a, b = versions.Log(spark, str(tmp_path / "log")), versions.Log(spark, str(tmp_path / "log"))
    a.append("x-0", {"n": 1})
    seen = iter([[], ["000000000000-x-0.json"]])
    monkeypatch.setattr(b, "names", lambda: next(seen))
    with pytest.raises(OSError):
        b.append("y-0", {"n": 2})
    assert a.last()["n"] == 1 and a.names() == ["000000000000-x-0.json"]


@pytest.mark.parametrize("at", range(1, 7))
def test_ledger_killed_at_any_step_announces_each_row_once(spark, tmp_path, monkeypatch, at):
    said = {}

    def commit(rows: int, id_: str) -> None:
        assert said.setdefault(id_, rows) == rows

    batches = [spark.createDataFrame([(f"{k}-{i}",) for i in range(9)], "id string").coalesce(1) for k in range(3)]

    def feed():
        ledger = mirror.Ledger(spark, str(tmp_path / "out"), commit, least=15)
        for k, batch in enumerate(batches):
            ledger.add(batch, f"s-{k}")
        ledger.finish()
        return ledger

    with monkeypatch.context() as m:
        crashing(m, versions.Log, "append", at)
        with pytest.raises(Crash):
            feed()
    for _ in range(2):
        ledger = feed()
    assert sum(said.values()) == 27 and ledger.read("id string").distinct().count() == ledger.read("id string").count() == 27


def test_mirror_asks_for_the_blocked_in_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema, asked = "slug string, link string, body string, seq long", []
    for k in "ab":
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"slug": k, "link": f"http://x/{k}", "body": k, "seq": 1}))

    def blocked():
        asked.append(1)
        return spark.createDataFrame([("HTTP://X/A",)], "url string")

    mirror.run(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "cp"), blocked, "bot@x", most=1).awaitTermination()
    assert [r.slug for r in mirror.mirror_table(spark, str(tmp_path / "t")).read().collect()] == ["b"] and len(asked) == 2
