import hashlib

from pyspark.sql import functions as F

from parley.sources import numbered

GOOD = """1 your persona: i ski.
2 partner's persona: i cook.
3 hello\thi
4 how are you?\tfine
1 your persona: x
2 your persona: y
3 partner's persona: z
4 a\tb
"""


def lines(spark, text, split="train"):
    return numbered.lines_of(spark.createDataFrame([(split, text)], "split string, text string"))


def test_parse(spark):
    got = sorted((r.asDict(True) for r in numbered.parse(lines(spark, GOOD), "cfg").collect()), key=lambda r: r["your_persona"])
    assert [r["your_persona"] for r in got] == [["i ski."], ["x", "y"]]
    assert got[0]["turns"] == [{"turn_id": 0, "text": "hello", "response": "hi"}, {"turn_id": 1, "text": "how are you?", "response": "fine"}]
    assert got[1]["conversation_id"] == hashlib.sha256(b"cfg\0train\x001").hexdigest()
    assert numbered.violations(lines(spark, GOOD)).count() == 0


def test_blocks_of_running_sums_do_not_matter(spark, monkeypatch):
    whole = sorted(map(str, numbered.parse(lines(spark, GOOD * 5), "cfg").collect()))
    monkeypatch.setattr(numbered, "BLOCK", 3)
    assert sorted(map(str, numbered.parse(lines(spark, GOOD * 5), "cfg").collect())) == whole and len(whole) == 10


BAD = {
    "blank line": "1 your persona: a\n\n2 partner's persona: b\n3 c\td",
    "no line number": "1 your persona: a\nx partner's persona: b\n3 c\td",
    "numbering gap": "1 your persona: a\n3 partner's persona: b\n4 c\td",
    "blank persona": "1 your persona:  \n2 partner's persona: b\n3 c\td",
    "persona after turn": "1 your persona: a\n2 partner's persona: b\n3 c\td\n4 your persona: e",
    "unknown persona prefix": "1 your persona: a\n2 partner's persona: b\n3 my persona: c\td",
    "not two fields": "1 your persona: a\n2 partner's persona: b\n3 c\td\te",
    "blank field": "1 your persona: a\n2 partner's persona: b\n3 c\t ",
    "no partner persona": "1 your persona: a\n2 c\td",
    "no turns": "1 your persona: a\n2 partner's persona: b",
}


def test_violations(spark):
    for kind, text in BAD.items():
        found = {r["kind"] for r in numbered.violations(lines(spark, text)).collect()}
        assert kind in found, (kind, found)
        assert numbered.parse(lines(spark, text + "\n" + GOOD), "cfg").count() == 2


def test_line_kinds_and_first_episode(spark):
    r = numbered.line_kinds(lines(spark, GOOD)).first()
    assert (r["n_lines"], r["episodes"], r["your_lines"], r["partner_lines"], r["turn_lines"], r["first_turn"]) == (8, 2, 3, 2, 3, "3 hello\thi")
    assert numbered.first_episode(lines(spark, GOOD)).count() == 4


def test_line_ends_and_empty_text(spark):
    assert [r["value"] for r in lines(spark, "a b\r\nc\x85d").orderBy("line_no").collect()] == ["a", "b", "c", "d"]
    assert lines(spark, "").count() == 0 and numbered.parse(lines(spark, ""), "cfg").count() == 0


def test_round_trip(spark):
    parsed = numbered.parse(lines(spark, GOOD * 3), "cfg").withColumnRenamed("source_split", "split")
    ordered = parsed.rdd.zipWithIndex().map(lambda r: (r[1] * 40_000, *r[0][1:])).toDF("row_index long, your_persona array<string>, partner_persona array<string>, turns array<struct<turn_id:int,text:string,response:string>>, split string")
    written = numbered.write_lines(ordered, "row_index")
    rows = written.orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == list(range(1, len(rows) + 1))
    again = numbered.parse(written, "cfg")
    key = lambda df: sorted(str((r["your_persona"], r["partner_persona"], r["turns"])) for r in df.collect())
    assert key(again) == key(parsed)


def test_writing_broken_conversations(spark):
    d = spark.createDataFrame([(1, "s", None, ["x"], None), (2, "s", None, None, []), (3, "s", ["a"], ["b"], [("t", "r")])], "row_index long, split string, your_persona array<string>, partner_persona array<string>, turns array<struct<text:string,response:string>>")
    got = [tuple(r) for r in numbered.write_lines(d, "row_index", F.when(F.col("row_index") == 3, "{n} end")).select("line_no", "value").orderBy("line_no").collect()]
    assert got == [(1, "1 partner's persona: x"), (2, "1 your persona: a"), (3, "2 partner's persona: b"), (4, "3 t\tr"), (5, "4 end")]
    assert numbered.write_lines(d.limit(0), "row_index").count() == 0
