from pagemill.plans import registry

ALPHA = "abcdefghijklmnopqrstuvwxyz "
LINES = ["plain words", "Capital", "größe", "a" * 500 + " end", "x"]


def test_whole_lines(spark, tmp_path):
    spark.createDataFrame([(5, "\n".join(LINES))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for s in LINES:
        ids = [28, *[ALPHA.find(x) + 1 for x in s], 0]
        want.append(ids + [29] * (-len(ids) % 8))
    q = registry.queries()
    got = {r.seq: [int(x) for x in r.ids.split(" ")] for r in q["tokenizer_encode_lines"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))
    text = {r.seq: r.text for r in q["tokenizer_decode_lines"](spark, str(tmp_path)).collect()}
    assert text == {0: LINES[0], 1: "", 2: "gr", 3: LINES[3], 4: "x"}
