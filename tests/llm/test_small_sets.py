from pagemill.llm import near_dedup


def test_small_sets_at_the_threshold(spark):
    """Sets of 35 shingles with 30 in common, whose sketches put them at 0.669 and 0.678."""
    rows = []
    for s in (13685, 18382, 5509):
        head = " ".join(f"w{s}x{i}" for i in range(34))
        rows += [(2 * s + k, head + " " + " ".join(f"{x}{i}" for i in range(5))) for k, x in enumerate("ab")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
