"""Text-corpus operators leave out no pair, row or turn."""

from quern.llm import chat, decontaminate, near_dedup
from quern.staging import Stages


def test_low_bytes_alone_are_no_shared_band(spark):
    """Band 0 of the pair agrees in the low bytes that are kept, not in its key: the pair first meets in band 1."""
    rows = [(7, 1, n, n, 56, [10 + n, 7], bytes([5] * 12), 0, 1) for n in (1, 2)] + [(7, 1, 3, 3, 1, [99, 7], bytes(range(12)), 0, 1)]
    crowded = spark.createDataFrame(rows, "bucket long, band int, node long, component long, n_shingles long, bands array<long>, signature binary, block long, blocks long")
    assert [tuple(r) for r in near_dedup._search(crowded, 10, 85, 8).collect()] == [(1, 2, False)]


def test_templates_that_look_far_back_are_found():
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(60)]
    drops = lambda ts: "".join(f"{r}:{t}\n" for r, t in ts[-40:])
    first = lambda ts: "".join(f"{r}:{t}/{ts[0][1]}\n" for r, t in ts)
    got = list(chat._located(iter(turns), drops))
    assert [g[4] for g in got] == [k >= 40 for k in range(60)]
    assert "".join(g[1] for g in chat._located(iter(turns), first)) == first(turns)


def test_every_row_is_judged_against_several_blocks(spark):
    items = ["a b c d e f g h", "k l m n o p q r"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, items[0]), (1, "clean"), (None, items[1]), (None, "clean"), (None, " ".join(items)), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, [(1, True, 0, 1), (1, False, None, 0), (None, True, 1, 1), (None, False, None, 0), (None, True, 0, 2), (2, False, None, 0)]))
    for block in (1, 10**6):
        got = decontaminate.contamination(df, bench, block_words=block).select("doc_id", "contaminated", "item_id", "n_items").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_further_pairs_of_two_components_are_announced(spark):
    """Two components of three classes each, all alike: nine pairs across, of which a round hands on two."""
    rows = [(7, 0, n, n % 2, 56, [7], bytes([5] * 12), 0, 1) for n in range(1, 7)]
    crowded = spark.createDataFrame(rows, "bucket long, band int, node long, component long, n_shingles long, bands array<long>, signature binary, block long, blocks long")
    got = [tuple(r) for r in near_dedup._search(crowded, 10, 85, 2).collect()]
    assert len([g for g in got if not g[2]]) == 2 and (None, None, True) in got
    assert len(near_dedup._search(crowded, 10, 85, 9).collect()) == 9


def test_pipeline_judges_rows_whatever_their_ids(spark, tmp_path):
    """Repeated and null ids, equal rows, null and long texts, columns that clash with inner names."""
    import corpus_pipeline

    say = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, say("a")), (5, say("a")), (5, say("b")), (None, say("a")), (None, say("c")), (7, say("d")), (7, say("d")), (8, None), (9, ""), (10, say("e", 60_000))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, row int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, say("c"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, seen = Stages(spark, "t"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stages.write(stage(spark, df, str(tmp_path)))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "row"]
        seen.append(sorted(str((r["doc_id"], r["text"][:2])) for r in df.collect()))
    assert len(seen[0]) == len(seen[1]) == 8
    assert seen[2] == sorted(map(str, [(1, "a0"), (5, "b0"), (None, "c0"), (7, "d0"), (10, "e0")]))
    assert seen[3] == sorted(map(str, [(1, "a0"), (5, "b0"), (7, "d0"), (10, "e0")]))
    packed = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {1, 5, 7, 10}
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0


def test_blocks_give_fewer_links_than_classes(spark):
    """Six classes alike and a seventh that agrees in its signature only: five links join the six, whatever the blocks."""
    base = [f"w{k}" for k in range(59)]
    texts = {n: " ".join([*base, f"end{n}"]) for n in range(1, 7)} | {7: " ".join(f"x{k}" for k in range(60))}
    for blocks in (1, 3):
        rows = [(7, 0, n, n, 56, [7], bytes([5] * 12), t, n % blocks, blocks) for n, t in texts.items()]
        crowded = spark.createDataFrame(rows, "bucket long, band int, node long, component long, n_shingles long, bands array<long>, signature binary, text string, block long, blocks long")
        got = [tuple(r) for r in near_dedup._joining(crowded, 10, 85).collect()]
        assert {n for link in got for n in link} == set(range(1, 7))
        assert blocks > 1 or len(got) == 5
