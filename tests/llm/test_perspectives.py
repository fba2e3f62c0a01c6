from pyspark.sql import functions as F

from kpiforge.llm import perspectives

SCHEMA = "conv_id long, turn long, role string, text string"


def whole(segments):
    """(conversation, perspective) -> (rendered text, trained text), from the segments' places."""
    out = {}
    for r in sorted(segments, key=lambda r: r.start):
        text, trained = out.get((r.conv_id, r.perspective), ("", ""))
        assert len(text) == r.start
        text += r.segment
        if r.mask_start is not None:
            trained += text[r.mask_start:r.mask_end]
        out[r.conv_id, r.perspective] = text, trained
    return out


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi bob"), (1, 2, "bob", "hi ann"), (1, 3, "cy", "hello ☺"), (2, 0, "ann", "alone")]
    got = whole(perspectives.rotate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[1, "bob"] == ("<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi bob<|end|>\n<|assistant|>\nhi ann<|end|>\n"
                             "<|user name=cy|>\nhello ☺<|end|>\n", "hi ann<|end|>\n")
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "ann")}


def test_one_large_conversation_spans_partitions(spark):
    rows = [(7, i, f"s{i % 3}", "t" * (i % 13)) for i in range(3_000)] + [(k, 0, "ann", "x") for k in range(100, 130)]
    got = perspectives.rotate(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    full = whole(got)
    assert len(got) == 9_000 + 30
    assert full[7, "s1"][1] == "".join("t" * (i % 13) + "<|end|>\n" for i in range(3_000) if i % 3 == 1)


def test_odd_rows(spark):
    rows = [(None, 0, "a", "x"), (None, 1, "b", "y"), (1, None, None, None), (1, 0, "a", ""), (1, 0, "a", ""), (2, 0, "system", "s"),
            (3, 0, "a", "l" * 100_000)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"segment": F.lit(1), "perspective": F.lit("p"), "part": F.lit(0)})
    full = whole(perspectives.rotate(d).collect())
    assert set(full) == {(None, "a"), (None, "b"), (1, "unknown"), (1, "a"), (3, "a")}
    assert full[1, "a"][0].startswith("<|user name=unknown|>\n<|end|>\n<|assistant|>\n")
    assert perspectives.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
