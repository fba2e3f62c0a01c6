"""Small hand-made tables for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def sentence(n, start=0, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(start, start + n))


def odd_documents():
    """Nulls, empty and very long texts, repeated rows and ids."""
    return [(1, None), (2, ""), (3, "   \n\t "), (None, "a text without an id"), (4, "same row"), (4, "same row"),
            (4, "same id, other text"), (5, sentence(30_000)), (6, "ünïcödé 漢字 \U0001f600 <|endoftext|> end"), (7, "x" * 50_000)]
