"""Small documents with every awkward case, and plain Python forms of the contracts."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines string, host string, row string, rid long, size long"
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def frame(spark, texts, langs=None, sources=None):
    """Documents with extra columns whose names operators use inside."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), "x", "h", "r", 7, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    long_text = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [None, "", "   \n\t ", "one", "One two three", "é ü ß 日本語 😀", "a b c d e f g h a b c d e f g h", "x\ny\nx\n\nx", long_text, "tie tie tie tie tie tie tie tie tie"]
    docs = frame(spark, texts, sources=[None, "a", "a", None, "b", "b", "a", "a", "a", "c"])
    return docs.unionAll(docs.where("doc_id in (4, 6)"))  # repeated rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
