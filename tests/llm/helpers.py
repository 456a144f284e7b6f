"""Small tables with the cases that every operator must bear."""

import re

LONG = "lorem ipsum dolor " * 60_000


def documents(spark, rows):
    """``documents`` with one more column than usual; rows are (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")


def folder(spark, tmp_path, rows, name="documents"):
    """A folder that holds the rows as the table ``documents``."""
    documents(spark, rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


ODD = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", None, "b"),
    (5, "one two  three four five six seven eight nine ten eleven\n", "en", "a"),
    (6, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (6, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (7, LONG, "la", "c"),
    (None, "no id here at all", "en", None),
    (8, "Grüße aus Köln – naïve café, \U0001f600 <|endoftext|> 日本語 x", "de", "ä"),
]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
