"""Documents with what breaks things: nulls, empty and long texts, repeats, and columns named like results."""

LONG = " ".join(f"word{i}" for i in range(30_000))
TEXTS = [
    (0, "the cat sat on the mat and the dog sat on the log while it was late in the day", "a"),
    (1, None, "b"),
    (2, "", None),
    (3, " \n\t ", "a"),
    (4, "one two three", "a"),
    (5, "One TWO three", "b"),
    (6, LONG, "a"),
    (7, LONG + " end", "a"),
    (8, "the cat sat on the mat and the dog sat on the log while it was late in the day", "b"),
    (9, "the cat sat on the mat and the dog sat on the log while it was late in the night", "a"),
    (9, "the cat sat on the mat and the dog sat on the log while it was late in the night", "a"),
    (None, "der Hund und die Katze sind in dem Haus mit der Maus und dem Ball von dem Kind", "a"),
    (11, "no\x1cbreak here\u00a0but é̈ 🙂 <|endoftext|>", "a"),
]
CLASH = ("copy", "kept", "n_words", "piece", "offset", "sequence_id", "rank", "score", "template", "verdict", "sig", "block", "n_email", "__w", "root", "shuffle_key")


def documents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in CLASH})


def words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)
