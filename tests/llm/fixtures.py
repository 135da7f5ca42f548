"""Rows that every operator must take: nulls, empty and long texts, repeats, odd characters."""

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved.", "en", "a", 80),
    (2, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved.", "en", "a", 80),
    (3, "", "en", "a", 0),
    (4, None, "en", None, None),
    (5, "one two", None, "a", 7),
    (6, "ÄÖ ß 日本語 😀   tabs\tand\x0bmore \n\n end", "de", "b", 30),
    (7, "word " * 9000, "en", "b", 45000),
    (8, "Mail a.b@c.example.org or call +1 (555) 555-1234, card 4111 1111 1111 1111, host 10.0.0.1.\nAll rights reserved.", "en", "a", 100),
    (9, "1" * 3000, "en", None, 3000),
    (None, "no id at all", "en", "a", 12),
    (11, "one two", None, "a", 7),
    (11, "one two", None, "a", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts():
    return [r[1] for r in ROWS]
