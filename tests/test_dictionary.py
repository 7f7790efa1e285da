"""Dictionary terms in texts against plain containment."""

import random

from flowledger.operators import dictionary
from flowledger.session import materialize


def found(spark, texts, terms):
    held = materialize(spark.createDataFrame([(t,) for t in terms], "term string"), "terms")
    pages = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "url string, body string, term string")
    return [tuple(r) for r in dictionary.terms_in(pages.drop("term"), held, "url").collect()]


def test_terms_of_all_lengths_in_odd_texts(spark):
    texts = [None, "", "a", "aaaa aab", "SQLite\nsqlite\r\nSQLit", "ein Straßenname, éà \U0001f600x", "x" * 5000 + "end", "(.*) \\E [a]"]
    terms = ["a", "aa", "aab", "SQLite", "SQLite\nsqlite\r", "Straßen", "\U0001f600x", "xxxend", "x" * 300, "", None, "(.*)", "\\E", "nowhere", "a"]
    got = found(spark, texts, terms)
    want = {(str(i), t) for i, text in enumerate(texts) if text for t in terms if t and t in text}
    assert set(got) == want and len(got) == len(want)
    assert found(spark, texts, [None, ""]) == [] and found(spark, [], ["a"]) == [] and found(spark, texts, []) == []


def test_100000_terms(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choices("abcdefgh", k=rng.randrange(5, 11))) for _ in range(100_000)]
    texts = ["".join(rng.choices("abcdefgh ", k=600)) + rng.choice(terms) for _ in range(40)]
    held = set(terms)
    want = {(str(i), text[a : a + n]) for i, text in enumerate(texts) for n in range(5, 11) for a in range(len(text)) if text[a : a + n] in held}
    got = found(spark, texts, terms)
    assert set(got) == want and len(got) == len(want)
