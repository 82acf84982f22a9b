"""Small documents with the odd cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, component_id int, digest string, _metadata_ string"


def documents(spark, extra=()):
    rng = random.Random(5)
    words = ["the", "of", "and", "Thering", "ndwhst", "été", "größe", "niño", "x", "don't", "42", "thaaaa", "aaaaaaa", "!!", "日本語"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120))), "en") for i in range(40)]
    rows += [(40, None, "en"), (41, "", None), (42, " \t\n ", "fr"), (43, rows[3][1], "en"), (44, rows[3][1].replace(" ", "  \n"), "en")]
    rows += [(45, "long " * 30_000, "en"), (46, "a" * 5_000, "de"), (47, "x <|endoftext|> y<|endoftext|>", "en"), (48, "   it's  \u0001 we'll\r\n", None)]
    rows += [(49, rows[5][1] + " once more", "en"), (50, rows[5][1] + " once more", "en"), (50, rows[5][1] + " once more", "en")]
    rows += list(extra)
    return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}", len(t or ""), "p", 1, "d", "m") for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
