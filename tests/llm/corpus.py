"""Small document tables with the odd cases every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

COMMON = "this line is shared by many of the documents"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ka", "lo", "mi", "te", "ru", "sen"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    rng = random.Random(4)
    base = " ".join(words(rng, 60))
    lines = [" ".join(words(rng, 9)) for _ in range(12)]
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, "\n", "en", "a", 1),
        (3, " \t ", None, "b", 3),
        (4, base, "en", "a", len(base)),
        (5, base, "en", "b", len(base)),
        (6, base, None, None, len(base)),
        (7, base.upper(), "de", "c", len(base)),
        (8, "\n".join(lines[:6] + [COMMON] + lines[:2]), "en", "a", None),
        (9, "\n".join(lines[3:9] + ["  " + COMMON.upper() + "\t"]), "fr", "c", 7),
        (10, "\n".join([COMMON, "short", COMMON, "short"]), "fr", "c", 7),
        (11, "straße ÄÖÜ   žluťoučký 🦊 kůň " * 9, "de", "c", 9),
        (12, "x" * 5000, "en", "a", 5000),
        (13, " ".join(words(rng, 9000)), "en", "long", 1),
        (14, "one two three", "en", "a", 13),
        (15, base.replace("ka", "kb", 1), "en", "b", len(base)),
        (16, "1234 5678 !!", "en", "b", 12),
    ]
    rows.append(rows[4])  # a repeated row
    rows.append((None, base, "en", "a", 5))  # no id
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ("row", "doc", "version", "lines", "key", "slot", "size", "rank", "score", "pos", "dropped", "source_size", "bucket", "spans", "taken")
    return df.withColumns({name: F.lit(f"mine {name}") for name in extra})


def written(docs, folder) -> str:
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)
