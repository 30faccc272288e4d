"""Small tables that hold what operators must survive."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

EXTRA = ["_row", "_kept", "_chosen", "_host", "_key", "_own_key", "_removed", "_predicted", "doc", "size", "n_tokens", "fp", "root", "row", "host", "text_key", "kept", "part", "block", "removed", "_score", "slot", "least"]
LONG = " ".join(f"w{i % 977} x{i % 31}." for i in range(30_000)) + "\n" + "y" * 5000
ROWS = [
    (0, None, "en", "s0"),
    (1, "", "en", "s0"),
    (2, " \n\t \x0b", None, "s0"),
    (3, "a", "en", None),
    (None, "one two three four five six", "en", "s1"),
    (None, None, None, None),
    (5, "The same text, twice over: mail ann.19@mail.example.com now.", "en", "s0"),
    (5, "The same text, twice over: mail ann.19@mail.example.com now.", "en", "s0"),
    (6, LONG, "en", "s0"),
    (7, "Σ ΟΔΟΣ é É ½ ² 日本 <|endoftext|> it's \x1c +1 (415) 555-0100\n\n x  y", "el", "s2"),
    (8, "The same text, twice over: mail ann.19@mail.example.com now.", "en", "s1"),
    (2**62, "a b c d e f g h i j k l m n o p", "en", "s0"),
    (-3, "a a a a a a a a a a a a a a a a a a a a", "en", "s0"),
]


def documents(spark, rows=None, extra=True):
    fields = [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
        StructField("source", StringType()), StructField("n_chars", LongType()),
    ]
    names = EXTRA if extra else []
    fields += [StructField(n, IntegerType()) for n in names]
    rows = ROWS if rows is None else rows
    data = [(*r, len(r[1] or ""), *range(len(names))) for r in rows]
    return spark.createDataFrame(data, StructType(fields))


def text(rows=None):
    return [(r[0], r[1] or "") for r in (ROWS if rows is None else rows)]
