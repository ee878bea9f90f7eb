"""Small tables with every awkward row."""

LONG = "the quick brown fox jumps over the lazy dog " * 20_000

DOCS = [
    # doc_id, text, lang, source
    (0, "the cat sat on the mat and looked at the dog", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, " \t\n ", "fr", "b"),
    (5, LONG, "en", "a"),
    (6, "le chat est sur la table et le chien est dans la rue", "fr", None),
    (7, "le chat est sur la table et le chien est dans la rue", "fr", "c"),
    (None, "no id here at all my dear friend", "en", "c"),
    (None, None, None, None),
    (8, "12345 67890 !!!", "en", "a"),
    (9, "der hund und die katze sind in dem haus und der garten ist schön", "de", "b"),
    (9, "der hund und die katze sind in dem haus und der garten ist schön", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)


def clashing(df):
    """df with columns called as what operators make."""
    from pyspark.sql import functions as F

    for name in ("id", "row", "size", "n", "key", "taken", "target", "score", "lang_pred", "sequence_id", "offset", "spans", "set", "component", "_text_", "keep_x"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
