"""Rows of documents that operators must take without crashing."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, key string, row long, ids string, id int, words string, fp long, label int"


def rows_of(texts, source="s"):
    """Rows of documents with further columns whose names operators use themselves."""
    return [(i, t, "en", source, len(t or ""), 7, 7, 0.5, "k", 7, "x", 7, "w", 7, 7) for i, t in enumerate(texts)]


def with_id(row, i):
    return (i, *row[1:])


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [None, "", " \t\n ", "one", "two words", "Same text here, said twice over again. And once more for luck, it says.", "Same text here, said twice over again. And once more for luck, it says.", "ünïcödé ßtraße 🎉 текст 日本", "a\x0bb\x0cc\rd", LONG]
