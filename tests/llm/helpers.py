import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, size int, kept boolean"


def table(spark, texts, ids=None, langs=None):
    """A documents table whose further columns clash with names that the operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "src", None, 7, None, None) for i, t, lang in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sample_texts(n=60, seed=5):
    """Texts with exact copies, shared passages, white space variants, empty, null and non-ASCII ones, and a long one."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "häus", "naïve", "don't", "x1", "漢字", "re-do", "A", "Zulu", "it's", "42"] + ["".join(r.choice("abcdeion") for _ in range(r.randrange(2, 9))) for _ in range(80)]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = sentence(25)
    out = [sentence(r.randrange(1, 60)) for _ in range(n)]
    for i in range(0, n, 7):
        out[i] = sentence(5) + " " + passage + " " + sentence(4)
    for i in range(3, n, 11):
        out[i] = out[i - 1]
    out[5] = out[4].replace(" ", "\n ")
    out += ["", None, " \t\n", "a", "ab" * 400, sentence(4000), "a" * 60, "a" * 61, out[0], out[0], None]
    return out
