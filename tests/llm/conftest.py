import pytest

# Columns that clash with working names, beside those an operator reads.
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, kept string, ids string, n_words string, root string, node string, task string, m string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = []
        for r in rows:
            r = (*r, *(None,) * (4 - len(r)))
            full.append((*r, None if r[1] is None else len(r[1]), 7, "t", "k", "i", "w", "r", "n", "t", "m"))
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def prose():
    import random

    def make(n, seed):
        rnd = random.Random(seed)
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
        return " ".join(rnd.choice(words) for _ in range(n))

    return make
