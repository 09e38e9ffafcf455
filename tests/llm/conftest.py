"""Documents with every oddity the operators must survive: null columns, empty
and long texts, ties, repeated rows and ids, columns with clashing names."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use for their own columns, inside or in results
EXTRA = ("score string, slot string, shard string, shard_name string, component_id string, fp string, row_key string, "
         "twin string, bucket string, kind string, data string, size string, copies string, lang_pred string, "
         "held_out string, kept string, u string, v string, `a.b` string, `__slot_of_key` string")
PROSE = {"en": "the cat and the dog walk in the garden while it rains on the old house by the river".split(),
         "de": "der hund und die katze gehen durch den garten und es regnet auf das alte haus am fluss".split(),
         "fr": "le chat et le chien marchent dans le jardin pendant que la pluie tombe sur la vieille maison".split()}


def prose(lang, seed, n):
    import random
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(PROSE[lang]) for _ in range(n))


def odd_rows():
    long_text = prose("en", 99, 30_000)
    rows = [(1, prose("en", 1, 120), "en", "a", 1), (2, prose("de", 2, 130), "de", "a", 2), (3, None, "en", "b", None),
            (4, "", "fr", "b", 0), (5, " \n\t ", None, None, 4), (6, prose("fr", 6, 140), None, "c", 6),
            (7, prose("en", 1, 120), "en", "c", 7), (7, prose("en", 1, 120), "en", "c", 7),     # a copy, twice
            (8, prose("en", 8, 90), None, None, None), (8, prose("de", 88, 80), "de", "a", 8),  # one id, two texts
            (None, prose("en", 1, 120), "en", "a", 1), (None, None, None, None, None),
            (9, long_text, "en", "a", 9), (10, "x", "en", "d", 1), (11, "1234 5678 !!", "en", "d", 1),
            (12, "a" * 300, "en", "d", 300), (13, "a" * 200 + "ß" * 40, "de", "d", 240), (14, "x", "en", "d", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, *["x"] * 20) for r in odd_rows()]
    return spark.createDataFrame(rows, f"{DOC}, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{DOC}, {EXTRA}")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, parts=3):
        rows = [(i, t, "en", "s", 0) for i, t in texts]
        return spark.createDataFrame(rows, DOC).repartition(parts)
    return make
