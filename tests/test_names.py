"""Names against a catalogue, by brute force."""

import random
import unicodedata

from lodestone.functions.similarity import ratio
from lodestone.operators import names


def test_no_like_pair_is_lost_and_few_meet(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij_-.") for _ in range(n))
    entries = [word(rng.randrange(1, 40)) for _ in range(120)] + ["", "a", "ab", "aaaa" * 5]
    files = ["", "a", "b", "aaaa" * 4, "ba"]
    for e in entries:
        for _ in range(3):
            x = list(e)
            for _ in range(rng.randrange(0, 2 + len(e) // 6)):
                at = rng.randrange(len(x) + 1)
                if rng.random() < 0.5:
                    x.insert(at, rng.choice("abcxyz"))
                elif x:
                    del x[min(at, len(x) - 1)]
            files.append("".join(x))
    left = spark.createDataFrame([(f,) for f in files] + [(None,)], "name string")
    right = spark.createDataFrame([(e,) for e in entries] + [(None,)], "entry string")
    for least in (0.85, 0.9, 0.7):
        want = {(f, e) for f in set(files) for e in set(entries) if f and e and ratio(f, e) >= least}
        assert {(r["name"], r["entry"]) for r in names.alike(left, right, least).collect()} == want
    met = names.candidates(left, right, 0.9).count()
    assert met < len(set(files)) * len(set(entries)) / 10


def test_names_are_composed_and_ties_ordered(spark):
    files = spark.createDataFrame([(unicodedata.normalize("NFD", "résumé_1.pdf"),), ("report_a.pdf",), ("zzz",), (None,)], "name string")
    entries = spark.createDataFrame([("résumé_1.pdf",), ("report_c.pdf",), ("report_b.pdf",)], "entry string")
    got = {r["name"]: (r["entry"], r["score"], r["rivals"]) for r in names.catalogued(files, entries).collect()}
    assert got == {unicodedata.normalize("NFD", "résumé_1.pdf"): ("résumé_1.pdf", 1.0, 0), "report_a.pdf": ("report_b.pdf", round(ratio("report_a.pdf", "report_b.pdf"), 6), 1), "zzz": (None, None, 0)}
