"""Text and similarity functions against plain Python."""

import random
import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.functions.similarity import Lanes, indel_ratio, ratio
from lodestone.plans.settings import Settings, load


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float, list, dict)) else {int: 'int', float: 'double', list: 'array<double>', dict: 'map<string,string>'}[type(v)]}" for k, v in values.items()))
    return frame.select(column).first()[0]


def test_normalized(spark):
    cases = {None: "", "???": "", "  What   IS it??  ": "what is it", "ＡＢ…": "ab", "a\u00a0\u3000b": "a b", "문이 잠겼나요?": "문이 잠겼나요", "it's (ok)": "it's (ok", "a\r\n\tb": "a b"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.normalized(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases


def test_clean_and_numbers(spark):
    assert one(spark, T.clean(F.col("t")), t=" \u00a0 ") is None
    assert one(spark, T.clean(F.col("t")), t=" a b ") == "a b"
    got = spark.createDataFrame([("12",), (" 12 ",), ("12.7",), ("x",), (None,)], "t string").select(T.integer(F.col("t"))).collect()
    assert [r[0] for r in got] == [12, 12, 12, None, None]
    assert one(spark, T.numbers(F.col("t")), t="1,200 of 3.5 and 7") == ["1200", "3.5", "7"]
    assert one(spark, T.truth(F.col("t"), False), t=" Yes ") is True
    assert one(spark, T.truth(F.col("t"), True), t="") is True
    assert one(spark, T.number(F.col("t"), 0.5), t="abc") == 0.5


def test_file_names_keep_their_order(spark):
    assert one(spark, T.file_names(F.col("t")), t="b.pdf, c.pdf;b.pdf\n a.pdf/ ") == ["b.pdf", "c.pdf", "a.pdf"]
    assert one(spark, T.file_names(F.col("t").cast("string")), t="") == []


def test_masked_error(spark):
    got = one(spark, T.masked_error(F.lit("OSError"), F.col("t")), t="no C:\\a\\b or /x/y/z key ABCDEFGHIJKLMNOPQRSTUVWX\nsecond")
    assert got == "OSError: no <path> or <path> key <redacted>"
    assert one(spark, T.masked_error(F.lit("OSError"), F.col("t")), t="") == "OSError: OSError"


def test_safe_map(spark):
    assert one(spark, T.safe_map(F.col("m")), m={"Token": "a", "k": "1", "PASSWORD": "b"}) == {"k": "1"}


def test_evidence_names(spark):
    assert one(spark, T.evidence_name(F.lit(2), F.col("p"), F.lit(True), F.lit(".jpg")), p="7") == "ev2_p0007_table.jpg"
    assert one(spark, T.evidence_name(F.lit(1), F.col("p"), F.lit(False), F.lit("")), p="x") == "ev1_p0000.png"
    assert one(spark, T.is_run_id(F.col("p")), p="run_1-a") is True
    assert one(spark, T.is_run_id(F.col("p")), p="../x") is False


def test_bigrams(spark):
    assert one(spark, T.char_bigrams(F.col("t")), t="abca") == ["ab", "bc", "ca"]
    assert one(spark, T.char_bigrams(F.col("t")), t="a") == []
    assert one(spark, T.char_bigrams(F.col("t")), t="") == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_ratio_is_the_plain_one(a, b):
    n = len(a) + len(b)
    assert ratio(a, b) == (1.0 if not n else ((1.0 - (n - 2 * lcs(a, b)) / n) * 100.0) / 100.0)
    assert ratio(a, b) == ratio(b, a)
    assert 0 <= ratio(a, b) <= 1


@given(st.lists(st.text("abc ", max_size=140), min_size=1, max_size=6), st.text("abc ", max_size=140))
def test_lanes_are_single_ratios(texts, text):
    assert Lanes(texts).ratios(text).tolist() == [ratio(text, t) for t in texts]


def test_ratio_column(spark):
    rows = [("kitten", "sitting"), ("", ""), ("a", None), ("문이 잠겼나요", "문이 닫혔나요")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(indel_ratio("a", "b")).collect()]
    assert [None if x is None else round(x, 4) for x in got] == [0.6154, 1.0, None, 0.7143]


def test_vectors(spark):
    assert one(spark, V.dot(F.col("a"), F.col("a")), a=[3.0, 4.0]) == 25.0
    assert one(spark, V.cosine(F.col("a"), F.col("a")), a=[0.0, 0.0]) is None


def test_nfkc_leaves_plain_text(spark):
    rng = random.Random(5)
    texts = ["".join(chr(rng.randint(32, 0x3000)) for _ in range(20)) for _ in range(50)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.nfkc("t")).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


def test_settings():
    assert load({}) == Settings()
    got = load({"LODESTONE_THRESHOLD": "0.8", "LODESTONE_WEB_ENABLED": "Yes", "LODESTONE_PAGES": "x", "LODESTONE_MARGIN": ""})
    assert (got.threshold, got.web_enabled, got.pages, got.margin) == (0.8, True, 3, 0.05)


def test_only_wide_texts_go_to_python_and_batches_are_bounded(spark):
    import __spark_entry__ as entry

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    entry.queries()["faq_duplicates"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    rows = spark.createDataFrame([("Plain  Text ",), ("ﬁne　Text",), (None,)], "text string").select(T.normalized(F.col("text")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["plain text", "fine text", ""]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan  # ASCII goes to the UDF as null
