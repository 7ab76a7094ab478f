"""Hand-checked text features."""

from pyspark.sql import functions as F

from rankloom.functions import text as X

SUMMARY = "NPE in Parser.parse() when input is null"
DESCRIPTION = """Steps to reproduce:
1. Call Parser.parse(null)
2. See error

I think it may be related to 1.2.3. Expected: no exception, but got this on Linux:
java.lang.NullPointerException: x
  at org.acme.Parser.parse(Parser.java:10)
  at java.util.List.get(List.java:5)
Caused by: java.io.IOException: y
It should not fail because the server is fine."""


def one(spark, cols, text=f"{SUMMARY} {DESCRIPTION}"):
    return spark.createDataFrame([(text,)], "t string").select(*[e.alias(n) for n, e in cols.items()]).first()


def test_flags_and_ambiguity(spark):
    t = F.col("t")
    r = one(spark, {**X.structural_flags(t), "ambiguity": X.ambiguity(t)})
    assert (r.has_stacktrace, r.has_code, r.has_patch, r.has_enumeration) == (True, False, False, True)
    assert abs(r.ambiguity - 2 / 65) < 1e-12


def test_exceptions(spark):
    r = one(spark, X.exceptions(F.col("t")))
    assert r.primary_exception_type == "IOException" and r.num_exception_types == 2
    assert (r.stacktrace_depth, r.num_caused_by, r.exception_library_frames, r.exception_user_frames) == (2, 1, 1, 1)
    assert r.exception_user_frame_ratio == 0.5 and r.exception_avg_frame_package_depth == 2.0
    assert (r.exc_cat_null_pointer, r.exc_cat_io_error, r.has_exc_io_error, r.exc_cat_assertion) == (1, 1, 1, 0)
    off = one(spark, X.exceptions(F.col("t"), F.lit(False)))
    assert off.exc_cat_assertion is None and off.num_exception_types == 0 and off.primary_exception_type is None


def test_markers_context_modality_completeness(spark):
    t = F.col("t")
    f = X.structural_flags(t)
    r = one(spark, {**X.markers(t), **X.context(t), **X.modality(t), "c": X.completeness(t, f["has_stacktrace"], f["has_code"])})
    assert (r.num_causal_markers, r.num_temporal_markers) == (2, 0)
    assert (r.num_os_mentions, r.num_browser_mentions, r.num_env_mentions, r.num_versions) == (1, 0, 1, 1)
    assert (r.num_modal_verbs, r.num_negative_modals, r.c) == (2, 1, 4.0)


def test_statements_overrule_patterns(spark):
    r = spark.createDataFrame([("x" * 60, False)], "t string, s boolean").select(X.completeness(F.col("t"), F.lit(False), F.lit(False), F.col("s"), F.lit(True)).alias("c")).first()
    assert r.c == 2.0


def test_text_stats(spark):
    r = one(spark, X.text_stats(F.col("t"), "p"), SUMMARY)
    assert (r.p_char_len, r.p_word_count, r.p_line_count, r.p_avg_word_len, r.p_avg_sentence_len, r.p_uniq_word_ratio) == (40, 8, 1, 5.0, 4.0, 1.0)
    empty = one(spark, X.text_stats(F.col("t"), "p"), None)
    assert empty.p_char_len == 0 and empty.p_is_missing == 1 and empty.p_avg_word_len is None and empty.p_uniq_word_ratio is None


def test_lists(spark):
    rows = [('["a","B c"]',), ('{"k":1}',), ("a; b|c",), ("[broken",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.parse_list(F.col("t"))).collect()]
    assert got == [["a", "b c"], ["k"], ["a", "b", "c"], ["[broken"], [], []]


def test_response_clean_up(spark):
    r = spark.createDataFrame([('```json\n{"a": 1}\n```',)], "t string").select(X.clean_response(F.col("t"))).first()
    assert r[0] == '{"a": 1}'


def test_readability_of_short_texts_is_null(spark):
    r = one(spark, X.readability(F.col("t")), "Short text.")
    assert r.lix is None and r.n_sentences == 1


def test_readability_counts_under_no_condition(spark):
    """Under a condition a count is made anew for each formula that uses it: 28 passes over a text rather than six."""
    r = X.readability(F.col("t"))
    assert not any("CASE WHEN" in str(e)[:20] for e in r.values())
    t = "L'été, beautiful queueing areas; 12 idiosyncratic rythms. Zzz ÆØÅ aaa! " * 3
    words, hard, chars = 30, 15, 168
    got = one(spark, {k: r[k] for k in ("gunning_fog", "automated_readability_index")}, t)
    assert got["gunning_fog"] == 0.4 * (words / 6 + 100 * (hard / words)) and abs(got["automated_readability_index"] - (4.71 * chars / words + 0.5 * words / 6 - 21.43)) < 1e-9
