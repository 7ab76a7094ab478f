"""Text features over documents. Besides the usual word lists these queries count words that the documents hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from .base import query, table

_CAUSAL, _TEMPORAL = (*L.CAUSAL, "the", "la", "of the"), (*L.TEMPORAL, "on", "de")
_VAGUE = (*L.VAGUE_TERMS, "the", "in", "license")


#: What reports end in, by the remainder of their id: documents and pages alone hold no traces, code, patches or steps.
_ENDS = (
    "",
    "\nException in thread main java.lang.NullPointerException: x\n    at com.acme.Foo.bar(Foo.java:10)\n    at java.util.List.get(List.java:5)\nCaused by: java.io.IOException: y\n    at com.acme.deep.pkg.Baz.run(Baz.java:1)",
    "\n```\npublic class Foo {\n```\nIt cannot load. Maybe it might not work?",
    "\ndiff --git a b\n+++ a\nAssertionError and TypeError, then AssertionError; why? The server should not fail.",
    "\n1. Open the page\n2. Steps to reproduce: line 5\nExpected a result but got none on linux 2.4.1",
)


def _reports(spark, sf_dir, name="documents", key="doc_id", text="text"):
    """Whole texts, each with its end behind it."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col(key) % len(_ENDS) + 1).cast("int"))
    return table(spark, sf_dir, name).select(key, F.concat(text, end).alias("text"))


def _reports_sql(name="documents", key="doc_id", text="text") -> str:
    ends = ", ".join("E'" + e.replace("\n", "\\n") + "'" for e in _ENDS)
    return f"(SELECT {key}, {text} || ([{ends}])[({key} % {len(_ENDS)} + 1)::INT] AS text FROM {name})"


def _docs(spark, sf_dir):
    return _reports(spark, sf_dir)


_DOCS = _reports_sql()


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_ALPHA = rf"list_filter({_WORDS}, lambda x: regexp_full_match(x, '[a-zA-Z]+'))"
_SENT = "greatest(len(regexp_extract_all(text, '[.!?]+')), 1)"


def _phrases(xs, low="lower(text)") -> str:
    return " + ".join(f"len(regexp_extract_all({low}, '{x}'))" for x in xs) or "0"


def _plain(x: str) -> str:
    return x.replace("'", "''").replace("-", r"\-")


@query("text_structural_flags", r"""SELECT doc_id, regexp_matches(text, '(?im)(Exception|Error|Throwable|at\s+[a-zA-Z0-9_.]+\([^)]*\)|^\s*at\s+|Caused\s+by:|Stack\s+trace:)') AS has_stacktrace,
 regexp_matches(text, '(?m)```|(?:public|private|protected|static)\s+(?:class|void|int|String)|(?:^|\n)(?:def|class|import|from\s+\w+\s+import)\s+|(?:^|\n)\s*function\s+\w+\s*\(|#include\s*<|(?:^|\n)\s{4,}\w+.*[;{]') AS has_code,
 regexp_matches(text, '(?m)diff --git|\.patch\b|commit [0-9a-f]{6,40}\b|^\+{3}\s+|^-{3}\s+|^@@.*@@') AS has_patch,
 regexp_matches(text, '(?m)(?:^|\n)\s*(?:\d+[.)]|[-*])\s+[A-Z\p{L}\p{N}_]') AS has_enumeration FROM """ + _DOCS)
def text_structural_flags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[e.alias(n) for n, e in X.structural_flags(F.col("text")).items()])


@query("text_ambiguity", f"SELECT doc_id, round(coalesce((len(list_filter({_WORDS}, lambda x: list_contains({_list([t for t in _VAGUE if t.isalpha()])}, x))) + {_phrases(L.VAGUE_PHRASES)})::DOUBLE / nullif(len({_ALPHA}), 0), 0), 9) AS ambiguity FROM {_DOCS}")
def text_ambiguity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.ambiguity(F.col("text"), terms=_VAGUE), 9).alias("ambiguity"))


def _marks(xs) -> str:
    words = [x for x in xs if " " not in x]
    return f"(len(list_filter({_WORDS}, lambda x: list_contains({_list(words)}, x))) + {_phrases([x for x in xs if ' ' in x])})"


@query("text_markers", f"SELECT doc_id, {_marks(_CAUSAL)}::INT AS num_causal_markers, {_marks(_TEMPORAL)}::INT AS num_temporal_markers, round({_marks(_CAUSAL)}::DOUBLE / {_SENT}, 9) AS causal_density, round({_marks(_TEMPORAL)}::DOUBLE / {_SENT}, 9) AS temporal_density FROM {_DOCS}")
def text_markers(spark, sf_dir):
    m = X.markers(F.col("text"), _CAUSAL, _TEMPORAL)
    return _docs(spark, sf_dir).select("doc_id", *[(F.round(e, 9) if n.endswith("density") else e).alias(n) for n, e in m.items()])


_OS, _BR, _EN = (*L.OS_TERMS, "tion"), (*L.BROWSER_TERMS, "the"), (*L.ENV_TERMS, "license")
_has = lambda xs: "(" + " + ".join(f"contains(lower(text), '{x}')::INT" for x in xs) + ")"


@query("text_context", f"SELECT doc_id, {_has(_OS)}::INT AS num_os_mentions, {_has(_BR)}::INT AS num_browser_mentions, {_has(_EN)}::INT AS num_env_mentions, len(regexp_extract_all(text, '{L.VERSION}'))::INT AS num_versions, {_has(_OS)} > 0 AS has_os_info, len(regexp_extract_all(text, '{L.VERSION}')) > 0 AS has_version_info FROM {_DOCS}")
def text_context(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[e.alias(n) for n, e in X.context(F.col("text"), _OS, _BR, _EN).items()])


_POS, _NEG = (*L.POSITIVE_MODALS, "ond", "the"), (*L.NEGATIVE_MODALS, "not")
_PC, _NC = f"({_phrases(map(_plain, _POS))})", f"({_phrases(map(_plain, _NEG))})"


@query("text_modality", f"SELECT doc_id, ({_PC} + {_NC})::INT AS num_modal_verbs, {_NC}::INT AS num_negative_modals, round(({_PC} + {_NC})::DOUBLE / {_SENT}, 9) AS modal_density FROM {_DOCS}")
def text_modality(spark, sf_dir):
    m = X.modality(F.col("text"), _POS, _NEG)
    return _docs(spark, sf_dir).select("doc_id", *[(F.round(e, 9) if n.endswith("density") else e).alias(n) for n, e in m.items()])


_any = lambda xs: "(" + " OR ".join(f"regexp_matches(lower(text), '{x}')" for x in xs) + ")"


@query("text_completeness", f"SELECT doc_id, ((length(trim(text)) > 50)::INT + regexp_matches(text, '(?i)license')::INT + contains(text, '|')::INT + {_any(L.STEPS)}::INT + ({_any(L.EXPECTED)} AND {_any(L.OBSERVED)})::INT)::DOUBLE AS completeness_score FROM {_DOCS}")
def text_completeness(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.completeness(t, F.rlike(t, F.lit("(?i)license")), F.contains(t, F.lit("|"))).alias("completeness_score"))


_H = f"({_phrases(map(_plain, (*L.HEDGES, 'tion')))})"
_W = "len(regexp_extract_all(text, '[A-Za-z0-9_]+'))"


@query("text_stats", f"""SELECT doc_id, length(text)::INT AS txt_char_len, {_W}::INT AS txt_word_count, (len(regexp_extract_all(text, '\\n')) + (text <> '')::INT)::INT AS txt_line_count, round(length(text)::DOUBLE / nullif({_W}, 0), 9) AS txt_avg_word_len,
 round({_W}::DOUBLE / nullif(len(regexp_extract_all(text, '\\n')) + (text <> '')::INT, 0), 9) AS txt_avg_words_per_line,
 round({_W}::DOUBLE / nullif(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]'))), 0), 9) AS txt_avg_sentence_len,
 {_H}::INT AS txt_hedge_count, round({_H}::DOUBLE / nullif({_W}, 0), 9) AS txt_hedge_density, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(stack trace|exception|nullpointer|assert|traceback|line [0-9]+)($|[^\\p{{L}}\\p{{N}}_])')::INT AS txt_has_code_like,
 round(len(regexp_extract_all(text, '[?]'))::DOUBLE / nullif({_W}, 0), 9) AS txt_question_density, round(len(regexp_extract_all(text, '!'))::DOUBLE / nullif({_W}, 0), 9) AS txt_exclaim_density, round(len(regexp_extract_all(text, '[0-9]'))::DOUBLE / nullif(length(text), 0), 9) AS txt_digit_density,
 round(len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')))::DOUBLE / nullif(len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')), 0), 9) AS txt_uniq_word_ratio, (trim(text) = '')::INT AS txt_is_missing FROM {_DOCS}""")
def text_stats(spark, sf_dir):
    s = X.text_stats(F.col("text"), "txt", hedges=(*L.HEDGES, "tion"))
    return _docs(spark, sf_dir).select("doc_id", *[(F.round(e, 9) if any(k in n for k in ("avg", "density", "ratio")) else e).alias(n) for n, e in s.items()])


_CATS = {c: "len(list_filter(names, lambda x: " + " OR ".join(f"contains(x, '{t}')" for t in types) + "))" for c, types in L.EXCEPTIONS.items()}
_LIBRARY = " OR ".join(f"starts_with(x, '{p}')" for p in L.LIBRARY_PACKAGES)


@query("exception_semantics", rf"""WITH e AS (SELECT *, regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*(?:Exception|Error|Throwable))\b', 1) AS names, regexp_extract_all(text, 'at\s+([a-zA-Z0-9_.]+)\.', 1) AS frames FROM {_reports_sql("pages", "page_id", "html")}),
 f AS (SELECT *, list_sort(list_distinct(names)) AS kinds, len(list_filter(frames, lambda x: {_LIBRARY})) AS library, len(frames) AS n FROM e)
 SELECT page_id, kinds[1] AS primary_exception_type, len(kinds)::INT AS num_exception_types, len(regexp_extract_all(text, 'Caused by:'))::INT AS num_caused_by, len(regexp_extract_all(text, '(?m)^\s*at\s+.+'))::INT AS stacktrace_depth,
 {", ".join(f"({e})::INT AS exc_cat_{c}, (({e}) > 0)::INT AS has_exc_{c}" for c, e in _CATS.items() if c in ("null_pointer", "type_error", "io_error", "assertion"))},
 library::INT AS exception_library_frames, (n - library)::INT AS exception_user_frames, round(coalesce((n - library)::DOUBLE / nullif(n, 0), 0), 9) AS exception_user_frame_ratio,
 round(coalesce(list_sum(list_transform(frames, lambda x: len(x) - len(replace(x, '.', ''))))::DOUBLE / nullif(n, 0), 0), 9) AS exception_avg_frame_package_depth FROM f""")
def exception_semantics(spark, sf_dir):
    e = X.exceptions(F.col("text"))
    plain = ["primary_exception_type", "num_exception_types", "num_caused_by", "stacktrace_depth", *[f"{k}_{c}" for c in ("null_pointer", "type_error", "io_error", "assertion") for k in ("exc_cat", "has_exc")], "exception_library_frames", "exception_user_frames"]
    ratios = ["exception_user_frame_ratio", "exception_avg_frame_package_depth"]
    return _reports(spark, sf_dir, "pages", "page_id", "html").select("page_id", *[e[c].alias(c) for c in plain], *[F.round(e[c], 9).alias(c) for c in ratios])


@query("readability_characters", r"""WITH c AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[\p{L}\p{N}'']+'))::DOUBLE AS w, len(regexp_extract_all(text, '[\p{L}\p{N}]'))::DOUBLE AS c, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS s, len(regexp_extract_all(text, '[\p{L}\p{N}]{7,}'))::DOUBLE AS l FROM """ + _DOCS + r""")
 SELECT doc_id, s::INT AS n_sentences, CASE WHEN n >= 100 THEN round(0.0588::DOUBLE * 100 * (c / w) - 0.296::DOUBLE * 100 * (s / w) - 15.8::DOUBLE, 6) END AS coleman_liau_index, CASE WHEN n >= 100 THEN round(4.71::DOUBLE * (c / w) + 0.5::DOUBLE * (w / s) - 21.43::DOUBLE, 6) END AS automated_readability_index, CASE WHEN n >= 100 THEN round(w / s + 100 * (l / w), 6) END AS lix FROM c""")
def readability_characters(spark, sf_dir):
    r = X.readability(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", r["n_sentences"].alias("n_sentences"), *[F.round(r[c], 6).alias(c) for c in ("coleman_liau_index", "automated_readability_index", "lix")])


@query("readability_scores")
def readability_scores(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[e.alias(n) for n, e in X.readability(F.col("text")).items()])


_ITEMS = "list_filter(list_transform(regexp_split_to_array(replace(p_name, ' ', ';') || CASE WHEN p_size % 2 = 0 THEN ';Red  Bolt, ring' ELSE '' END, '[;,|\\n]+'), lambda x: regexp_replace(lower(trim(x)), '\\s+', ' ', 'g')), lambda x: x <> '')"


_LAYERS = {"ui": ("ring", "gui"), "logic": ("red", "rule"), "data": ("bolt", "sql"), "network": ("gear", "api"), "infra": ("blue", "security")}


@query("concept_layers", f"""WITH i AS (SELECT p_partkey, {_ITEMS} AS items FROM part), c AS (SELECT p_partkey, items, {", ".join(f"len(list_filter(items, lambda x: {' OR '.join(f'''contains(x, '{w}')''' for w in kw)})) AS {k}" for k, kw in _LAYERS.items())} FROM i)
 SELECT p_partkey, ((ui > 0)::INT + (logic > 0)::INT + (data > 0)::INT + (network > 0)::INT + (infra > 0)::INT)::INT AS concept_diversity, ((ui > 0)::INT + (logic > 0)::INT + (data > 0)::INT + (network > 0)::INT + (infra > 0)::INT > 1)::INT AS has_cross_layer_concepts, len(list_distinct(items))::INT AS concept_breadth, ui::INT AS ui_concepts, logic::INT AS logic_concepts, data::INT AS data_concepts, network::INT AS network_concepts, infra::INT AS infra_concepts FROM c""")
def concept_layers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", X.parse_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.when(F.col("p_size") % 2 == 0, F.lit(";Red  Bolt, ring")).otherwise(F.lit("")))).alias("items"))
    return p.select("p_partkey", *[e.alias(n) for n, e in X.concept_layers(F.col("items"), _LAYERS).items()])


_AMB = {"reproduction_ambiguity": ("promo", "missing steps"), "input_ambiguity": ("ring",), "error_ambiguity": ("red", "tin"), "context_ambiguity": ("a",), "behavior_ambiguity": ("economy",)}
_FL = {k: "list_bool_or(list_transform(items, lambda x: " + " OR ".join(f"contains(x, '{w}')" for w in kw) + "))::INT" for k, kw in _AMB.items()}


@query("ambiguity_types", f"WITH i AS (SELECT p_partkey, list_filter(string_split(lower(CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_type || ' ' || p_name END), ' '), lambda x: x <> '') AS items FROM part) SELECT p_partkey, {', '.join(f'{e} AS has_{k}' for k, e in _FL.items())}, len(items)::INT AS ambiguity_type_count, ({' + '.join(_FL.values())})::INT AS ambiguity_category_coverage FROM i")
def ambiguity_types(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", X.parse_list(F.replace(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" "), "p_name")), F.lit(" "), F.lit(","))).alias("items"))
    return p.select("p_partkey", *[e.alias(n) for n, e in X.ambiguity_types(F.col("items"), _AMB).items()])


@query("parse_list_json", "SELECT event_id, form, items, len(items)::INT AS n FROM (SELECT event_id, 0 AS form, list_transform(json_keys(props), lambda x: lower(x)) AS items FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, 1, ['x y', event_type] FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, 2, ['a', 'b', event_type] FROM events WHERE props IS NOT NULL)")
def parse_list_json(spark, sf_dir):
    """Each event's own object, and its type in the two other forms that lists come in."""
    forms = F.array("props", F.concat(F.lit('["X  y", "'), "event_type", F.lit('"]')), F.concat(F.lit("a; B,"), "event_type"))
    e = table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.posexplode(forms).alias("form", "text"))
    return e.select("event_id", "form", X.parse_list(F.col("text")).alias("items")).withColumn("n", F.size("items"))


@query("prompt_column", "SELECT conv_id, turn, 'Rate ' || coalesce(role, '') || ': ' || coalesce(text, '') AS prompt FROM conversations")
def prompt_column(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.prompt("Rate {role}: {text}", role=F.col("role"), text=F.col("text")).alias("prompt"))


@query("valid_categories", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'Functional Issue' END AS category FROM orders")
def valid_categories(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.valid_category(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH")).alias("category"))
