"""Text features as Column expressions: no Python runs over the texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) if cols else F.lit(0)


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _holds(words, low: bool = False):
    """A predicate: whether an item contains one of ``words``."""
    return lambda x: _any([F.contains(F.lower(x) if low else x, F.lit(w)) for w in words])


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def report_text(summary: str, description: str) -> Column:
    """Summary and description as one text, without blanks at its ends."""
    return F.trim(F.concat(F.coalesce(F.col(summary), F.lit("")), F.lit(" "), F.coalesce(F.col(description), F.lit(""))))


def structural_flags(text: Column) -> dict[str, Column]:
    return {"has_stacktrace": F.rlike(text, F.lit(L.STACKTRACE)), "has_code": F.rlike(text, F.lit(L.CODE)), "has_patch": F.rlike(text, F.lit(L.PATCH)), "has_enumeration": F.rlike(text, F.lit(L.ENUMERATION))}


def ambiguity(text: Column, terms=L.VAGUE_TERMS, phrases=L.VAGUE_PHRASES) -> Column:
    """Vague tokens and phrases per alphabetic token; 0 without tokens. A term of two words is never one token."""
    low = F.lower(text)
    n = _count(low, r"\b[a-zA-Z]+\b")
    words = [re.escape(t) for t in terms if t.isalpha()]
    hits = _sum([_count(low, r"(?<![\w])(?:" + "|".join(words) + r")(?![\w])".replace(r"\w", r"\p{L}\p{N}_"))] * bool(words) + [_count(low, p) for p in phrases])
    return F.coalesce(F.try_divide(hits.cast("double"), n), F.lit(0.0))


def _marker_count(low: Column, markers) -> Column:
    words = [re.escape(m) for m in markers if " " not in m]
    whole = [_count(low, r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")] if words else []
    return _sum(whole + [_count(low, re.escape(m)) for m in markers if " " in m])


def sentence_guess(text: Column) -> Column:
    """Runs of sentence ends, at least 1."""
    return F.greatest(_count(text, "[.!?]+"), F.lit(1))


def markers(text: Column, causal=L.CAUSAL, temporal=L.TEMPORAL, sentences: Column | None = None) -> dict[str, Column]:
    low, n = F.lower(text), sentence_guess(text) if sentences is None else F.greatest(sentences, F.lit(1))
    c, t = _marker_count(low, causal), _marker_count(low, temporal)
    return {"num_causal_markers": c, "num_temporal_markers": t, "causal_density": c / n, "temporal_density": t / n}


def context(text: Column, systems=L.OS_TERMS, browsers=L.BROWSER_TERMS, environments=L.ENV_TERMS) -> dict[str, Column]:
    """How many different terms the text contains, as substrings."""
    low = F.lower(text)
    found = lambda terms: _sum([F.contains(low, F.lit(t)).cast("int") for t in terms])
    versions = _count(text, L.VERSION)
    return {"num_os_mentions": found(systems), "num_browser_mentions": found(browsers), "num_env_mentions": found(environments), "num_versions": versions, "has_os_info": found(systems) > 0, "has_version_info": versions > 0}


def modality(text: Column, positive=L.POSITIVE_MODALS, negative=L.NEGATIVE_MODALS, sentences: Column | None = None) -> dict[str, Column]:
    """Substring counts; "should not" counts in both lists."""
    low, n = F.lower(text), sentence_guess(text) if sentences is None else F.greatest(sentences, F.lit(1))
    p, m = (_sum([_count(low, re.escape(x)) for x in xs]) for xs in (positive, negative))
    return {"num_modal_verbs": p + m, "num_negative_modals": m, "modal_density": (p + m) / n}


def exceptions(text: Column, flag: Column | None = None, categories=L.EXCEPTIONS, libraries=L.LIBRARY_PACKAGES) -> dict[str, Column]:
    """What a stack trace says. Without a trace (``flag`` false) all is 0 or null; exc_cat_assertion is null then."""
    names = F.regexp_extract_all(text, F.lit(L.EXCEPTION_NAME), F.lit(1))
    distinct = F.array_sort(F.array_distinct(names))
    frames = F.regexp_extract_all(text, F.lit(r"at\s+([a-zA-Z0-9_.]+)\."), F.lit(1))
    n = F.size(frames)
    library = F.size(F.filter(frames, lambda f: _any([F.startswith(f, F.lit(p)) for p in libraries])))
    dots = F.aggregate(F.transform(frames, lambda f: F.length(f) - F.length(F.replace(f, F.lit("."), F.lit("")))), F.lit(0), lambda a, b: a + b)
    on = F.lit(True) if flag is None else flag
    gate = lambda e, empty: F.when(on, e).otherwise(empty)
    out = {
        "primary_exception_type": gate(F.get(distinct, F.lit(0)), F.lit(None).cast("string")),
        "num_exception_types": gate(F.size(distinct), F.lit(0)),
        "stacktrace_depth": gate(_count(text, r"(?mUd)^\s*at\s+.+"), F.lit(0)),
        "num_caused_by": gate(_count(text, "Caused by:"), F.lit(0)),
    }
    for c, types in categories.items():
        hits = F.size(F.filter(names, _holds(types)))
        out[f"exc_cat_{c}"] = gate(hits, F.lit(None).cast("int") if c == "assertion" else F.lit(0))
        out[f"has_exc_{c}"] = gate((hits > 0).cast("int"), F.lit(0))
    return out | {
        "exception_library_frames": gate(library, F.lit(0)),
        "exception_user_frames": gate(n - library, F.lit(0)),
        "exception_user_frame_ratio": gate(F.coalesce(F.try_divide((n - library).cast("double"), n), F.lit(0.0)), F.lit(0.0)),
        "exception_avg_frame_package_depth": gate(F.coalesce(F.try_divide(dots.cast("double"), n), F.lit(0.0)), F.lit(0.0)),
    }


def completeness(text: Column, has_stacktrace: Column, has_code: Column, steps: Column | None = None, behaviour: Column | None = None) -> Column:
    """0 to 5. ``steps`` and ``behaviour`` (expected and observed) overrule the patterns where they aren't null."""
    low = F.lower(text)
    seen = lambda patterns: _any([F.rlike(low, F.lit(p)) for p in patterns])
    s, b = seen(L.STEPS), seen(L.EXPECTED) & seen(L.OBSERVED)
    s, b = (e if o is None else F.coalesce(o, e) for e, o in ((s, steps), (b, behaviour)))
    return _sum([c.cast("double") for c in (F.length(F.trim(text)) > 50, has_stacktrace, has_code, s, b)])


WORD = "[A-Za-z0-9_]+"


def text_stats(text: Column, prefix: str, hedges=L.HEDGES) -> dict[str, Column]:
    """14 numbers of a text; ratios over nothing are null; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    low, chars, words = F.lower(t), F.length(t), _count(t, WORD)
    lines = _count(t, "\n") + F.when(t != "", 1).otherwise(0)
    hedged = _sum([_count(low, re.escape(h)) for h in hedges])
    tokens = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    # words never reach over a sentence end, and sentences without words count as long as they aren't blank
    sentences = _count(t, r"[^.!?\s][^.!?]*")
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    out = {
        "char_len": chars, "word_count": words, "line_count": lines, "avg_word_len": d(chars, words), "avg_words_per_line": d(words, lines), "avg_sentence_len": d(words, sentences),
        "hedge_count": hedged, "hedge_density": d(hedged, words), "has_code_like": F.rlike(low, F.lit(L.CODE_LIKE)).cast("int"), "question_density": d(_count(t, r"\?"), words),
        "exclaim_density": d(_count(t, "!"), words), "digit_density": d(_count(t, r"\p{Nd}"), chars), "uniq_word_ratio": d(F.size(F.array_distinct(tokens)), F.size(tokens)), "is_missing": (F.trim(t) == "").cast("int"),
    }
    return {f"{prefix}_{k}": v for k, v in out.items()}


def readability(text: Column, shortest: int = 100) -> dict[str, Column]:
    """Published closed forms on characters, words, sentences and a syllable count by vowel groups; null for short texts.

    Sentences are runs of sentence ends and syllables vowel groups, so values are near to, not the same as, those of a
    linguistic tokenizer.
    """
    vowels = "aeiouyàâäáãåéèêëíìîïóòôöõúùûüœæ"
    # A short text is null from here on, rather than in each formula: what is counted under a condition is counted anew wherever it is used.
    long = F.when(F.length(text) >= shortest, text)
    low = F.lower(long)
    # What stays of a text is as long as what is counted: no list of matches is made. Of a run its first letter stays.
    left = lambda t, pattern: F.length(F.regexp_replace(t, F.lit(pattern), F.lit(""))).cast("double")
    words = left(long, r"[^\p{L}\p{N}']++|(?<=[\p{L}\p{N}'])[\p{L}\p{N}']++")
    chars = left(long, r"[^\p{L}\p{N}]++")
    sentences = sentence_guess(text).cast("double")
    syllables = F.greatest(left(low, f"[^{vowels}]++|(?<=[{vowels}])[{vowels}]++"), words)
    # The first match in a run of letters begins with the run and takes it whole.
    hard = _count(low, rf"(?:[^\P{{L}}{vowels}]*+[{vowels}]){{3}}\p{{L}}*+").cast("double")
    long_words = _count(long, r"[\p{L}\p{N}]{7,}+").cast("double")
    wps, spw = F.try_divide(words, sentences), F.try_divide(syllables, words)
    per = lambda x: F.try_divide(x, words)
    out = {
        "flesch_reading_ease": 206.835 - 1.015 * wps - 84.6 * spw,
        "smog_index": 1.043 * F.sqrt(hard * F.try_divide(F.lit(30.0), sentences)) + 3.1291,
        "gunning_fog": 0.4 * (wps + 100 * per(hard)),
        "coleman_liau_index": 0.0588 * 100 * per(chars) - 0.296 * 100 * per(sentences) - 15.8,
        "automated_readability_index": 4.71 * per(chars) + 0.5 * wps - 21.43,
        "kincaid_grade": 0.39 * wps + 11.8 * spw - 15.59,
        "lix": wps + 100 * per(long_words),
    }
    return {"n_sentences": sentences.cast("int")} | out


def parse_list(c: Column) -> Column:
    """A list in a string: a JSON array's items, a JSON object's keys, or parts between ; , | and newlines; lower-cased, blanks collapsed, none empty."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).when(F.startswith(raw, F.lit("{")), F.map_keys(F.from_json(raw, "map<string,string>")))
    items = F.coalesce(items, F.split(raw, r"[;,|\n]+"))
    tidy = F.transform(items, lambda x: F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"\s+", " "))
    return F.filter(tidy, lambda x: x != "")


def ambiguity_types(items: Column, categories=L.AMBIGUITY) -> dict[str, Column]:
    flags = {f"has_{k}": F.exists(items, _holds(kw, low=True)).cast("int") for k, kw in categories.items()}
    return flags | {"ambiguity_type_count": F.size(items), "ambiguity_category_coverage": _sum(list(flags.values()))}


def concept_layers(items: Column, layers=L.LAYERS) -> dict[str, Column]:
    counts = {k: F.size(F.filter(items, _holds(kw))) for k, kw in layers.items()}
    diversity = _sum([(c > 0).cast("int") for c in counts.values()])
    out = {"concept_diversity": diversity, "has_cross_layer_concepts": (diversity > 1).cast("int"), "concept_breadth": F.size(F.array_distinct(items))}
    return out | {f"{k}_concepts": c for k, c in counts.items()}


def clean_response(c: Column) -> Column:
    """A model's answer without code fences around it."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))


def valid_category(c: Column, known=L.BUG_CATEGORIES, default: str = "Functional Issue") -> Column:
    return F.when(c.isin(*known), c).otherwise(F.lit(default))


def prompt(template: str, **parts: Column) -> Column:
    """``template`` with {name} replaced by the named columns; nulls are empty."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(parts[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
