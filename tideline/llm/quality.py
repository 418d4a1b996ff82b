"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms are taken of a text: of classes of characters, and of the commonest words of its
language with all other words as one more bin. A language's references are the sums of these over
all of its documents. The Jensen-Shannon divergence (in bits, 0 to 1) between document and reference
says how unlike the language the document is; symbol soup, tables, code and text of another language
are far off. Short texts have rough histograms by chance and are not judged by them, and neither are
texts whose language has no reference.

Everything is DataFrame functions; a text is looked at within its row and never moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tideline.plans.attach import attach

SPACE = r"\x20\x09-\x0D"
# Classes of characters, each as a set for a regular expression; the rest is one more class.
CLASSES = (r"a-z", r"A-Z", r"0-9", SPACE, r".,;:!?'\"()\-", r"^\x00-\x7F")
SYMBOLS = "#*$%&|<>"
# Ten of the commonest words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "un"),
}
# What lies between the words that are compared: ASCII but for letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    A text of under ``min_words`` words, or with more than ``max_repeat_percent`` of its words in
    repeated windows, fails the base rules. Character classes are judged from ``min_chars``
    characters up and words from ``min_compared`` words up.
    """

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    min_chars: int = 200
    min_compared: int = 40
    max_class_divergence: float = 0.08
    max_word_divergence: float = 0.15
    common_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: COMMON_WORDS)


def _repeat_words(window: int) -> Column:
    """Words inside windows that the text holds twice or more, from ``_sorted``: (hash, place) by hash.

    A window whose neighbour in hash order has the same hash counts; then the places are put together.
    """

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get("_sorted", k)["h"], F.lit(False))

    twice = F.transform("_sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))

    def cover(state: Column, place: Column) -> Column:
        fresh = F.least(F.lit(window), place - state["last"])
        return F.struct(place.alias("last"), (state["total"] + fresh).alias("total"))

    return F.aggregate(F.sort_array(F.array_compact(twice)), start, cover, lambda s: s["total"])


def features(df: DataFrame, rules: Rules, text: str = "text", lang: str = "lang", base: bool = True) -> DataFrame:
    """Add one struct ``_f`` of counts; null texts count as empty. Without ``base`` the histograms only."""
    body = F.coalesce(F.col(text), F.lit(""))
    languages = list(rules.common_words)
    common = F.lit(None).cast("array<string>")
    for name in languages:
        common = F.when(F.col(lang) == name, F.array(*map(F.lit, rules.common_words[name]))).otherwise(common)
    # Windows are compared by 64-bit hashes; only a text with a repeated one is sorted.
    places = F.sequence(F.lit(0), F.col("_n") - rules.window)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(rules.window)]))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = (
        df.withColumn("_words", F.array_remove(F.split(body, f"[{SPACE}]+"), ""))
        .withColumn("_n", F.size("_words"))
        .withColumn("_windows", F.when(F.col("_n") >= rules.window, hashes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
        .withColumn("_lines", F.filter(F.split(body, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")))
        .withColumn("_common", common)
        .withColumn("_parts", F.when(F.col("_common").isNotNull(), F.array_remove(F.split(F.lower(F.regexp_replace(body, BETWEEN, " ")), " "), "")))
    )
    total = F.length(body).cast("long")
    inside = [total - F.length(F.regexp_replace(body, f"[{c}]+", "")) for c in CLASSES]
    classes = F.array(*inside)
    found = F.transform("_common", lambda w: (F.size("_parts") - F.size(F.array_remove("_parts", w))).cast("long"))
    counts = [
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (total - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_sorted").isNotNull(), _repeat_words(rules.window)), F.lit(0)).cast("long").alias("n_repeat_words"),
    ]
    struct = F.struct(
        *(counts if base else []),
        total.alias("chars"),
        classes.alias("classes"),
        F.size("_parts").cast("long").alias("compared"),
        found.alias("common"),
    )
    # A generator: no filter on the counts can move below it and repeat the work inside itself.
    return step.select(*df.columns, F.explode(F.array(struct)).alias("_f"))


def _rest(parts: Column, total: Column) -> Column:
    """The counts with what is in none of them as the last one."""
    return F.concat(parts, F.array(total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)))


def references(counted: DataFrame, rules: Rules, lang: str = "lang") -> DataFrame:
    """Per language the summed histograms ``ref_classes`` and ``ref_words`` of all documents."""
    n = len(CLASSES)
    width = max(map(len, rules.common_words.values()), default=0)
    sums = counted.groupBy(F.col(lang).alias("_lang")).agg(
        F.array(*[F.sum(F.col("_f.classes")[i]) for i in range(n)]).alias("classes"),
        F.sum("_f.chars").alias("chars"),
        F.array(*[F.sum(F.get("_f.common", F.lit(i))) for i in range(width)]).alias("words"),
        F.sum(F.when(F.col("_f.common").isNotNull(), F.col("_f.compared"))).alias("compared"),
        F.max(F.size("_f.common")).alias("width"),
    )
    words = F.when(F.col("width") > 0, F.slice("words", F.lit(1), F.col("width")))
    return sums.where("_lang is not null").select(
        "_lang", _rest(F.col("classes"), F.col("chars")).alias("ref_classes"), _rest(words, F.col("compared")).alias("ref_words")
    )


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms of counts; null if one is empty."""

    def share(c: Column) -> Column:
        whole = F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
        return F.transform(c, lambda x: x / F.when(whole > 0, whole))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.when(p.isNotNull(), F.lit(0.0)))

    terms = F.zip_with(share(counts), share(reference), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def judge(counted: DataFrame, refs: DataFrame, rules: Rules, lang: str = "lang") -> DataFrame:
    """Replace ``_f`` by the counts, the divergences and the verdicts ``base_failed`` and ``kept``."""
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [c for c in counted.columns if c != "_f" and c not in {*out, "base_failed", "class_divergence", "word_divergence", "kept"}]
    joined = attach(counted.withColumn("_lang", F.col(lang)), refs, ["_lang"], "left", row_bytes=512)
    by_class = F.when(
        F.col("_f.chars") >= rules.min_chars, F.round(divergence(_rest(F.col("_f.classes"), F.col("_f.chars")), F.col("ref_classes")), 6)
    )
    by_word = F.when(
        F.col("_f.compared") >= rules.min_compared, F.round(divergence(_rest(F.col("_f.common"), F.col("_f.compared")), F.col("ref_words")), 6)
    )
    failed = (F.col("_f.n_words") < rules.min_words) | (100 * F.col("_f.n_repeat_words") > rules.max_repeat_percent * F.col("_f.n_words"))
    odd = (F.coalesce("class_divergence", F.lit(0.0)) > rules.max_class_divergence) | (
        F.coalesce("word_divergence", F.lit(0.0)) > rules.max_word_divergence
    )
    scored = joined.select(
        *names, *[F.col(f"_f.{c}").alias(c) for c in out], failed.alias("base_failed"), by_class.alias("class_divergence"), by_word.alias("word_divergence")
    )
    return scored.withColumn("kept", ~F.col("base_failed") & ~odd)


def keep_good(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their columns. Texts are read twice and never shuffled."""
    refs = references(features(df, rules, text, lang, base=False), rules, lang)
    marked = df.select(F.struct(*df.columns).alias("_doc"), F.col(text).alias("_text"), F.col(lang).alias("_of"))
    return judge(features(marked, rules, "_text", "_of"), refs, rules, "_of").where("kept").select("_doc.*")
