"""Document quality rules by distribution divergence (DataFrame functions only).

Two histograms of each document, its character classes and the common words of its language, are
compared with the typical histograms of that language by Jensen-Shannon distance. Short documents
are not compared (minimum-length guards); they only have to pass the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storecast.llm.common import WHITE, materialize

# Frequent function words by language code.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "are"],
    "de": ["der", "die", "und", "in", "den", "das", "nicht", "von", "mit", "des", "auch", "sich"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "qui"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "para"],
    "it": ["di", "che", "e", "la", "il", "un", "a", "per", "in", "una", "non", "sono"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "os"],
    "nl": ["de", "van", "het", "een", "en", "in", "is", "dat", "op", "te", "zijn", "met"],
}
N_COMMON = 12

#: Histograms are compared from so many words on.
MIN_WORDS_CHARS = 20
MIN_WORDS_COMMON = 50
#: A language has a reference of its own from so many compared documents on; others share the pooled one.
MIN_REFERENCE_DOCS = 30
#: Largest Jensen-Shannon distance (square root, base 2, 0 to 1) of a kept document of n words:
#: a limit, plus an allowance over n for the sampling noise of short documents.
MAX_CHAR_DISTANCE, CHAR_ALLOWANCE = 0.19, 2.5
MAX_WORD_DISTANCE, WORD_ALLOWANCE = 0.27, 4.0
WINDOW = 8
#: Character classes: lower case, white space, upper case, other letters, digits, stops, all else.
N_CLASSES = 7
LEVELS = 2000

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def _next(values: Column, by: int, n: Column) -> Column:
    """``values`` from place ``by`` on (0-based); empty when there are fewer."""
    return F.slice(values, by + 1, F.greatest(n - by, F.lit(0)))


def _pairs(values: Column, by: int, n: Column) -> Column:
    """Hash of each element with the one ``by`` places on."""
    left = F.slice(values, 1, F.greatest(n - by, F.lit(0)))
    return F.zip_with(left, _next(values, by, n), lambda a, b: F.xxhash64(a, b))


def _listed(words: Column, lang: Column) -> Column:
    """The words that stand in their language's list; null without a list."""
    out = F.lit(None).cast("array<string>")
    for code, listed in COMMON_WORDS.items():
        out = F.when(lang == code, F.filter(words, _one_of(listed))).otherwise(out)
    return out


def _one_of(listed: list[str]):
    return lambda w: w.isin(listed)


def _counts(common: Column, n_words: Column, lang: Column) -> Column:
    """Counts of the language's common words, in list order, then of all other words; null without a list."""
    out = F.lit(None).cast("array<double>")
    for code, listed in COMMON_WORDS.items():
        n = [(F.size(common) - F.size(F.array_remove(common, w))).cast("double") for w in listed]
        out = F.when(lang == code, F.array(*n, (n_words - F.size(common)).cast("double"))).otherwise(out)
    return out


def histograms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Add ``__words``, ``__n``, ``__chars`` and ``__common`` (arrays of counts) to ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # \xad-like marks stay characters; only the six ASCII white space characters separate words.
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    docs = docs.withColumn(
        "__words", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{WHITE}+")))
    docs = docs.withColumn("__n", F.size("__words"))
    docs = docs.withColumn("__odd", F.regexp_replace(text, F.lit(rf"[\p{{Ll}}\x20\x09-\x0D]+"), F.lit("")))
    docs = docs.withColumn("__word_chars", F.char_length(F.array_join("__words", "")))
    odd, total = F.col("__odd"), F.char_length(text)
    upper = _length_without(odd, r"[^\p{Lu}]+")
    letters = _length_without(odd, r"[^\p{Lt}\p{Lm}\p{Lo}\p{M}]+")
    digits = _length_without(odd, r"[^\p{N}]+")
    stops = _length_without(odd, r"[^.,;:'’\"()\-]+")
    docs = docs.withColumn("__parts", F.array(
        F.col("__word_chars") - F.char_length(odd), total - F.col("__word_chars"), upper, letters, digits, stops))
    docs = docs.withColumn("__chars", F.transform(
        F.concat("__parts", F.array(F.char_length(odd) - F.aggregate(F.slice("__parts", 3, 4), F.lit(0), lambda s, x: s + x))),
        lambda x: x.cast("double")))
    docs = docs.withColumn("__listed", _listed(F.col("__words"), F.col(lang_col)))
    return docs.withColumn("__common", _counts(F.col("__listed"), F.col("__n"), F.col(lang_col)))


def shares(counts: Column) -> Column:
    """Counts over their sum (null when the sum is 0)."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.zip_with(counts, F.array_repeat(total, F.size(counts)), lambda x, t: x / t))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays: square root of the divergence in bits, 0 to 1."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Typical share histograms of each language: the median share of every bin over all documents.

    Medians, not means, so that junk (up to half of a language's documents, one hot group of copies
    included) doesn't move the reference. They are exact at a resolution of 1 / ``LEVELS``: shares
    are rounded to levels and counted, which combines on the map side to a bounded number of rows.

    One row per language with at least ``MIN_REFERENCE_DOCS`` documents long enough to compare, and
    one with ``ref_lang`` null, the average of the others (used for every other language; it has no
    common words). An empty table gives only that row, with null references, which reject nothing.
    """
    return _references(histograms(docs.select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")), "__text", "__lang"))


def _references(h: DataFrame) -> DataFrame:
    h = h.where(F.col("__lang").isNotNull() & (F.col("__n") >= MIN_WORDS_CHARS))
    words = F.when(F.col("__n") >= MIN_WORDS_COMMON, shares(F.col("__common")))
    none = F.array().cast("array<double>")
    bins = F.concat(shares(F.col("__chars")), F.coalesce(words, none))
    counted = (
        h.select(F.col("__lang").alias("ref_lang"), F.posexplode(bins).alias("bin", "share"))
        .groupBy("ref_lang", "bin", F.round(F.col("share") * LEVELS).cast("int").alias("level")).agg(F.count("*").alias("n")))
    per_bin = Window.partitionBy("ref_lang", "bin")  # at most LEVELS + 1 rows each
    middle = (
        counted.withColumn("upto", F.sum("n").over(per_bin.orderBy("level"))).withColumn("all", F.sum("n").over(per_bin))
        .where(2 * F.col("upto") >= F.col("all"))
        .groupBy("ref_lang", "bin").agg(F.min("level").alias("level"), F.first("all").alias("all"))
        .groupBy("ref_lang").agg(
            F.max("all").alias("n_docs"), F.sort_array(F.collect_list(F.struct("bin", "level"))).alias("bins"))
        .where(F.col("n_docs") >= MIN_REFERENCE_DOCS))
    values = F.transform("bins", lambda x: x["level"].cast("double"))
    refs = materialize(middle.select(
        "ref_lang", "n_docs", shares(F.slice(values, 1, N_CLASSES)).alias("char_ref"),
        F.when(F.size("bins") > N_CLASSES, shares(F.slice(values, N_CLASSES + 1, N_COMMON + 1))).alias("word_ref")), "quality-refs")
    pool = refs.agg(
        F.lit(None).cast("string").alias("ref_lang"), F.sum("n_docs").alias("n_docs"),
        F.array(*[F.avg(F.get("char_ref", F.lit(i))) for i in range(N_CLASSES)]).alias("char_ref"),
        F.lit(None).cast("array<double>").alias("word_ref"))
    return refs.unionByName(pool)


def quality_rules(docs: DataFrame, references: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return every row and column of ``docs`` with the rule columns added.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    char_distance, word_distance (double, null where not compared) and kept. An input column of one
    of these names is replaced. ``references``: see :func:`language_references`; computed from
    ``docs`` when not given.

    Null text counts as empty: no words, so base_failed. A null or rare language is compared with
    the pooled character classes only. Rows are judged one by one, so repeated rows get equal results.
    """
    refs = language_references(docs, text_col, lang_col) if references is None else references
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    inner = [c for c in docs.columns if c not in own or c in (text_col, lang_col)]
    d = docs.select(*[F.col(f"`{c}`") for c in inner])
    d = histograms(d.withColumns({"__text": F.coalesce(F.col(text_col), F.lit("")), "__lang": F.col(lang_col)}), "__text", "__lang")

    return _judged(_measured(d), refs).select(*[F.col(f"`{c}`") for c in inner if c not in own], *own)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col`` and the rule columns of :func:`quality_rules`, with references from ``docs`` itself.

    The texts are read once: histograms and base counts are written, then referenced and compared.
    """
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(lang_col).alias("__lang"))
    measured = _measured(histograms(d, "__text", "__lang"))
    measured = materialize(measured.select(id_col, "__lang", "__n", "__chars", "__common", *FEATURES, "base_failed"), "quality")
    return _judged(measured, _references(measured)).select(id_col, *FEATURES, "base_failed", "char_distance", "word_distance", "kept")


def _measured(d: DataFrame) -> DataFrame:
    """Add the base counts to histogram rows with their ``__text``."""
    n, text = F.col("__n"), F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__lines", lines).withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    d = d.withColumn("__h2", _pairs(F.col("__h1"), 1, n))
    d = d.withColumn("__h4", _pairs(F.col("__h2"), 2, n - 1))
    d = d.withColumn("__h8", _pairs(F.col("__h4"), 4, n - 3))
    d = d.withColumn("__m", F.size("__h8"))
    twice = F.size(F.array_distinct("__h8")) < F.col("__m")
    d = d.withColumn("__s", F.when(twice, F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("__same", F.zip_with(F.slice("__s", 1, F.greatest(F.col("__m") - 1, F.lit(0))), _next(F.col("__s"), 1, F.col("__m")),
                                          lambda a, b: a["h"] == b["h"]))
    after = F.concat("__same", F.array(F.lit(False)))
    before = F.concat(F.array(F.lit(False)), F.col("__same"))
    flags = F.zip_with(F.zip_with("__s", after, lambda x, a: F.struct(x["i"].alias("i"), a.alias("a"))), before,
                       lambda x, b: F.when(x["a"] | b, x["i"]))
    d = d.withColumn("__at", F.sort_array(F.filter(flags, lambda x: x.isNotNull())))
    covered = F.aggregate(F.zip_with("__at", F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                          F.lit(0), lambda s, x: s + x)
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.col("__word_chars").cast("long"),
        "n_symbols": _length_without(F.col("__odd"), r"[^#*$%&|<>]+").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _judged(d: DataFrame, refs: DataFrame) -> DataFrame:
    """Add both distances and the verdict."""
    n = F.col("__n")
    # References are a row for each language: Spark broadcasts them when it measures them small.
    own_refs = refs.where(F.col("ref_lang").isNotNull()).select(
        F.col("ref_lang").alias("__ref_lang"), F.col("char_ref").alias("__cr"), F.col("word_ref").alias("__wr"))
    pool = refs.where(F.col("ref_lang").isNull()).select("char_ref").head()
    pooled = list(pool[0]) if pool and pool[0] and pool[0][0] is not None else None
    pooled_col = F.array(*[F.lit(float(x)) for x in pooled]) if pooled else F.lit(None).cast("array<double>")
    d = d.join(own_refs, F.col("__lang") == F.col("__ref_lang"), "left")
    d = d.withColumns({
        "char_distance": F.when(n >= MIN_WORDS_CHARS, js_distance(shares(F.col("__chars")), F.coalesce(F.col("__cr"), pooled_col))),
        "word_distance": F.when(n >= MIN_WORDS_COMMON, js_distance(shares(F.col("__common")), F.col("__wr"))),
    })
    return d.withColumn("kept", ~F.col("base_failed")
                        & F.coalesce(F.col("char_distance") <= MAX_CHAR_DISTANCE + CHAR_ALLOWANCE / n, F.lit(True))
                        & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE + WORD_ALLOWANCE / n, F.lit(True)))


def quality_filter(docs: DataFrame, references: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    marked = docs.withColumns({"__doc": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    judged = quality_rules(marked.select("__doc", F.col(text_col).alias("__t"), F.col(lang_col).alias("__l")), references, "__t", "__l")
    # Pushed below the projections, the condition would be spelled out from the text, every count many
    # times over. A condition with rand() in it stays above them; it is kept or not, whatever rand() gives.
    kept = judged.where(F.when(F.col("kept"), 1.0).otherwise(-1.0) + F.rand(0) / 2 > 0)
    return kept.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
