"""Quality rules on distribution divergence, in native expressions.

Each language has two reference histograms, taken over all its documents: of
character classes, and of its most common words as written (all others in one bin). A
document is compared with its language's references by Jensen-Shannon distance (the
root of the divergence in bits) and kept if neither distance exceeds its bound. A
histogram of too few characters or words says nothing and is not compared.

Candidates for the common words come from one frequent-items sketch a language,
which loses no word of a noticeable share; their counts are exact.

Two further rules are plain: fewer than ``LEAST_WORDS`` words, or more than a fifth
of the words in five-word windows that occur twice or more in the text.

Defined results: null and wordless texts have zero counts and fail the plain rules;
a null language is a language of its own; a language with fewer than ``LEAST_DOCS``
documents has no reference and its documents are kept unless a plain rule fails;
a very long text is counted as a whole; of equally common words the one that sorts first
is taken; repeated rows are judged each for itself; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, SPACES, written

WINDOW = 5
LEAST_WORDS = 10
#: Common words of a language that make its word histogram, and candidates for them.
COMMON, CANDIDATES = 24, 36
#: Items that a language's sketch tracks.
TRACKED = 20_000
LEAST_DOCS = 20
#: Guards: histograms of fewer characters or words are not compared.
LEAST_CHARS, LEAST_HISTOGRAM_WORDS = 300, 40
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.42
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS, MARKS, SYMBOLS = "0123456789", ".,;:!?'\"()-", "#*$%&|<>"


def repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows: hashes in order."""
    m = F.size(windows)
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"].eqNullSafe(F.get(s, k)["h"])
        twice = F.filter(F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda i: i.isNotNull())
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total"))
        return F.aggregate(F.sort_array(twice), start, step, lambda a: a["total"])

    counted = F.transform(F.array(ordered), of)[0]
    return F.when(F.size(F.array_distinct(windows)) < m, counted).otherwise(0).cast("long")


def candidates(docs: DataFrame, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The most frequent words of every language with enough documents, by a sketch."""
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("lang")
    enough = {r[0] for r in docs.groupBy(lang).count().where(F.col("count") >= LEAST_DOCS).collect()}
    if not enough:
        return {}
    words = docs.select(lang, F.explode(F.split(F.col(text_col), SPACE)).alias("word")).where("word != ''")
    found = words.groupBy("lang").agg(F.expr(f"approx_top_k(word, {CANDIDATES}, {TRACKED})").alias("top")).collect()
    return {r["lang"]: sorted(x["item"] for x in r["top"]) for r in found if r["lang"] in enough}


def measured(docs: DataFrame, common: dict[str, list[str]], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts of every document: base counts, character classes, and its language's candidate words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
        F.length(text).cast("long").alias("chars"),
        F.regexp_replace(text, "[a-z]+", "").alias("rest"),
    )
    # what is left grows short: each class is taken from what those before it left
    left = "chars"
    for name, characters in (("lower", None), ("spaces", SPACES), ("upper", UPPER), ("marks", MARKS), ("symbols", SYMBOLS), ("digits", DIGITS)):
        if characters is not None:
            rows = rows.withColumn("rest", F.translate("rest", characters, ""))
        rows = rows.withColumn(f"not_{name}", F.length("rest").cast("long")).withColumn(name, F.col(left) - F.col(f"not_{name}"))
        left = f"not_{name}"
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("words"), i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
    longest = max((len(w.encode()) for own in common.values() for w in own), default=0)
    # places among the candidates, with one more of each: sorted, the gaps between first places are the counts
    padding = F.sequence(F.lit(1).cast("long"), F.lit(CANDIDATES + 1).cast("long"))
    rows = rows.withColumns({"windows": windows, "short": F.filter("words", lambda w: F.octet_length(w) <= longest)})
    places_of = lambda listed: F.transform("short", lambda w: F.array_position(listed, w))
    places = padding
    for lang, own in sorted(common.items()):
        listed = F.array(*map(F.lit, own))
        places = F.when(F.col("lang") == lang, F.sort_array(F.concat(places_of(listed), padding))).otherwise(places)
    rows = rows.withColumn("places", places)
    counts = F.array(*(F.array_position("places", F.lit(k + 1).cast("long")) - F.array_position("places", F.lit(k).cast("long")) - 1 for k in range(1, CANDIDATES + 1)))
    return rows.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        (F.col("chars") - F.col("spaces")).alias("word_chars"),
        F.col("symbols").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).alias("n_repeat_words"),
        F.array("lower", "spaces", "upper", "marks", "symbols", "digits", F.col("not_digits")).alias("classes"),
        counts.cast("array<long>").alias("commons"),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, 0 to 1; null if one is empty."""

    def of(pair: Column) -> Column:
        a, b = pair["p"], pair["q"]
        m = (a + b) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) / 2
        return half(a) + half(b)

    shares = lambda x: F.transform(F.array(F.struct(x.alias("x"), total(x).alias("n"))), lambda s: F.transform(s["x"], lambda v: F.try_divide(v.cast("double"), s["n"])))[0]
    terms = F.transform(F.arrays_zip(shares(p).alias("p"), shares(q).alias("q")), of)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))))


def divergence_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, both distances (null where not compared), base_failed and kept of every row."""
    rows = written(measured(docs, candidates(docs, text_col, lang_col), id_col, text_col, lang_col), "measured")
    sums = lambda c, k: F.array(*(F.sum(F.get(c, i)) for i in range(k)))
    references = rows.groupBy("lang").agg(F.count("*").alias("docs"), sums("classes", 7).alias("all_classes"), sums("commons", CANDIDATES).alias("all_commons"), F.sum("n_words").alias("all_words")).where(F.col("docs") >= LEAST_DOCS)
    # the most common words of all candidates, by exact count
    order = F.array_sort(F.transform("all_commons", lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    references = references.withColumn("chosen", F.transform(F.slice(order, 1, COMMON), lambda x: x["i"]))
    pick = lambda counts, words: F.transform(F.array(F.transform("chosen", lambda i: F.get(F.col(counts), i))), lambda own: F.concat(own, F.array(F.col(words) - total(own))))[0]
    references = references.withColumn("all_histogram", pick("all_commons", "all_words")).select("lang", "all_classes", "chosen", "all_histogram")
    both = rows.join(F.broadcast(references), "lang", "left")  # one row a language of at least LEAST_DOCS documents
    both = both.withColumn("histogram", pick("commons", "n_words"))
    char = F.when(F.col("all_classes").isNotNull() & (total(F.col("classes")) >= LEAST_CHARS), distance(F.col("classes"), F.col("all_classes")))
    word = F.when(F.col("chosen").isNotNull() & (F.col("n_words") >= LEAST_HISTOGRAM_WORDS), distance(F.col("histogram"), F.col("all_histogram")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return both.withColumns({"char_distance": char, "word_distance": word, "base_failed": failed}).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
