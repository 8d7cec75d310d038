"""Quality rules by distribution divergence, in DataFrame functions alone.

References are learned from the corpus, over all documents that name their language: per language
the median share of each character class, which odd documents do not move, and the shares of the
language's most frequent short words. A document is compared with every reference by Jensen-Shannon
distance and the nearest one counts. Short texts stray further from their language, so both limits
depend on the length: the class limit is fixed from about 40 words on and grows as characters get
fewer, the word limit is learned per language from how far its documents of that length stray.

The texts are read twice: once to count words, once to measure. What is measured is a short row per
document, which is stored; medians, distances, limits and verdicts come from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvermart.llm.common import SPACE_CLASS, SPACES, let, stored, words_of

# Fixed values of the base rules.
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words

# Parameters of the divergence rules.
COMMON = 50  # words per language
COMMON_LETTERS = 6  # function words are short
# The limit of texts of at least so many characters; shorter ones stray as the root of the length.
CLASS_LIMIT, CLASS_CHARS = 0.23, 200
# Lengths are put into bands, so many for each doubling; the last one is open.
BANDS, LAST_BAND = 2, 40
# The word limit of a band: the median distance and so many standard deviations, which are taken
# from the lower quartile, as odd documents lie above. A band needs so many documents to say it.
WORD_DEVIATIONS, BAND_DOCS = 3.0, 30
QUARTILE = 0.6745

# Character classes counted in what is left of a text without lower-case letters and white space.
# The two of SYMBOL_CLASSES hold the symbols of the base rules.
CLASSES = ("A-Z", "0-9", ".,;:?'\"()-", "!", "#*$%&<>", "|", "\\x80-\\x{10FFFF}")
SYMBOL_CLASSES = (5, 6)
N_CLASSES = len(CLASSES) + 2

LONG = "bigint"


def _total(numbers: Column, zero: Column) -> Column:
    return F.aggregate(numbers, zero, lambda a, x: a + x)


def _size_without(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, ""))


def class_counts(solid: Column, rest: Column) -> Column:
    """Characters per class: lower-case letters first, other marks last.

    `solid` is the length without white space, `rest` the text without lower-case letters either.
    """
    named = [_size_without(rest, f"[^{c}]+").cast(LONG) for c in CLASSES]
    left = F.length(rest).cast(LONG)
    return F.array(solid.cast(LONG) - left, *named, left - sum(named, F.lit(0).cast(LONG)))


def plain_words(text: Column) -> Column:
    """The runs of letters in lower case; an empty entry may stand at either end."""
    return F.split(F.lower(text), "[^\\p{L}]+")


def common_words(docs: DataFrame, common: int = COMMON) -> dict[str, dict[str, float]]:
    """By language the `common` most frequent short words and their shares of all its words.

    Ties go to the first in code point order. `common` rows per language reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    word = F.col("word")
    short = F.length("word") <= COMMON_LETTERS
    counted = (
        known.select("lang", F.explode(plain_words(F.col("text"))).alias("word"))
        .where(word != "")
        .groupBy("lang", F.when(short, word).alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = (
        counted.where(word.isNotNull())
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= common)
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    found: dict[str, dict[str, float]] = {}
    for r in top.join(totals, "lang").orderBy("lang", "place").collect():
        found.setdefault(r.lang, {})[r.word] = r.n / r.total
    return found


def _covered(hashes: Column, count: Column) -> Column:
    """How many places the windows cover whose hash stands twice or more.

    A window becomes one number, its hash above its place, which takes as many bits as the text
    needs. Sorted, equal windows are neighbours and still know where they stand.
    """
    bits = F.length(F.bin(count)).cast("int")
    numbered = F.transform(
        hashes, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast(LONG))
    )
    mask = F.call_function("shiftleft", F.lit(1).cast(LONG), bits) - 1
    full = F.lit(WINDOW).cast(LONG)

    def repeated(ordered: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0

        return F.filter(
            ordered,
            lambda x, j: same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)),
        )

    places = F.sort_array(
        F.transform(let(F.sort_array(numbered), repeated), lambda x: x.bitwiseAND(mask))
    )
    return let(
        places,
        lambda p: _total(
            F.transform(p, lambda x, j: F.least(full, F.coalesce(F.get(p, j + 1) - x, full))),
            F.lit(0).cast(LONG),
        ),
    )


def add_repeated_words(rows: DataFrame, words: str, column: str) -> DataFrame:
    """Adds how many words stand in a window of five that the text holds twice or more."""
    w, n = F.col(words), F.size(words)
    rows = rows.withColumn(
        "_windows",
        F.when(
            n >= WINDOW,
            F.transform(
                F.slice(w, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
                lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Most texts repeat nothing and need no more than this count.
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return rows.withColumn(
        column,
        F.when(twice, _covered(F.col("_windows"), n)).otherwise(F.lit(0).cast(LONG)),
    ).drop("_windows")


def histogram(places: Column) -> Column:
    """(place, n) for every distinct number of an ascending array."""
    starts = F.filter(
        F.transform(
            places, lambda x, j: F.when((j == 0) | (x != F.get(places, j - 1)), j)
        ),
        lambda j: j.isNotNull(),
    )
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda x, j: F.struct(
                F.get(places, x).alias("place"),
                (F.coalesce(F.get(s, j + 1), F.size(places)) - x).alias("n"),
            ),
        ),
    )


def measures(docs: DataFrame, listed: list[str]) -> DataFrame:
    """One short row per document: base counts, class counts, histogram of the listed words."""
    text = F.col("text")
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""
    )
    rows = docs.select("doc_id", "lang", F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id",
        "lang",
        words_of(text).alias("_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast(LONG)
        .alias("n_dup_lines"),
        F.length(F.replace(text, F.lit(" "), F.lit(""))).alias("_unblank"),
        F.regexp_replace(text, "[a-z ]+", "").alias("_rest"),
        plain_words(text).alias("_plain"),
    )
    rows = add_repeated_words(rows, "_words", "n_repeat_words").withColumn(
        "_marks", F.regexp_replace("_rest", SPACE_CLASS + "+", "")
    )
    solid = F.col("_unblank") - (F.length("_rest") - F.length("_marks"))
    common = F.array(*[F.lit(w) for w in listed]).cast("array<string>")
    rows = rows.select(
        "doc_id",
        "lang",
        "n_dup_lines",
        "n_repeat_words",
        F.size("_words").cast(LONG).alias("n_words"),
        solid.cast(LONG).alias("word_chars"),
        class_counts(solid, F.col("_marks")).alias("classes"),
        (F.size("_plain") - F.size(F.filter("_plain", lambda w: w == ""))).alias("plain"),
        F.sort_array(
            F.transform(
                F.filter("_plain", lambda w: w.isin(listed)),
                lambda w: F.array_position(common, w).cast("int") - 1,
            )
        ).alias("_places"),
    )
    places = F.col("_places")
    return rows.select(
        "doc_id", "lang", "n_dup_lines", "n_repeat_words", "n_words", "word_chars", "classes",
        "plain", histogram(places).alias("histogram"),
    )


def class_medians(rows: DataFrame) -> list[list[float]]:
    """By language the median share of every class, scaled to a sum of one."""
    total = _total(F.col("classes"), F.lit(0).cast(LONG)).cast("double")
    known = rows.where(F.col("lang").isNotNull()).select("lang", "classes", total.alias("total"))
    found = (
        known.where(F.col("total") > 0)
        .groupBy("lang")
        .agg(
            *[
                F.percentile_approx(F.get("classes", F.lit(i)) / F.col("total"), 0.5, 1000).alias(
                    f"c{i}"
                )
                for i in range(N_CLASSES)
            ]
        )
        .orderBy("lang")
        .collect()
    )
    medians = [[r[f"c{i}"] for i in range(N_CLASSES)] for r in found]
    return [[m / (sum(row) or 1.0) for m in row] for row in medians]


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _part(p: Column, q: Column) -> Column:
    """What one entry adds to the Jensen-Shannon divergence, in bits."""
    left = F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    right = F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)
    return (left + right) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)))


def _nearest(distances: list[Column], known: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.when(known, F.array_min(F.array(*distances))).otherwise(none) if distances else none


def class_distance(shares: Column, medians: list[list[float]]) -> list[Column]:
    """Distance of class shares to each language."""
    return [
        _distance(_total(F.zip_with(shares, _numbers(m), _part), F.lit(0.0))) for m in medians
    ]


def word_distance(shares: Column, references: list[list[float]]) -> list[Column]:
    """Distance of the common-word shares, (place, p), to each language.

    Words outside a language's list are one further entry, and listed words that the document
    lacks add half of their share.
    """

    def to(reference: list[float]) -> Column:
        table, all_listed = _numbers(reference), float(sum(reference))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

        def add(a: Column, entry: Column) -> Column:
            q, p = F.get(table, entry["place"]), entry["p"]
            grown = F.struct(
                (a["sum"] + _part(p, q)).alias("sum"),
                (a["p"] + p).alias("p"),
                (a["q"] + q).alias("q"),
            )
            return F.when(q > 0, grown).otherwise(a)

        def close(a: Column) -> Column:
            others = F.greatest(F.lit(0.0), 1 - a["p"])
            lacking = (all_listed - a["q"]) / 2
            return _distance(a["sum"] + lacking + _part(others, F.lit(max(0.0, 1 - all_listed))))

        return F.aggregate(shares, start, add, close)

    return [to(r) for r in references]


def band_of(words: Column) -> Column:
    """The band of a number of words, from 0 on."""
    return F.least(
        F.floor(F.log2(F.greatest(words, F.lit(1))) * BANDS).cast("int"), F.lit(LAST_BAND)
    )


def word_limits(rows: DataFrame, languages: list[str]) -> list[list[float | None]]:
    """By language and band the word distance beyond which a document is odd.

    `rows`: lang, plain, and to_words, the distance to every language; those that name their
    language count. A band of few documents has the limit of the nearest shorter one that has
    enough, which is wider; without such a band there is none. A row per language and band
    reaches the driver.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in languages]).cast("array<string>"), F.col("lang"))
    own = F.get("to_words", place.cast("int") - 1)
    found = (
        rows.where(F.col("lang").isNotNull() & (F.col("plain") > 0))
        .select("lang", band_of(F.col("plain")).alias("band"), own.alias("own"))
        .where("own is not null")
        .groupBy("lang", "band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("own", [0.25, 0.5], 1000).alias("at"),
        )
        .where(F.col("n") >= BAND_DOCS)
        .collect()
    )
    known = {
        (r.lang, r.band): r["at"][1] + WORD_DEVIATIONS * (r["at"][1] - r["at"][0]) / QUARTILE
        for r in found
    }
    limits = []
    for language in languages:
        limit, by_band = None, []
        for band in range(LAST_BAND + 1):
            limit = known.get((language, band), limit)
            by_band.append(limit)
        limits.append(by_band)
    return limits


def judge(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """The base counts, both distances and the verdict on every document.

    `docs` has doc_id, text and lang. NULL and empty texts count nothing and fail the base rules;
    rows are judged one by one, so repeated rows get equal verdicts; without references (no document
    names a language) the divergence rules reject nothing, and without enough documents of a language the
    word rule accepts whatever is nearest to it; an empty table stays empty; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    by_language = common_words(docs, common)
    listed = list(dict.fromkeys(w for words in by_language.values() for w in words))
    rows = stored(measures(docs, listed))
    medians = class_medians(rows)
    references = [[words.get(w, 0.0) for w in listed] for words in by_language.values()]

    # NULL for a text without characters: it has no shares, and the strict arithmetic of a session
    # would end the job at a division by zero.
    total = F.nullif(F.col("word_chars"), F.lit(0))
    rows = rows.select(
        "*",
        F.transform("classes", lambda c: c / total).alias("class_shares"),
        F.transform(
            "histogram",
            lambda e: F.struct(e["place"].alias("place"), (e["n"] / F.col("plain")).alias("p")),
        ).alias("word_shares"),
    )
    none = F.lit(None).cast("array<double>")
    to_words = word_distance(F.col("word_shares"), references)
    rows = stored(
        rows.select(
            "doc_id",
            "lang",
            "plain",
            "n_words",
            "word_chars",
            sum(F.get("classes", F.lit(i)) for i in SYMBOL_CLASSES).alias("n_symbols"),
            "n_dup_lines",
            "n_repeat_words",
            (
                (F.col("n_words") < LEAST_WORDS)
                | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
            ).alias("base_failed"),
            _nearest(class_distance(F.col("class_shares"), medians), total > 0).alias(
                "class_distance"
            ),
            (
                F.when(F.col("plain") > 0, F.array(*to_words)).otherwise(none)
                if to_words
                else none
            ).alias("to_words"),
        )
    )
    limits = word_limits(rows, list(by_language))
    band = band_of(F.col("plain"))
    table = F.array(
        *[F.array(*[F.lit(x) for x in by_band]).cast("array<double>") for by_band in limits]
    ).cast("array<array<double>>")
    # NULL, which rejects nothing, where the language has no limit.
    nearest = F.array_position("to_words", F.array_min("to_words")).cast("int") - 1
    limit = F.get(F.get(table, nearest), band)
    shortness = F.sqrt(F.greatest(F.lit(1.0), CLASS_CHARS / total))
    odd_classes = F.col("class_distance") > CLASS_LIMIT * shortness
    odd = odd_classes | (F.array_min("to_words") > limit)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "class_distance",
        F.array_min("to_words").alias("word_distance"),
        (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"),
    )
