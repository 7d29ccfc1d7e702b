"""Quality rules for documents, in DataFrame functions only: repetition in a text, and lines that many texts of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, may_hold, written

#: White space that parts words, as a class of a regular expression and as characters.
_WHITE, _WHITE_CHARS = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r"
#: White space inside a line that is not a single space already.
_UNEVEN = "[\\x20\\x09\\x0B-\\x0D]{2,}|[\\x09\\x0B-\\x0D]"
_NO_SYMBOLS = "[^#*$%&|<>]+"

#: Words of a window in the count of repeated words.
WINDOW_WORDS = 5
#: A text with fewer words fails, and so does one of whose words more than this percentage are in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: A line goes if more of its host's distinct texts than this have it, and more than this share of them: none, by default.
MOST_TEXTS, MOST_SHARE = 10, 0.0
#: A text is depleted if what stays has fewer than LEAST_WORDS words or less than this share of them.
LEAST_LEFT = 0.3


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE))


def _line_hash(line: Column) -> Column:
    """A hash of the line in lower case, with one space for white space and 0 for any digit, so that dates and counters make no other line."""
    folded = F.translate(F.btrim(line, F.lit(_WHITE_CHARS)), "123456789", "000000000")
    return F.xxhash64(F.lower(F.regexp_replace(folded, _WHITE, " ")))


def _line_hashes(text: Column) -> Column:
    """_line_hash() of each line that holds a word, once each. The text is folded whole, which costs less than line by line."""
    folded = F.lower(F.regexp_replace(F.regexp_replace(text, "[1-9]", "0"), _UNEVEN, " "))
    lines = F.filter(F.transform(F.split(folded, "\n"), lambda line: F.btrim(line, F.lit(" "))), lambda line: line != "")
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))


def _window_hashes(rows: DataFrame) -> DataFrame:
    """`rows` with `windows`: a hash of each window's words, from hashes of words that are made once, as a column."""
    count = F.greatest(F.lit(0), F.col("n_words").cast("int") - (WINDOW_WORDS - 1))
    rows = rows.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word)))
    later = lambda i: [F.get(F.col("hashes"), i + k) for k in range(1, WINDOW_WORDS)]
    windows = F.transform(F.slice("hashes", F.lit(1), count), lambda first, i: F.xxhash64(first, *later(i)))
    return rows.withColumn("windows", windows).drop("hashes")


def _repeated_words(hashes: Column) -> Column:
    """How many words stand in windows whose hash occurs twice or more; hashes: of the windows, in order."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW_WORDS)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + F.least(s, F.lit(WINDOW_WORDS)))

    # each sorted array is bound once, as the only element of an array that a lambda goes over
    found = F.transform(F.array(by_hash), lambda rows: F.sort_array(again(rows)))
    return F.coalesce(F.get(F.transform(found, covered), F.lit(0)), F.lit(0).cast("long"))


def text_measures(docs: DataFrame, id_col: str, text_col: str, host_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep: a struct of `keep`, host, text, lines and the measures of a text) for each row; null texts and hosts count as empty."""
    rows = docs.select(
        column(id_col).alias("id"),
        (F.struct(*[column(c) for c in keep]) if keep else F.lit(None).cast("string")).alias("keep"),
        F.coalesce(column(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("*", _words(F.col("text")).alias("words"), _text_lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = _window_hashes(rows)
    length = lambda c: F.length(c).cast("long")
    return rows.select(
        "id",
        "keep",
        "host",
        "text",
        "lines",
        "n_words",
        length(F.array_join("words", "")).alias("word_chars"),
        length(F.regexp_replace("text", _NO_SYMBOLS, "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_repeated_words(F.col("windows")))
        .alias("n_repeat_words"),
        # a filter on what is made of these measures stays above a projection that isn't deterministic; below it, the
        # optimizer would put the whole of the measures into the filter, several times over
        F.spark_partition_id().alias("part"),
    )


def _text_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_WHITE_CHARS)) != "")


def frequent_lines(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", most_share: float = MOST_SHARE, most_texts: int = MOST_TEXTS
) -> DataFrame:
    """(host, text_hash, frequent: hashes of the text's lines that are above the limits of its host); texts without such lines have no row.

    Texts that are equal count as one document, so that a group of copies is not taken for a template: by rows, each line of
    a text with more than ten copies would go, and with it every copy, also the one that deduplication is to keep. A line's texts are made
    distinct by (host, line, text) before they are counted, so a line of a third of all rows is spread over all tasks.
    Lines above the limits go back to their texts by (host, line), so a host may have any number of them.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    hashes = _line_hashes(text)
    per_text = docs.select(
        F.coalesce(column(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        # the null line stands for the text itself, and so counts the host's texts
        F.explode(F.concat(hashes, F.array(F.lit(None).cast("long")))).alias("line"),
    )
    per_text = written(per_text.distinct(), "text-lines")
    counts = per_text.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.filter(F.col("line").isNull() | (F.col("n") > most_texts)), "lines")
    hosts = large.filter("line is null").select("host", F.col("n").alias("texts"))
    above = large.filter("line is not null").join(hosts, "host").filter(F.col("n") > F.col("texts") * F.lit(most_share))
    above = written(above.select("host", "line"), "above")
    found = per_text.filter("line is not null").join(above, ["host", "line"])
    return written(found.groupBy("host", "text_hash").agg(F.collect_list("line").alias("frequent")), "frequent")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    most_share: float = MOST_SHARE,
    most_texts: int = MOST_TEXTS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, depleted, kept, clean_text, keep...) for each row.

    A text fails by itself with fewer than ten words, or with over a fifth of its words in repeated five-word windows. Lines
    above the limits of frequent_lines() are removed from clean_text; a text that this depletes is rejected too. Null and
    empty texts have no words and fail. Rows are judged one by one, so repeated rows and ids each get a row; columns not
    named in `keep` are ignored, whatever their names. `keep` must not name a column of the result.
    """
    frequent = frequent_lines(docs, text_col, host_col, most_share, most_texts)
    # texts without a frequent line, most of them, stay where they are
    text, host = F.coalesce(column(text_col).cast("string"), F.lit("")), F.coalesce(column(host_col).cast("string"), F.lit(""))
    test = may_hold(frequent.select(F.xxhash64("host", "text_hash").alias("key")))
    key = F.xxhash64(host, F.xxhash64(text))
    some = text_measures(docs.filter(test(key)), id_col, text_col, host_col, keep).drop("lines").withColumn("text_hash", F.xxhash64("text"))
    # sorted and merged at every size, as the frequent lines grow with the corpus
    some = some.join(frequent.hint("merge"), ["host", "text_hash"], "left")
    is_frequent = lambda line: F.array_contains("frequent", _line_hash(line))
    removed = F.aggregate(
        F.filter(_text_lines(F.col("text")), is_frequent), F.lit(0).cast("long"), lambda n, line: n + F.size(_words(line)).cast("long")
    )
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~is_frequent(line)), "\n")
    some = some.withColumn("n_removed_words", F.when(F.col("frequent").isNull(), F.lit(0).cast("long")).otherwise(removed))
    some = some.withColumn("clean_text", F.when(F.col("n_removed_words") == 0, F.col("text")).otherwise(clean)).drop("frequent", "text_hash")
    rest = text_measures(docs.filter(~test(key)), id_col, text_col, host_col, keep).drop("lines")
    rows = rest.select("*", F.lit(0).cast("long").alias("n_removed_words"), F.col("text").alias("clean_text")).unionByName(some)
    left = F.col("n_words") - F.col("n_removed_words")
    rows = rows.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)).alias("base_failed"),
        ((F.col("n_removed_words") > 0) & ((left < LEAST_WORDS) | (left < F.col("n_words") * F.lit(LEAST_LEFT)))).alias("depleted"),
    )
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_removed_words",
        "depleted",
        (~F.col("base_failed") & ~F.col("depleted") & (F.col("part") >= 0)).alias("kept"),
        "clean_text",
        *[F.col("keep").getField(c).alias(c) for c in keep],
    )

