"""Quality rules: base counts of a text, and how far its histograms lie from those of its language."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodstream.llm.shared import bound, stored, table, unused, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
#: So many common words are taken for each language, of any length; words that mix letters with ASCII digits or marks
#: ("end.") are none, marks alone ("|") are.
COMMON = 20
_MIXED = ("[!-@\\[-`{-~]", "[^!-@\\[-`{-~]")
#: A histogram is judged only if the text, and its language as a whole, have at least so many words.
JUDGED_WORDS = 40
LANGUAGE_WORDS = 2000
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the language that a kept text may have.
CLASS_DISTANCE = 0.29
WORD_DISTANCE = 0.45
#: References of more languages than this are joined by key instead of being broadcast.
MAX_LANGUAGES = 5000
CLASSES = ["small", "capital", "digit", "mark", "other"]


def _without(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[{chars}]+", "")


def _ink(text: Column) -> Column:
    """What is left of a text without small letters and blanks; the costlier counts look at this short rest only."""
    return _without(text, r"a-z\x20\x09-\x0D")


def _classes(ink: Column, word_chars: Column) -> Column:
    """Counts of small letters, capitals, digits, ASCII marks and all other characters inside words."""
    low = bound(
        _without(ink, "A-Z"),
        lambda low: bound(
            _without(low, "0-9"),
            lambda num: bound(
                F.length(_without(num, r"\x00-\x7F")),
                lambda other: F.array(
                    F.length(ink) - F.length(low), F.length(low) - F.length(num), F.length(num) - other, other
                ),
            ),
        ),
    )
    return F.concat(F.array(word_chars - F.length(ink)), low).cast("array<bigint>")


def _repeated_words(found: Column) -> Column:
    """Words inside windows of five words that the text has at least twice, first occurrences included."""

    def windows(marks: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(marks) - WINDOW),
            lambda i: F.xxhash64(*[F.get(marks, i + k) for k in range(WINDOW)]),
        )
        return F.when(F.size(marks) > WINDOW, several).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bound(
            placed,
            lambda s: F.filter(
                s,
                lambda x, k: (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True)
                | (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True),
            ),
        )
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = bound(
            at,
            lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))),
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = bound(F.transform(found, lambda w: F.xxhash64(w)), windows)
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def measured(documents: DataFrame, *keep: str, longest: Column) -> DataFrame:
    """The columns `keep`, the base counts, the classes' counts and the words of at most `longest` bytes between double blanks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = documents.select(*keep, longest.alias("__longest"), text.alias("__t"), words(text).alias("__w"), _ink(text).alias("__ink"))
    step = step.withColumn("__chars", F.length(F.array_join("__w", "")))
    symbols = F.col("__ink")
    for mark in SYMBOLS:
        symbols = F.replace(symbols, F.lit(mark), F.lit(""))
    lines = bound(
        F.filter(F.split("__t", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
        lambda kept: F.size(kept) - F.size(F.array_distinct(kept)),
    )
    short = F.filter("__w", lambda w: F.octet_length(w) <= F.col("__longest"))
    return step.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.col("__chars").cast("long").alias("word_chars"),
        (F.octet_length("__ink") - F.octet_length(symbols)).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("__w")).cast("long").alias("n_repeat_words"),
        _classes(F.col("__ink"), F.col("__chars")).alias("classes"),
        F.concat(F.lit(" "), F.array_join(short, "  "), F.lit(" ")).alias("spaced"),
    )


def language_references(documents: DataFrame) -> DataFrame:
    """(lang, n_words, classes, common): for each language its words, class counts and commonest words with counts.

    Counted over all documents of at least MIN_WORDS words, in one pass: each text is spread into its words and one
    row with its totals, and both are summed where they stand before the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = documents.select("lang", words(text).alias("w"), _ink(text).alias("ink"))
    step = step.select(
        "lang",
        F.size("w").alias("n"),
        _classes(F.col("ink"), F.length(F.array_join("w", ""))).alias("c"),
        F.when(F.size("w") >= MIN_WORDS, F.array_append("w", F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")).alias("spread"),
    )
    step = step.select("lang", "n", "c", F.explode("spread").alias("word"))
    total = F.col("word").isNull()
    sums = [F.sum(F.when(total, F.get("c", F.lit(k)))).alias(f"c{k}") for k in range(len(CLASSES))]
    counts = step.groupBy("lang", "word").agg(
        F.count("*").alias("k"), F.sum(F.when(total, F.col("n"))).alias("n"), *sums
    )
    counts = stored(counts, "language-counts")
    totals = counts.where(total).select("lang", F.col("n").alias("n_words"), F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("classes"))
    order = Window.partitionBy("lang").orderBy(F.desc("k"), "word")
    top = counts.where(~(F.col("word").rlike(_MIXED[0]) & F.col("word").rlike(_MIXED[1]))).withColumn("at", F.row_number().over(order)).where(F.col("at") <= COMMON)
    common = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", F.col("k").alias("n")))).alias("common"))
    both = totals.join(common.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    none = F.array().cast("array<struct<word:string,n:bigint>>")
    return both.select("lang", "n_words", "classes", F.coalesce("common", none).alias("common"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return bound(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def distance(one: Column, other: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: root of the divergence in bits. Shares of zero add nothing."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(one, other, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def judged(documents: DataFrame, into: str = "verdict", references: DataFrame | None = None) -> DataFrame:
    """`documents` (text, lang, and any other columns) with a struct `into` of base counts, distances and verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed; class_distance and word_distance, the
    Jensen-Shannon distances of the text's character classes and common words from its language's (null where the
    text or the language is too short to judge); kept. `references` (of `language_references`) default to those of
    `documents` themselves; a null language counts as one language. Null and empty texts have no words and fail the
    base rule. Repeated rows count as often as they stand. Rows are never moved: the references come to them.
    """
    unused(documents, into)
    if references is None:
        references = stored(language_references(documents), "language-references")
    reference = references.select(
        F.col("lang").alias("__lang"),
        F.struct(
            F.col("n_words").alias("n"),
            _shares(F.col("classes")).alias("classes"),
            F.col("common.word").alias("words"),
            F.col("common.n").alias("counts"),
            F.array_max(F.transform("common.word", F.octet_length)).alias("longest"),
        ).alias("__ref"),
    )
    if references.count() <= MAX_LANGUAGES:
        reference = F.broadcast(reference)
    rows = documents.withColumn("__row", F.struct(*[F.col(c) for c in documents.columns]) if documents.columns else F.lit(0))
    found = rows.select("__row", "text", "lang").join(reference, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    ref = F.col("__ref")
    found = measured(found, "__row", "lang", "__ref", longest=ref["longest"])
    spaced = F.col("spaced")
    own = F.transform(
        ref["words"],
        lambda w: bound(
            F.concat(F.lit(" "), w, F.lit(" ")),
            lambda s: (F.octet_length(spaced) - F.octet_length(F.replace(spaced, s, F.lit("")))) / F.octet_length(s),
        ).cast("long"),
    )
    found = found.withColumn("__own", own)
    usual = F.col("n_words") >= JUDGED_WORDS
    usual = usual & (ref["n"] >= LANGUAGE_WORDS)

    def with_rest(counts: Column, n: Column) -> Column:
        return F.array_append(counts, n - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x))

    apart = distance(_shares(with_rest(F.col("__own"), F.col("n_words"))), _shares(with_rest(ref["counts"], ref["n"])))
    found = found.withColumn("class_distance", F.when(usual, F.round(distance(_shares(F.col("classes")), ref["classes"]), 6)))
    found = found.withColumn("word_distance", F.when(usual, F.round(apart, 6)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    near = F.coalesce(F.col("class_distance") <= CLASS_DISTANCE, F.lit(True))
    near = near & F.coalesce(F.col("word_distance") <= WORD_DISTANCE, F.lit(True))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    return found.select("__row.*", F.struct(*names).alias(into))


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"), "verdict").select("doc_id", "verdict.*")


QUERIES = {"op1_distribution_divergence": op1_distribution_divergence}


def _term_sql(x: str, y: str) -> str:
    """What two shares add to the Jensen-Shannon divergence."""

    def part(a: str, b: str) -> str:
        return f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"

    return f"({part(x, y)} + {part(y, x)}) / 2"


_BLANK = r"\x20\x09-\x0D"
_CLASS_TERMS = " + ".join(_term_sql(f"(m.c{k} / m.word_chars)", f"(r.c{k} / r.chars)") for k in range(len(CLASSES)))
SQL = {
    "op1_distribution_divergence": f"""
with d as (
  select doc_id, lang, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[{_BLANK}]+'), lambda x: x <> '') as w from documents),
p as (
  select doc_id, lang, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_BLANK}]')) as lines,
    length(regexp_replace(t, '[^a-z]', '', 'g')) as c0, length(regexp_replace(t, '[^A-Z]', '', 'g')) as c1,
    length(regexp_replace(t, '[^0-9]', '', 'g')) as c2, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) as c4 from d),
m as (select *, word_chars - c0 - c1 - c2 - c4 as c3 from p),
windows as (
  select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as win
  from (select doc_id, w, unnest(range(1, n_words - {WINDOW - 2})) as i from m where n_words >= {WINDOW})),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1),
repeated as (
  select doc_id, count(distinct place) as n
  from (select doc_id, unnest(range(i, i + {WINDOW})) as place from twice) group by doc_id),
single as (select doc_id, lang, n_words, unnest(w) as word from m),
r as (
  select lang, sum(n_words) as n, sum(word_chars) as chars, {", ".join(f"sum(c{k}) as c{k}" for k in range(len(CLASSES)))}
  from m where n_words >= {MIN_WORDS} group by lang),
counts as (select lang, word, count(*) as k from single where n_words >= {MIN_WORDS} and not (regexp_matches(word, '{_MIXED[0]}') and regexp_matches(word, '{_MIXED[1]}')) group by lang, word),
top as (select * from counts qualify row_number() over (partition by lang order by k desc, word) <= {COMMON}),
own as (
  select s.doc_id, s.word, count(*) as k from single s join top t on s.lang is not distinct from t.lang and s.word = t.word
  group by s.doc_id, s.word),
usual as (
  select m.*, r.n, round(sqrt(greatest(0.0::double, {_CLASS_TERMS})), 6) as class_distance
  from m join r on m.lang is not distinct from r.lang where m.n_words >= {JUDGED_WORDS} and r.n >= {LANGUAGE_WORDS}),
common as (
  select u.doc_id, coalesce(o.k, 0) as mine, t.k as theirs
  from usual u join top t on u.lang is not distinct from t.lang left join own o on u.doc_id = o.doc_id and o.word = t.word),
held as (select doc_id, sum(mine) as mine, sum(theirs) as theirs from common group by doc_id),
shares as (
  select doc_id, c.mine / u.n_words as x, c.theirs / u.n as y from common c join usual u using (doc_id)
  union all
  select doc_id, (u.n_words - coalesce(h.mine, 0)) / u.n_words, (u.n - coalesce(h.theirs, 0)) / u.n
  from usual u left join held h using (doc_id)),
apart as (
  select doc_id, round(sqrt(greatest(0.0::double, sum({_term_sql("x", "y")}))), 6) as word_distance from shares group by doc_id),
found as (
  select m.doc_id, m.n_words, m.word_chars, m.n_symbols, len(m.lines) - len(list_distinct(m.lines)) as n_dup_lines,
    coalesce(t.n, 0) as n_repeat_words, u.class_distance, a.word_distance
  from m left join repeated t using (doc_id) left join usual u using (doc_id) left join apart a using (doc_id)),
base as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from found)
select *, not base_failed and coalesce(class_distance <= {CLASS_DISTANCE}, true)
  and coalesce(word_distance <= {WORD_DISTANCE}, true) as kept from base""",
}
