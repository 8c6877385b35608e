"""Mixing sources to target weights by pivotal dependent rounding on a reduction tree."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodstream.llm.shared import bound, stored, table, unused, words

#: Fractions that meet in one block of the tree, on average; the tree has log of the row count to this base levels.
BLOCK = 64
MOST = 3
#: Texts over 1 / LARGE of their source are rounded first, and the rest makes up for what they take.
LARGE = 200
#: Tables of at most this many sources are broadcast.
SOURCES = 5000
WEIGHTS = (1, 2, 3)
_TINY = 1e-12
_UNIT = "struct<size:bigint,doc_id:bigint,source:string,n:bigint,base:bigint,goal:double,total:bigint,extra:bigint,p:double>"
_DONE = f"array<struct<unit:{_UNIT},up:int>>"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size): sources by code point, null last, weigh 1, 2, 3, repeating.

    They share all sizes by weight; what exceeds MOST times a source's size goes to the others by weight, until none is
    above. Sorted by the level at which a source is full, the full ones come first, so one pass over the (few) sources
    finds the level. The one ordering over all sources holds a row per source, not per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("at", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("at") % len(WEIGHTS)).cast("double")
    full = ranked.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size").cast("double"))
    full = full.withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = full.withColumn("level", left / open_weight).withColumn("is_full", F.col("full_at") <= F.col("level"))
    level = F.min(F.when(~F.col("is_full"), F.struct("full_at", "at", "level"))).over(everything)["level"]
    target = F.when(F.col("is_full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * level))
    return full.select("source", "source_size", target.alias("target"))


def _draw(seed: int, level: int, one: Column, other: Column) -> Column:
    """A number in [0, 1) that the two units and the level alone set, so that reruns and lost tasks agree."""
    mixed = F.xxhash64(F.lit(seed), F.lit(level), one["doc_id"], one["size"], other["doc_id"], other["size"], one["source"])
    return F.pmod(mixed, F.lit(1 << 53)) / F.lit(float(1 << 53))


def _with_p(unit: Column, p: Column) -> Column:
    return unit.withField("p", p)


def _duel(seed: int, level: int):
    """One pivotal step: words move between two units until one of them takes all or none of its fraction."""

    def step(state: Column, unit: Column) -> Column:
        held, done = state["held"], state["done"]

        def decided(x: Column) -> Column:
            # up: words that `held` may gain from `unit`; down: words that it may lose.
            up = F.least((1 - held["p"]) * held["size"], unit["p"] * unit["size"])
            down = F.least(held["p"] * held["size"], (1 - unit["p"]) * unit["size"])
            moved = F.when(x * (up + down) < down, up).otherwise(-down)
            return F.struct(
                (held["p"] + moved / held["size"]).alias("a"), (unit["p"] - moved / unit["size"]).alias("b")
            )

        def settled(ps: Column) -> Column:
            # The one nearest to 0 or 1 is the one that became whole.
            gap_a, gap_b = F.least(ps["a"], 1 - ps["a"]), F.least(ps["b"], 1 - ps["b"])
            first = gap_a <= gap_b
            out = F.when(first, F.struct(_with_p(held, ps["a"]).alias("unit"), (ps["a"] > 0.5).cast("int").alias("up")))
            out = out.otherwise(F.struct(_with_p(unit, ps["b"]).alias("unit"), (ps["b"] > 0.5).cast("int").alias("up")))
            rest = F.when(first, _with_p(unit, ps["b"])).otherwise(_with_p(held, ps["a"]))
            return F.struct(rest.alias("held"), F.array_append(done, out).alias("done"))

        met = bound(bound(_draw(seed, level, held, unit), decided), settled)
        return F.when(held.isNull(), F.struct(unit.alias("held"), done.alias("done"))).otherwise(met)

    return step


def _rounded(rows: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, n, base, target, source_size, ups): each of the n equal rows is taken `base` times, `ups` of
    them once more. The fractions of `rate` are rounded on a tree of blocks; each level is a stored table."""
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < _TINY, F.round("rate")).otherwise(F.col("rate"))
    base = F.floor(near)
    # The n equal rows share n fractions: whole ones at once, the rest as one unit.
    share = (near - base) * F.col("n")
    whole = F.when(F.abs(share - F.round(share)) < _TINY, F.round(share)).otherwise(F.floor(share))
    rows = rows.withColumn("base", base.cast("long")).withColumn("extra", whole.cast("long"))
    rows = stored(rows.withColumn("p", F.when(F.col("size") > 0, share - whole).otherwise(0.0)), "shares")
    unit = F.struct("size", "doc_id", "source", "n", "base", F.col("target").alias("goal"), F.col("source_size").alias("total"), "extra", "p")
    units = rows.where(f"p > {_TINY}").select(unit.cast(_UNIT).alias("unit"))
    left = stored(units.groupBy(F.col("unit.source").alias("s")).agg(F.count("*").alias("blocks")), "blocks")
    most = left.agg(F.max("blocks")).first()[0] or 0
    names = ["doc_id", "source", "size", "n", "base", "target", "source_size"]
    done = rows.where(f"p <= {_TINY}").select(*names, F.col("extra").alias("ups"))
    decided = []
    level = 0
    while most:
        count = F.greatest(F.lit(1), F.ceil(F.col("blocks") / float(BLOCK) ** (level + 1)))
        dealt = units.join(left, F.col("unit.source").eqNullSafe(F.col("s")))
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "unit.doc_id", "unit.size", "unit.source"), count)
        groups = dealt.groupBy(F.col("unit.source").alias("source"), place.alias("block")).agg(
            F.sort_array(F.collect_list("unit"), asc=False).alias("units")
        )
        start = F.struct(F.lit(None).cast(_UNIT).alias("held"), F.array().cast(_DONE).alias("done"))
        folded = groups.select(F.aggregate("units", start, _duel(seed, level)).alias("state"))
        folded = stored(folded.select("state.held", "state.done"), f"level-{level}")
        decided.append(folded.select(F.explode("done").alias("d")).select("d.unit", "d.up"))
        units = folded.select(F.col("held").alias("unit"))
        if most <= BLOCK ** (level + 1):
            last = F.col("unit")
            decided.append(units.select("unit", (_draw(seed, -1, last, last) < last["p"]).cast("int").alias("up")))
            break
        level += 1
    for ups in decided:
        u = F.col("unit")
        fields = [u[f].alias(n) for f, n in zip(("doc_id", "source", "size", "n", "base", "goal", "total"), names, strict=True)]
        done = done.union(ups.select(*fields, u["extra"] + F.col("up")))
    return done


def _nearer(improves):
    """One step over a source's large texts: each is taken once more or once less if `improves` says so of the words that
    the source is off its target and the text's size."""

    def step(state: Column, text: Column) -> Column:
        off, size = state["off"], text["size"]
        times = text["n"] * text["base"] + text["ups"]
        less = (off > 0) & (times > 0)
        more = (off < 0) & (times < MOST * text["n"])
        change = F.when(improves(F.abs(off), size) & (less | more), -F.signum(off)).otherwise(0.0).cast("long")
        after = bound(times + change, lambda t: bound(F.floor(t / text["n"]).cast("long"), lambda b: F.struct(b.alias("base"), (t - b * text["n"]).alias("ups"))))
        settled = bound(after, lambda a: text.withField("base", a["base"]).withField("ups", a["ups"]))
        return F.struct((off + change * size).alias("off"), F.array_append(state["texts"], settled).alias("texts"))

    return step


def _settled(large: DataFrame, off: DataFrame) -> DataFrame:
    """`large` with texts taken once more or less where that brings a source, `off` (s, off) words, nearer to none.

    Larger texts first: one at least halves what its source is off, then whatever still brings it nearer. A source has fewer
    than LARGE different large texts, so one row holds them all.
    """
    kind = "array<struct<size:bigint,doc_id:bigint,n:bigint,base:bigint,ups:bigint>>"
    texts = F.sort_array(F.collect_list(F.struct("size", "doc_id", "n", "base", F.col("ups").cast("long").alias("ups"))), asc=False)
    held = large.groupBy("source", "target", "source_size").agg(texts.cast(kind).alias("texts"))
    held = held.join(off, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    for improves in (lambda off, size: (2 * size >= off) & (2 * size <= 3 * off), lambda off, size: size < 2 * off):
        start = F.struct("off", F.array().cast(kind).alias("texts"))
        held = held.withColumn("state", F.aggregate("texts", start, _nearer(improves)))
        held = held.select("source", "target", "source_size", "state.off", "state.texts")
    each = held.select("source", "target", "source_size", F.explode("texts").alias("t"))
    return each.select("t.doc_id", "source", "t.size", "t.n", "t.base", "target", "source_size", "t.ups")


def _took(large: DataFrame) -> DataFrame:
    """(s, took, held, goal, total): of each source's large texts the words taken and held; its target and its size."""
    return large.groupBy(F.col("source").alias("s")).agg(
        F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("ups"))).alias("took"),
        F.sum(F.col("size") * F.col("n")).alias("held"),
        F.max("target").alias("goal"),
        F.max("source_size").alias("total"),
    )


def _closed(done: DataFrame) -> DataFrame:
    """`done` with at most one text of each source taken once more or once less: the one whose change brings the source's
    words nearest to its target, if any brings them nearer.

    Pivotal steps leave a source off by part of the text that is drawn last. A text changes only between `base` and one
    more, as its fraction allows. One row per source is gathered, combined before the shuffle.
    """
    words_taken = F.col("size") * (F.col("n") * F.col("base") + F.col("ups"))
    off = done.groupBy(F.col("source").alias("s")).agg((F.sum(words_taken) - F.max("target")).alias("off"))
    near = F.broadcast(off) if off.count() <= SOURCES else off
    fits = F.when(F.col("off") > 0, F.col("ups") > 0).otherwise((F.col("ups") < F.col("n")) & (F.col("base") < MOST))
    gap = F.abs(F.abs("off") - F.col("size"))
    able = done.join(near, F.col("source").eqNullSafe(F.col("s"))).where(fits & (F.col("size") > 0) & (gap < F.abs("off")))
    best = able.groupBy("s").agg(
        F.min(F.struct(gap.alias("gap"), "size", "doc_id", F.when(F.col("off") > 0, -1).otherwise(1).alias("by"))).alias("b")
    )
    best = stored(best.select("s", F.col("b.size").alias("z"), F.col("b.doc_id").alias("d"), F.col("b.by").alias("by")), "closing")
    near = F.broadcast(best) if best.count() <= SOURCES else best
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & F.col("doc_id").eqNullSafe(F.col("d"))
    changed = done.join(near, same, "left").withColumn("ups", F.col("ups") + F.coalesce("by", F.lit(0)))
    return changed.drop("s", "z", "d", "by")


def mixed(documents: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, source, copies, taken) for every row of `documents` (doc_id, source, text).

    Size counts words. Each document should be taken target / source_size times. The whole part is given to all; the
    fractions are rounded by pivotal steps that keep each source's words: blocks of about BLOCK fractions, larger
    texts first, leave one fraction each, and blocks of those the next level, until one per source is left, which is
    drawn. So a source's words miss its target by less than one (mostly short) document, and then one text that makes up
    for most of that is taken once more or less (`_closed`). The fewer than LARGE texts that
    hold over 1 / LARGE of their source each are rounded before the rest, whose rate then makes up for them; where the rest
    is too small for that, single large texts are taken once more or less (`_settled`). Blocks are dealt by hash, so a
    source with most rows is spread over many. Rows alike in doc_id, source and size are one unit with a count. Sizes of
    zero (null, empty, blank) take nothing; null sources are one source, last; null doc_ids are documents too; an
    empty table gives no rows. No document is taken more than MOST times. Reruns agree.
    """
    size = F.size(words(F.col("text"))).cast("long")
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sizes = stored(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    goals = targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size"))).withColumnRenamed("source", "s")
    rows = stored(sizes.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "goals")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    large = F.col("size") * LARGE > F.col("source_size")
    first = stored(_rounded(rows.where(large).withColumn("rate", rate), seed), "large-texts")
    # Where the rest could not make up for the large texts, these come as near as they can to their own share.
    left, small = F.col("goal") - F.col("took"), F.col("total") - F.col("held")
    unreached = (left < 0) | (left > MOST * small)
    off = F.when(unreached, F.col("goal") * F.col("held") / F.col("total") - F.col("took")).otherwise(0.0)
    off = stored(_took(first).select("s", (-off).alias("off")), "off-target")
    first = stored(_settled(first, off), "settled")
    took = _took(first).select("s", "took", "held")
    rest = rows.where(~large).join(took, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    open_size = F.col("source_size") - F.coalesce("held", F.lit(0))
    open_rate = F.when(open_size > 0, (F.col("target") - F.coalesce("took", F.lit(0))) / open_size).otherwise(0.0)
    open_rate = F.least(F.lit(float(MOST)), F.greatest(F.lit(0.0), open_rate))
    done = first.union(_rounded(rest.withColumn("rate", open_rate).drop("took", "held"), seed + 1))
    done = _closed(done)
    # Equal rows are told apart by a number only: the first `ups` of them are taken once more.
    each = done.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("k") <= F.col("ups")).cast("long")).otherwise(0)
    each = each.withColumn("copies", copies.cast("long"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return each.select("doc_id", "size", "source_size", "target", "source", "k", "copies", taken)


def with_copies(documents: DataFrame, seed: int = 7, into: str = "mix") -> DataFrame:
    """The rows of `documents` that the mix takes, with a struct `into` of size, source_size, target, copies and taken.

    Rows alike in doc_id, source and size are told apart by a number in the order of their texts' hashes; each is judged
    on its own.
    """
    unused(documents, into)
    fields = ["size", "source_size", "target", "copies", "taken"]
    took = mixed(documents, seed).where("copies > 0")
    took = took.select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("k").alias("__n"),
        F.struct(*fields).alias(into),
    )
    sized = documents.withColumn("__size", F.size(words(F.col("text"))).cast("long"))
    again = documents.groupBy("doc_id").count().where("count > 1")
    number = F.lit(1)
    if not again.isEmpty():  # rows are numbered only where ids repeat
        number = F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64("text")))
    sized = sized.withColumn("__k", number.cast("long"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s"))
    same = same & (F.col("__size") == F.col("__z")) & (F.col("__k") == F.col("__n"))
    return sized.join(took, same).drop("__d", "__s", "__z", "__n", "__size", "__k")


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_pivotal_mix": op6_pivotal_mix}
SQL: dict[str, str] = {}
