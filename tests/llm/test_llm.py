"""Operators of the optional subpackage against brute force, exact round trips and held-out rows."""

import collections
import hashlib
import math
import random
import re
import zipfile

import check_sql
import numpy as np
import pytest

import corpus_pipeline
from moodstream.llm import catalog, chat, decontaminate, lines, mixing, perplexity, quality, simhash, tokens, toxicity, warc
from moodstream.session import fresh_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one two three four five six\none two three four five six\nx", "en", "a", 1),
    (5, "B# é%% 9\n\nB# é%% 9\n", "de", "b", 1),
    (6, " ".join(f"w{i % 7}" for i in range(3000)), "de", "b", 1),
    (7, "same words in every row of this text", "en", "c", 1),
    (7, "same words in every row of this text", "en", "c", 1),
    (None, "no id at all but words", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    # Extra columns whose names operators use inside.
    return spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("copies", F.lit(2))


def test_quality_counts(spark, odd):
    rows = quality.judged(odd, "v").select("doc_id", "text", "v.*").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        found = WORD.findall(r.text or "")
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        count = collections.Counter(windows)
        covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 5)}
        kept = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars) == (len(found), sum(map(len, found)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(kept) - len(set(kept)), len(covered))
        assert r.base_failed == (len(found) < 10 or 100 * len(covered) > 20 * len(found))
    assert quality.judged(odd.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        quality.judged(odd, "kept")


@pytest.mark.parametrize("common, rare", [("και|είναι|του|την|από|στην|που|δεν", "θάλασσα"), ("который|также|было|его|она|чтобы|при|они", "паровоз")])
def test_quality_judges_any_script(spark, common, rare):
    random.seed(3)
    usual = common.split("|")
    texts = [" ".join(random.choice(usual) if random.random() < 0.6 else f"{rare}{chr(random.randint(945, 969))}{random.randint(0, 99)}." for _ in range(80)) for _ in range(60)]
    texts.append(" ".join(rare + chr(1072 + i % 30) + chr(1072 + i // 30) for i in range(80)))
    rows = spark.createDataFrame([(i, t, "x", "a", 0) for i, t in enumerate(texts)], DOCS)
    common = {w.word: w.n for w in quality.language_references(rows).first().common}
    held = collections.Counter(w for t in texts for w in t.split())
    assert set(usual) <= set(common) and all(n == held[w] for w, n in common.items())
    assert not any(w.endswith(".") for w in common)
    verdict = {r.doc_id: r.v for r in quality.judged(rows, "v").collect()}
    assert verdict[60].word_distance > quality.WORD_DISTANCE and not verdict[60].kept and not verdict[60].base_failed
    assert all(verdict[i].word_distance < quality.WORD_DISTANCE for i in range(60))


def test_distance(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(quality.distance(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 1.0])


def _groups(values, near):
    top = list(range(len(values)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [2, 3])
def test_simhash_links(spark, radius):
    random.seed(radius)
    values = {0}
    for _ in range(12):
        at = random.getrandbits(64)
        for _ in range(8):
            values.add(at)
            at ^= 1 << random.randrange(64)
    values = sorted(values)
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    pairs = {(p.a, p.b) for p in simhash.links(rows, radius).collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert pairs <= want

    def classes(links):
        tops = _groups(signed, lambda a, b: (a, b) in links or (b, a) in links)
        return {frozenset(v for v, t in zip(signed, tops, strict=True) if t == top) for top in tops}

    assert classes(pairs) == classes(want)


def test_near_duplicates(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[7] == 7
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()).count("7") == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    random.seed(1)
    many = [(i, "w " * random.randint(1, 60), "en", random.choice("abcc") if i % 9 else None, 0) for i in range(1500)]
    rows = mixing.mixed(spark.createDataFrame(many, DOCS)).collect()
    assert len(rows) == 1500 and rows[0].doc_id is not None
    again = {r.doc_id: r.taken for r in mixing.mixed(spark.createDataFrame(many[::-1], DOCS)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.copies in (math.floor(r.target / r.source_size), math.ceil(r.target / r.source_size)) and r.taken == r.size * r.copies
    total, weight = sum(sizes.values()), dict(zip(["a", "b", "c", None], (1, 2, 3, 1), strict=True))
    full = set()
    while True:  # what is above three times the size goes to the others, until none is
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        assert target[s] == pytest.approx(3 * sizes[s] if s in full else weight[s] * level)
        assert abs(taken[s] - target[s]) <= 60
    # Sources of a few long texts, too: off by less than the smallest text or half a percent.
    texts = []
    for each in (3, 20, 50, 150):
        for i in range(3 * each):
            size = random.choice([random.randint(5, 40), random.randint(200, 900)])
            texts += [(len(texts), "w " * size, "en", f"s{each}-{i % 3}", 0)] * (1 + (i % 7 == 0))
    rows = mixing.mixed(spark.createDataFrame(texts, DOCS)).collect()
    assert len(rows) == len(texts) and all(0 <= r.taken <= 3 * r.size for r in rows)
    for s in {r.source for r in rows if not r.source.startswith("s3-")}:
        own = [r for r in rows if r.source == s]
        off = abs(sum(r.taken for r in own) - own[0].target)
        assert off <= max(min(r.size for r in own), 0.005 * own[0].target), (s, off)
    few = mixing.mixed(odd).collect()
    assert len(few) == len(ODD) and all(r.taken <= 3 * r.size for r in few)
    assert mixing.mixed(odd.limit(0)).count() == 0
    # Different texts of one id, source and size are rows of their own.
    alike = spark.createDataFrame([(1, f"w{i} x", "en", "a", 0) for i in range(5)] + [(2, "y " * 10, "en", "b", 0)], DOCS)
    got = mixing.with_copies(alike, into="m").select("text", "m.*").collect()
    rows = mixing.mixed(alike).where("copies > 0").collect()
    assert len({r.text for r in got}) == len(got) == len(rows) and sum(r.taken for r in got) == sum(r.taken for r in rows)


def test_decontamination(spark, odd):
    random.seed(4)
    vocabulary = ["a", "b", "c", "Dé", "e9"]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.choice([1, 2, 5, 13, 16])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, items[3][1]), (23, "same words in")]
    docs = [(100 + i, ", ".join(random.choice(vocabulary) for _ in range(random.randint(0, 90)))) for i in range(25)]
    docs += [(200 + i, f"x x {items[i][1].upper()} y") for i in range(12)]
    frame = odd.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, w[k : k + 13]) for i, t in items if (w := split(t)) for k in range(max(1, len(w) - 12))]
    rows = decontaminate.marked(frame, bench, "hits").collect()
    assert len(rows) == frame.count()
    for r in rows:
        w, hit, names = split(r.text), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    names.add(str(i))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (r.hits.n_words, r.hits.n_hit, r.hits.n_items, r.hits.items_sha256) == (len(w), len(hit), len(names), digest)
        assert r.hits.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.marked(frame, bench.limit(0), "hits").where("hits.n_hit > 0").count() == 0
    assert decontaminate.marked(frame.limit(0), bench, "hits").count() == 0


def _one_apart(a, b):
    if a == b:
        return True
    cut = lambda x: {(i, *x[:i], *x[i + 1 :]) for i in range(len(x))}
    if len(a) == len(b):
        return bool(cut(a) & cut(b))
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any((*long[:i], *long[i + 1 :]) == tuple(short) for i in range(len(long)))


def test_line_dedup(spark, odd):
    random.seed(9)
    base = ["a", "b", "a b c d e f g h i j", "k l m n o p q r", "z " * 40]
    texts = []
    for i in range(40):
        some = []
        for _ in range(random.randint(0, 4)):
            w = random.choice(base).split()
            for _ in range(random.randint(0, 2)):
                at = random.randrange(len(w) + 1)
                w[at : at + random.randint(0, 1)] = random.choice([[], ["x"], ["y"]])
            some.append("  ".join(w))
        texts.append((500 + i, "\n".join(some)))
    frame = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = lines.deduplicated(frame, "found").collect()
    assert len(rows) == frame.count()
    given = {(d, t) for d, t, *_ in [*ODD, *texts]}
    order = [(d is None, d or 0, k, tuple(WORD.findall(x)), d) for d, t in given for k, x in enumerate((t or "").split("\n")) if t is not None]
    order = sorted(o for o in order if o[3])
    gone = set()
    for at, (_, _, k, w, d) in enumerate(order):
        if any(w == v or (min(len(w), len(v)) >= lines.MIN_WORDS and _one_apart(w, v)) for *_, v, _ in order[:at]):
            gone.add((d, k))
    text_of = dict(given)
    for r in rows:
        t = text_of[r.doc_id]
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == want and r.found.n_removed == sum(d == r.doc_id for d, _ in gone)
    assert lines.deduplicated(frame.limit(0), "found").count() == 0


def test_warc_round_trip(spark):
    pages = [(5, "u", None), (3, None, ""), (9, "u x\n\r", "ab"), (2, "u", "ab"), (7, "ü", "ab"), (None, "u", "ab"), (11, "u", "é\r\n\r\nz" * 9000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.records(warc.written(frame, fresh_dir(spark, "warc"))).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {
        3: ("response", None), 5: ("revisit", 3), 2: ("response", None), 9: ("revisit", 2), 7: ("revisit", 2), None: ("revisit", 2), 11: ("response", None),
    }
    assert bytes(rows[11].payload).decode() == pages[-1][2] and rows[9].payload_bytes == 2
    short = warc.records(warc.written(frame, fresh_dir(spark, "warc"), least=3)).where("record_type = 'revisit'")
    assert short.count() == 0 and warc.written(frame.limit(0), fresh_dir(spark, "warc")).count() == 0


def test_zip_directories(tmp_path):
    import pyarrow as pa

    for wide in (False, True):
        path = str(tmp_path / f"{wide}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
            for k in range(70_000 if wide else 3):  # over 65,535 members ask for a ZIP64 directory
                out.writestr(f"m{k}", b"x" * (k % 5))
        with pa.OSFile(path) as source:
            found = warc.directory(source, source.size())
            with zipfile.ZipFile(path) as had:
                assert [f[:3] for f in found] == [(i.filename, i.compress_type, i.compress_size) for i in had.infolist()]
            source.seek(found[2][3])
            assert source.read(2) == b"xx"


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] \\ \\\\s <|image|> <\\s> [\\INST]"
    rows = spark.createDataFrame([(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, None, None), (None, None, "assistant", "x")], "conv_id long, turn long, role string, text string")
    back = chat.parsed(chat.formatted(rows)).collect()
    assert {(r.turn, r.role, r.text, r.learned) for r in back} == {(0, "user", hard, False), (1, "assistant", hard, True), (2, "", "", False), (None, "assistant", "x", True)}
    found = {r.conv_id: r for r in chat.digests(chat.formatted(rows)).collect()}
    assert found[1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and found[1].n_turns == 3 and found[None].loss_chars == 1
    parts = [("text", "see <s>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a", None, None, 2.0, None), ("document", None, "d", None, None, None, 3)]
    typed = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one = chat.formatted(typed).first()
    assert [(a.position, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "i.png", 3), (1, "audio", "a", 50), (2, "document", "d", 768)]
    assert one.expanded == 821 and one.piece.endswith("<|image|><|audio|><|document|>" + chat.CLOSE)
    assert chat.digests(chat.formatted(rows.limit(0))).count() == 0


def test_token_counts(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(tokens.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(2)
    texts = ["", None, "  a  b ", "a\nb\t c", "</s> <s>[INST]", "▁a", "\0x", "日本語 é", "a" * 999, " " * 300 + "x", "the" * 900, "<0x0A>"]
    texts += ["".join(random.choice("abcdetions the ▁<>ñé\n01") for _ in range(900)) for _ in range(60)]
    assert tokens.Merger(path).counts(texts) == [len(library.encode(t)) if t else 0 for t in texts]
    rows = tokens.counted(odd, path).collect()
    assert [r.n_tokens for r in rows] == [len(library.encode(r.text)) if r.text else 0 for r in rows]


def test_toxicity(spark):
    assert toxicity.folded("L0ser Ѕcum 2024 i d1ot wh@t ab$$$ stu​pid") == ["loser", "scum", "2024", "i", "diot", "what", "ab", "stupid"]
    random.seed(5)
    words = [f"word{i}" for i in range(50)]
    docs = [(i, " ".join([*random.choices(words, k=30), *(["1diot"] if i % 3 == 0 else ["idiot", "proof"] if i % 15 == 1 else [])])) for i in range(300)]
    frame = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    lexicon = toxicity.learned(frame, labels)
    wrong = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - labels.toxic).otherwise(labels.toxic))
    assert toxicity.learned(frame, wrong) == lexicon  # held-out labels have no part
    scores = {r.doc_id: r.score for r in toxicity.scored(frame, lexicon).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901] < 0.3
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert lexicon.stems and "idiot proof" in lexicon.phrases
    assert [i for i in held if scores[i] >= 0.3] == [i for i in held if i % 3 == 0]
    assert toxicity.learned(frame.limit(0), labels).stems == {}


def test_kneser_ney(spark):
    texts = spark.createDataFrame([(1, "x", "abab"), (2, "x", "abc"), (3, "y", "zq"), (4, None, ""), (5, None, None)], "doc_id long, lang string, text string")
    model = perplexity.trained(texts)
    made = perplexity._Model(model.toPandas())
    for start in ("", "ab", "q", "zz"):
        base = made.scores([start])[0][0] if start else 0.0
        total = sum(math.exp(made.scores([start + c])[0][0] - base) for c in "abczq一")
        assert total == pytest.approx(1.0)
    other = spark.createDataFrame([("abz",), ("一",), ("qqab abz",), ("",), (None,)], "text string")
    one = {r.text: r.p for r in perplexity._scored_by_broadcast(other, model, "p").collect()}
    two = {r.text: r.p for r in perplexity._scored_by_join(other, model, "p").collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one if k) and one[""] is None and two[None] is None
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    verdict = {r.doc_id: r.v.kept for r in perplexity.judged(texts, labels, "v").collect()}
    assert verdict[1] and verdict[4] is False and verdict[5] is False


def _plain_kneser_ney(texts, order=4):
    """Log probability of a gram's last character by a dictionary model: modified Kneser-Ney, counts of different beginnings."""
    padded = ["\0" * (order - 1) + t for t in texts]
    counts = {order: collections.Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discount(k, n):
        n1, n2, n3, n4 = (sum(v == x for v in counts[k].values()) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        high = min(n, 3)
        have, more = {1: (n1, n2), 2: (n2, n3), 3: (n3, n4)}[high]
        return min(high, max(0.0, high - (high + 1) * y * more / have)) if have and more else (0.5, 1.0, 1.5)[high - 1]

    def chance(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        after = [(g, n) for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return chance(gram[1:])
        total, own = sum(n for _, n in after), counts[k][gram]
        left = sum(discount(k, n) for _, n in after) / total
        return (max(0.0, own - discount(k, own)) / total if own else 0.0) + left * chance(gram[1:])

    return lambda text: [chance(("\0" * (order - 1) + text)[i : i + order]) for i in range(len(text))]


def test_perplexity_equals_a_plain_model(spark):
    random.seed(5)
    texts = ["".join(random.choice("aabbcd é") for _ in range(random.randint(0, 60))) for _ in range(25)]
    model = perplexity.trained(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = _plain_kneser_ney(texts)
    tried = [*texts[:8], "zzz", "abz", "一 a", texts[0], "abcd " * 4000, "", None]
    # Columns with names that the operator might use inside.
    rows = [(t, 1.0, 2, 3, "g") for t in tried]
    odd = spark.createDataFrame(rows, "text string, k double, a int, b int, gram string")
    for way in (perplexity._scored_by_broadcast, perplexity._scored_by_join):
        got = way(odd, model, "p").collect()
        assert len(got) == len(tried) and got[0].asDict().keys() == {"text", "k", "a", "b", "gram", "p"}
        for r in got:
            part = (r.text or "")[:2000]  # the long text repeats itself: its end has the same mean
            want = math.exp(-sum(map(math.log, plain(part))) / len(part)) if part else None
            assert (r.p is None) if want is None else r.p == pytest.approx(want, rel=1e-6 if len(r.text) == len(part) else 1e-2)
        assert way(odd.limit(0), model, "p").count() == 0


def test_language_model_verdicts_on_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    rows = odd.withColumn("limit", F.lit("x")).withColumn("perplexity", F.lit(0)).withColumn("n", F.lit(1))
    marks = "doc_id long, quality int"
    got = perplexity.judged(rows, spark.createDataFrame([(4, 1), (7, 1), (6, 0)], marks), "v").collect()
    assert len(got) == len(ODD) and all(r.limit == "x" and r.perplexity == 0 for r in got)
    assert all((r.v.perplexity is None) == (not r.text) and (r.text or not r.v.kept) for r in got)
    assert len({tuple(r.v) for r in got if r.doc_id == 7}) == 1
    none = perplexity.judged(rows, spark.createDataFrame([], marks), "v").collect()
    assert all(r.v.kept == bool(r.text) for r in none)
    assert perplexity.judged(rows.limit(0), spark.createDataFrame([], marks), "v").count() == 0


@pytest.mark.parametrize("bits", [24, 13, 6])
def test_trusted_texts_are_exactly_the_good_ones(spark, bits):
    rows = [(i if i % 100 else None, "x", f"t{i}") for i in range(4000)] + [(7, "y", "again"), (7, "y", None)]
    texts = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    marks = [(i, int(i % 3 == 1)) for i in range(0, 6000)] + [(4, 0), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = perplexity.trusted_texts(texts, labels, bits).collect()
    good = {i for i, q in marks if q}
    assert collections.Counter(map(tuple, got)) == collections.Counter(r for r in rows if r[0] is not None and r[0] in good)
    assert perplexity.trusted_texts(texts.limit(0), labels, bits).count() == 0
    assert perplexity.trusted_texts(texts, labels.limit(0), bits).count() == 0


@pytest.mark.parametrize("key", sorted(catalog.all_sql()))
def test_query_equals_sql(spark, key):
    problem, _ = check_sql.compare(spark, check_sql.connect(SF), SF, catalog.all_queries()[key], catalog.all_sql()[key])
    assert problem is None


def test_pipeline(spark, odd):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and 0 < out.count() < docs.count()
    assert out.where("copies < 1").count() == 0 and out.select(F.countDistinct("doc_id")).first()[0] == out.count()
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
