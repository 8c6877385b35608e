"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what is written otherwise.

The field scores whole spans: how many digits stand in which groups, what separates them, what signs of an address they
have, what stands before and after. It decides on boundaries and kinds jointly, and is trained on the documents
themselves: spans of the exact patterns are its examples, also rewritten in the ways people write them, and so are numbers that only look alike.
"""

import bisect
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.hashing import pieces
from moodstream.llm.shared import table, unused

#: The kinds in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
#: The field is fitted on about so many documents at most (chosen by a hash of doc_id), on so many different cases.
TRAINING_ROWS = 40_000
CASES = 4_000
_CASE_SPANS = 60
#: Bounds of a candidate: groups of digits, labels of a domain, characters of the part before the at sign.
GROUPS = 8
LABELS = 6
REACH = 64
RIDGE = 0.003
ROUNDS = 150

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A group of digits is never entered in its middle: what fails from its start fails from everywhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

_TRIGGER = re.compile(r"[0-9@]+|[\[({<] ?(?:at|dot) ?[\])}>]|(?<= )dot(?= )", re.IGNORECASE)
_RUN = re.compile(r"[+(]{0,2}[0-9]++(?:[ .()\[\]/-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r" ?(?:@|[\[({<] ?(?:at|@) ?[\])}>]) ?| at ", re.IGNORECASE)
_DOT = re.compile(r"\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot ", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _byte(group: str) -> bool:
    short = group.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, leftmost and without overlap within a kind; linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for match in _IP.finditer(text):
        if all(_byte(g) for g in match[0].split(".")):
            out.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
                out.append((match.start(), 3, match.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Where a candidate may lie: around digits, at signs and their spelled forms, two blanks or REACH characters far."""
    out: list[list[int]] = []
    for match in _TRIGGER.finditer(text):
        start, end = match.span()
        if out and end <= out[-1][1]:
            continue
        low, high = max(0, start - REACH, text.rfind("\n", max(0, start - REACH), start) + 1), end + REACH
        line = text.find("\n", end, high)
        high = min(len(text), high if line < 0 else line)
        before = text.rfind(" ", low, max(low, text.rfind(" ", low, start)))
        after = text.find(" ", end, high)
        after = text.find(" ", after + 1, high) if after >= 0 else -1
        start, end = max(low, before + 1), high if after < 0 else after
        if out and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def _side(near: str, far: str) -> str:
    """What a character beside a span is, seen together with the one beyond it."""
    if not near or near.isspace():
        return "_"
    if near.isalpha():
        return "a"
    if near.isdigit():
        return "9"
    if near in ".-/_+@" and far.isalnum():
        return near + "x"
    return near if near in "+(" else "p"


def _sides(text: str, start: int, end: int) -> tuple[str, str]:
    left = _side(text[start - 1 : start], text[start - 2 : start - 1] if start > 1 else "")
    return "L" + left, "R" + _side(text[end : end + 1], text[end + 1 : end + 2])


def _numbers(text: str, run: re.Match) -> Iterator[tuple[int, int, int, list[str]]]:
    """Candidates of the kinds made of digits: from any group to any other."""
    groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
    for i, (start, _) in enumerate(groups):
        digits, sizes, gaps = "", [], []
        lead = ""
        while start - len(lead) > run.start() and len(lead) < 2 and text[start - len(lead) - 1] in "+(":
            lead = text[start - len(lead) - 1] + lead
        for j in range(i, min(len(groups), i + GROUPS)):
            s, end = groups[j]
            if j > i:
                gaps.append(text[groups[j - 1][1] : s])
            if len(digits) + end - s > 19:
                break
            digits += text[s:end]
            sizes.append(str(end - s))
            if len(digits) < 4:
                continue
            shape, gap = "-".join(sizes), "|".join(sorted(set(gaps)))
            if j - i == 3 and not lead and all(_byte(text[a:b]) and b - a <= 3 for a, b in groups[i : j + 1]):
                yield start, end, 1, [f"gap:{gap}", *_sides(text, start, end)]
            if 12 <= len(digits) and luhn(digits):
                yield start, end, 2, [f"gap:{gap}", f"shape:{shape}", f"n:{len(digits)}", *_sides(text, start, end)]
            if 7 <= len(digits) <= 15:
                first = start - len(lead)
                tail = "-".join(sizes[-3:])
                more = [f"tail:{tail}", f"lead:{lead}", f"n:{len(digits)}", f"all:{lead}{shape}{'|'.join(gaps)}"]
                yield first, end, 3, [f"gap:{gap}", f"shape:{shape}", *more, *_sides(text, first, end)]


def _marker(found: str) -> str:
    return "word" if found.strip().isalpha() else "bracket" if found.strip() not in "@." else "plain" if found in "@." else "spaced"


def _addresses(text: str, start: int, end: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """Candidates for addresses: a part before a sign for at, then labels with signs for dot between them."""
    for sign in _AT.finditer(text, start, end):
        low = sign.start()
        while low > max(start, sign.start() - REACH) and text[low - 1] in _LOCAL:
            low -= 1
        label = _LABEL.match(text, sign.end(), end)
        if low == sign.start() or not label:
            continue
        at, dots = _marker(sign[0]), []
        starts = {low: "whole"}
        if (cut := text.rfind(".", low, sign.start() - 1)) >= 0:
            starts[cut + 1] = "part"
        while len(dots) < LABELS:
            dot = _DOT.match(text, label.end(), end)
            label = _LABEL.match(text, dot.end(), end) if dot else None
            if not label:
                break
            dots.append(_marker(dot[0]))
            if at == "word" and "plain" in dots:
                break
            top = label[0]
            more = [f"signs:{at}:{'|'.join(sorted(set(dots)))}", f"labels:{min(len(dots), 4)}"]
            more.append("top:" + ("9" if not top.isalpha() else str(min(len(top), 5))))
            for s, kind in starts.items():
                yield s, label.end(), 0, [*more, f"from:{kind}", *_sides(text, s, label.end())]


def candidates(text: str, start: int, end: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """(start, end, kind, features) of all spans in a region that may be entities."""
    every = chain(_addresses(text, start, end), chain.from_iterable(_numbers(text, run) for run in _RUN.finditer(text, start, end)))
    for s, e, kind, features in every:
        yield s, e, kind, [KINDS[kind], *(f"{KINDS[kind]} {f}" for f in features)]


def best_spans(found: list[tuple[int, int, float]]) -> list[int]:
    """Which spans (start, end, score) are chosen: those without overlap whose scores sum to the most; none scores below 0."""
    order = sorted(range(len(found)), key=lambda k: found[k][1])
    places = sorted({p for s, e, _ in found for p in (s, e)})
    index = {p: k for k, p in enumerate(places)}
    top, back = [0.0] * (len(places) + 1), [-1] * (len(places) + 1)
    at = 0
    for k in range(len(places)):
        top[k] = top[k - 1] if k else 0.0
        while at < len(order) and found[order[at]][1] == places[k]:
            start, _, score = found[order[at]]
            if top[index[start]] + score > top[k]:
                top[k], back[k] = top[index[start]] + score, order[at]
            at += 1
    out, k = [], len(places) - 1
    while k > 0:
        if back[k] >= 0:
            out.append(back[k])
            k = index[found[back[k]][0]]
        else:
            k -= 1
    return out[::-1]


def spans(text: str, weights: dict[str, float]) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of a text: the exact patterns, and what the field adds beside them."""
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    if not weights:
        return out
    taken: list[list[int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for start, end in regions(text):
        free = []
        for s, e, kind, features in candidates(text, start, end):
            score = sum(weights.get(f, 0.0) for f in features)
            # A span that scores no more than nothing is never part of the best choice.
            if score > 0:
                before = bisect.bisect_left(taken, e, key=lambda span: span[0])
                if not before or taken[before - 1][1] <= s:
                    free.append((s, e, kind, score))
        chosen = best_spans([(s, e, score) for s, e, _, score in free])
        out += [(free[k][0], free[k][2], free[k][1], False) for k in chosen]
    return sorted(out)


def _rewritten(kind: int, span: str, pick: int) -> list[tuple[str, int, int]]:
    """Other texts in place of a span: (text, start, end) of the entity in it, or the same start and end where there is none."""
    out = []

    def whole(text: str) -> None:
        out.append((text, 0, len(text)))

    def nothing(text: str) -> None:
        out.append((text, 0, 0))

    digits = _NO_DIGIT.sub("", span)
    if kind == 0:
        name, _, host = span.partition("@")
        for at, dot in ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"), ("[@]", "[.]"), (" (at) ", "."), ("@", " dot ")):
            whole(name + at + host.replace(".", dot))
        labels = host.split(".")
        for text in (f"@{labels[0]}", f"{name} at {host}", f"{name} (at) {labels[0]}", f"{name} [{labels[0]}] {host}", f"{name} dot {labels[0]}", f"{name}@{labels[0]}", f"{name} at {labels[0]}"):
            nothing(text)
    elif kind == 1:
        for dot in ("[.]", "(.)", " . ", "-dot-", "[.", ". "):
            (whole if dot in ("[.]", "(.)") else nothing)(span.replace(".", dot))
        a, b, c, d = span.split(".")
        for text in (f"{a}.{b}.{c}", f"{a}.{b}.{c}.{int(d) + 256}", f"{a}-{b}-{c}-{d}", f"{a} {b} {c} {d}", f"{a}/{b}/{c}/{d}", f"{a}, {b}, {c}, {d}", f"{a}[.]{b}[.]{c}[.]{int(d) + 256}"):
            nothing(text)
    elif kind == 2:
        parts = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        for gap in (".", "/", " - ", " / ", ". "):
            (whole if gap in (".", "/", " - ") else nothing)(gap.join(parts))
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + pick % 8) % 10)
        for text in (wrong, " ".join([wrong[:4], wrong[4:8], wrong[8:]]), wrong[:13], wrong[:10], f"{wrong[:5]}-{wrong[5:10]}", f"{wrong[:3]}-{wrong[3]}-{wrong[4:6]}-{wrong[6:12]}-{wrong[12]}"):
            nothing(text)
    else:
        code, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        abroad = ("1", "33", "34", "44", "49", "351")[pick // 7 % 6]
        for text in (f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{abroad} {a} {b} {c}", f"{code or 1}-{a}-{b}-{c}", f"{code or 1} ({a}) {b}-{c}", f"+{code}/{a}/{b}/{c}", f"({a}) {b} {c}"):
            whole(text)
        year, month, day = 1950 + int(b) % 90, int(a) % 12 + 1, int(c) % 28 + 1
        for text in (
            f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{year}-{month:02}-{day:02} {day:02}",
            f"{year}-{year + 4}", f"{b}{c}", f"{a}{b}{c}", f"{a}{b}", f"{int(a) % 9 + 1} {b} 000", f"{int(a) % 9 + 1}.{b}.{a}.000", f"{a} {b}", f"{a}-{b}", f"3.{a}{b}{c}", f"{c}-{a}{b}",
            f"{a}/{b}{c}", f"{c} {a}{b[:1]}", f"{year}{month:02}{day:02}", f"{a}{c}-{b}", f"{b[:2]} {c} {a[:1]} {c}", f"{c}/{c}", f"{year} {year + 1} {year + 2}", f"{b} {a} {b} {a}",
        ):
            nothing(text)
    return out


def _case(text: str, start: int, end: int, gold: set[tuple[int, int, int]]) -> str | None:
    """A region as training sees it: its candidates with places counted off; None where an entity is no candidate."""
    found = list(islice(candidates(text, start, end), _CASE_SPANS + 1))
    keys = {(s, e, k) for s, e, k, _ in found}
    if not found or len(found) > _CASE_SPANS or not gold <= keys:
        return None
    places = sorted({p for s, e, _, _ in found for p in (s, e)})
    index = {p: k for k, p in enumerate(places)}
    return json.dumps(sorted([index[s], index[e], int((s, e, k) in gold), f] for s, e, k, f in found))


def cases(text: str) -> list[str]:
    """Training cases of a text: its regions, and those with an entity again with other texts in its place."""
    out, left = [], []
    for start, kind, end in base_spans(text):
        if not left or start >= left[-1][2]:
            left.append((start, kind, end))
    unsure = [m.span() for m in (*_CARD.finditer(text), *_PHONE.finditer(text)) if len(_NO_DIGIT.sub("", m[0])) > (15 if m[0][0] == "+" else 19)]
    for start, end in regions(text):
        # Where a pattern ran over the end of an entity, nobody says what is right.
        if any(s < end and start < e for s, e in unsure):
            continue
        inside = [(s, k, e) for s, k, e in left if s < end and start < e]
        out.append(_case(text, start, end, {(s, e, k) for s, k, e in inside}))
        if len(inside) != 1:
            continue
        s, kind, e = inside[0]
        pick = zlib.crc32(text[s:e].encode())
        others = _rewritten(kind, text[s:e], pick)
        for k in range(6):
            new, a, b = others[(pick + k * 7) % len(others)]
            changed = text[max(0, s - REACH) : s] + new + text[e : e + REACH]
            at = s - max(0, s - REACH)
            for x, y in regions(changed):
                if x < at + len(new) and at < y:
                    out.append(_case(changed, x, y, {(at + a, at + b, kind)} if b > a else set()))
    return [c for c in out if c]


def fit(found: list[tuple[str, int]]) -> dict[str, float]:
    """Weights of the features that make the right spans of all cases likeliest among all ways to choose spans.

    Forward and backward sums over a case's places give how likely each candidate is; the slope is what the entities
    have of a feature less what is expected of it. Steps shrink with the slopes seen so far (AdaGrad).
    """
    names: dict[str, int] = {}
    problems = []
    for case, times in found:
        arcs = [(a, b, gold, np.array([names.setdefault(f, len(names)) for f in features])) for a, b, gold, features in json.loads(case)]
        arcs.sort(key=lambda x: x[1])
        problems.append((arcs, max(b for _, b, _, _ in arcs) + 1, 1 + math.log2(times)))
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    total = sum(weight for _, _, weight in problems)
    for _ in range(ROUNDS):
        slope = -RIDGE * w
        for arcs, size, weight in problems:
            scores = [min(30.0, float(w[f].sum())) for _, _, _, f in arcs]
            ahead, at = [0.0] * size, 0
            for k in range(1, size):
                ahead[k] = ahead[k - 1]
                while at < len(arcs) and arcs[at][1] == k:
                    ahead[k] = float(np.logaddexp(ahead[k], ahead[arcs[at][0]] + scores[at]))
                    at += 1
            behind = [0.0] * size
            starts: list[list[int]] = [[] for _ in range(size)]
            for k, (a, _, _, _) in enumerate(arcs):
                starts[a].append(k)
            for k in range(size - 2, -1, -1):
                behind[k] = behind[k + 1]
                for x in starts[k]:
                    behind[k] = float(np.logaddexp(behind[k], behind[arcs[x][1]] + scores[x]))
            for (a, b, gold, f), score in zip(arcs, scores, strict=True):
                slope[f] += weight / total * 100 * (gold - math.exp(ahead[a] + score + behind[b] - ahead[-1]))
        seen += slope * slope
        w += 0.5 * slope / np.sqrt(seen)
    return {name: float(w[k]) for name, k in names.items()}


def learned(documents: DataFrame) -> dict[str, float]:
    """The field's weights from about TRAINING_ROWS documents at most; the CASES commonest different cases reach the driver."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = TRAINING_ROWS / max(1, texts.count())
    if share < 1:
        texts = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def each(batches):
        seen: Counter[str] = Counter()
        for whole in batches:
            for batch in pieces(whole, "text"):
                for text in batch.column("text").to_pylist():
                    seen.update(cases(text or ""))
                if len(seen) > CASES:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["c", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["c", "n"])

    rows = texts.select("text").mapInArrow(each, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return fit([(r.c, r.n) for r in rows.orderBy(F.desc("n"), "c").limit(CASES).collect()])


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def marked(documents: DataFrame, weights: dict[str, float], into: str = "private") -> DataFrame:
    """`documents` (text, any others) with the spans of personal data of each text, in order of start and kind.

    Starts and ends count code points, the end is exclusive. Spans of the exact patterns of different kinds may overlap;
    those that the field adds overlap nothing. Texts are read whole; null and empty ones have no span; repeated rows
    are alike. An empty table gives no rows.
    """
    unused(documents, into)
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"kind": KINDS[k], "start": s, "end": e, "base": base} for s, k, e, base in spans(t or "", shared.value)] for t in texts],
            dtype=object,
        )

    return documents.withColumn(into, F.pandas_udf(each, _SPANS)("text"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = marked(documents, learned(documents)).select("doc_id", "private")
    rows = rows.withColumn("base", F.filter("private", lambda s: s["base"]))
    kinds = F.col("base.kind")
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    added = (F.size("private") - F.size("base")).cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("private")).alias("spans"), added)


QUERIES = {"op13_private_data": op13_private_data}
SQL: dict[str, str] = {}
