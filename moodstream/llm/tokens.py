"""Token counts of a BPE vocabulary, by merging ragged arrays of symbols in step of their ranks."""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.hashing import pieces
from moodstream.llm.shared import table, unused, with_field

BLANK = "▁"
LIMIT = 4096
MODEL = "piece_bpe_32k.model"
_NONE = np.int64(1 << 40)
#: Counts of so many short pre-tokens are remembered in a task; symbols of about so many pre-tokens are merged at once.
_REMEMBERED = 300_000
_SYMBOLS = 150_000


class _Pairs:
    """From pairs of symbols to (rank, merged symbol): open addressing in flat arrays, looked up many at a time."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int64)
        self.merged = np.zeros(size, np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + probe) & (size - 1)
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[slot], self.ranks[slot], self.merged[slot] = keys[who], ranks[who], merged[who]
            left = np.setdiff1d(left, who, assume_unique=True)
            probe += 1
        self.probes = probe

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        home = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for probe in range(self.probes):
            at = (home[open_] + probe) & (len(self.keys) - 1)
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (got != -1)]
            if not len(open_):
                break
        return out


class Merger:
    """Counts the symbols that are left of a pre-token when no pair of neighbours is in the vocabulary any more."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        if any(self.model.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        own = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.falls_back = any(self.model.is_byte(i) for i in ids)
        self.vocabulary = {self.model.id_to_piece(i): i for i in own}
        scores = np.array([self.model.get_score(i) for i in ids])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in own}, reverse=True))}
        long = [p for p in self.vocabulary if len(p) > 1]
        chars = {c for p in long for c in p}
        self.symbol = dict(self.vocabulary)
        for c in sorted(chars - self.vocabulary.keys()):
            self.symbol[c] = len(ids) + len(self.symbol) - len(self.vocabulary)
        self.cost = np.ones(len(ids) + len(self.symbol), np.int64)
        for c in chars - self.vocabulary.keys():
            self.cost[self.symbol[c]] = self._unknown(c)
        keys, ranks, merged = [], [], []
        self.width = len(self.cost)
        for p in long:
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(order[scores[self.vocabulary[p]]])
                    merged.append(self.vocabulary[p])
        keys, ranks, merged = np.array(keys, np.int64), np.array(ranks, np.int64), np.array(merged, np.int32)
        self.pairs = _Pairs(keys, ranks, merged)
        # A merge is calm if what it makes takes part in no merge of the same or a better rank: then all places of one
        # sequence can merge at once, as none of them opens a merge that would have to come before the next place.
        best = np.full(self.width, _NONE, np.int64)
        np.minimum.at(best, keys // self.width, ranks)
        np.minimum.at(best, keys % self.width, ranks)
        rank_of = np.full(self.width, _NONE, np.int64)
        rank_of[merged] = ranks
        self.calm = best > rank_of
        inner = chars - {BLANK}
        split = not any(c == BLANK and p[i] != BLANK for p in long for i, c in enumerate(p[1:]))
        letters = "".join(re.escape(c) for c in sorted(inner)) or ""
        # No piece has a blank after another character, nor one of the other characters among several.
        self.pattern = re.compile(f"{BLANK}*[{letters}]+|{BLANK}+|[^{BLANK}{letters}]+" if split else "(?s:.+)")
        self.inner = inner | {BLANK} if split else None
        self.code = np.full(max((ord(c) for c in self.symbol if len(c) == 1), default=0) + 2, -1, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.code[ord(c)] = i
        self.known: dict[str, int] = {}

    def _unknown(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.falls_back else 1

    def _single(self, chars: str) -> int:
        """Symbols of characters that no longer piece has."""
        return sum(1 if c in self.vocabulary else self._unknown(c) for c in chars)

    def merged(self, tokens: list[str]) -> np.ndarray:
        """How many symbols each pre-token ends up with (weighed by the bytes of unknown characters)."""
        total = np.zeros(len(tokens), np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = self.code[np.minimum(points, len(self.code) - 1)].astype(np.int64)
        owner = np.repeat(np.arange(len(tokens)), sizes)
        lost = symbols < 0
        if lost.any():  # only without the split pattern: such characters never merge
            costs = [self._unknown(chr(p)) for p in points[lost]]
            symbols[lost] = self.width - 1
            np.add.at(total, owner[lost], np.array(costs) - self.cost[self.width - 1])
        while len(symbols):
            joint = owner[1:] == owner[:-1]
            slot = self.pairs.find(np.where(joint, symbols[:-1] * self.width + symbols[1:], -2))
            rank = np.append(np.where(slot >= 0, self.pairs.ranks[slot], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, ~joint))
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(low < _NONE, size)
            if not live.all():
                np.add.at(total, owner[~live], self.cost[symbols[~live]])
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                slot = np.append(slot, -1)[live]
                size, low = size[low < _NONE], low[low < _NONE]
                if not len(symbols):
                    break
            else:
                slot = np.append(slot, -1)
            hit = rank == np.repeat(low, size)
            # Of overlapping places the left one merges: every second one of a run of hits.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - run) % 2 == 0
            made = self.pairs.merged[np.where(hit, slot, 0)]
            rough = hit & ~self.calm[made]
            if rough.any():  # in those sequences only the leftmost place merges in this round
                sequence = np.repeat(np.arange(len(size)), size)
                wild = np.zeros(len(size), bool)
                wild[sequence[rough]] = True
                at = np.flatnonzero(hit)
                first = np.ones(len(at), bool)
                first[1:] = sequence[at[1:]] != sequence[at[:-1]]
                hit[at[~first & wild[sequence[at]]]] = False
            symbols = np.where(hit, made, symbols)
            stay = ~np.append(False, hit[:-1])
            symbols, owner = symbols[stay], owner[stay]
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. Pre-tokens that stand often are merged once."""
        split = [self.pattern.findall(self.model.normalize(t)) if t else [] for t in texts]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = list({t for tokens in split for t in tokens if t not in known})
        once, start, size = {}, 0, 0
        for at, token in enumerate(fresh):
            size += len(token)
            if size >= _SYMBOLS or at == len(fresh) - 1:
                part = fresh[start : at + 1]
                if self.inner is None:
                    joint = part
                else:
                    joint = [t for t in part if t[-1] in self.inner]
                    once.update((t, self._single(t)) for t in part if t[-1] not in self.inner)
                once.update(zip(joint, self.merged(joint).tolist(), strict=True) if joint else ())
                start, size = at + 1, 0
        known.update(once)
        out = [sum(map(known.__getitem__, tokens)) for tokens in split]
        for t in once:
            if len(t) > 32:
                del known[t]
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One table per process and vocabulary."""
    return Merger(path)


def counted(documents: DataFrame, path: str, into: str = "n_tokens") -> DataFrame:
    """`documents` (text, any others) with the number of tokens that the vocabulary file `path` (on every machine) gives.

    No begin, end or special token is added; special strings in a text are ordinary text. Whole texts are counted
    whatever their length. A null or empty text has 0 tokens; repeated rows are counted as often as given; an empty
    table gives no rows.
    """
    unused(documents, into)

    def each(batches):
        count = merger(path)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                n = pa.array(count.counts(batch.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, into])

    return documents.mapInArrow(each, with_field(documents, into, "long"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = counted(documents, public_tokenizers.path(MODEL))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op5_token_counts": op5_token_counts}
SQL: dict[str, str] = {}
