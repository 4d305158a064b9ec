"""Byte-pair encoding: training to a full vocabulary, encoding and decoding.

Training repeats one step: of all neighbouring symbols in the words of the corpus the most frequent pair (ties: the larger one)
becomes a symbol. A job for each step would be thousands, so one round of jobs makes as many steps as can be told exactly from a
bounded excerpt. The most frequent pairs are the candidates of a round; cutting every word where two neighbours are no candidate
leaves runs, and runs alike are counted together. A pair that reaches over a cut never becomes more frequent than the first pair
that is no candidate. So as long as the best pair inside the runs is more frequent than that, it is the best of all, and the
driver makes its steps on the counted runs (at most RUNS of them: the number of candidates is chosen so). Then every word gets the
outcome of its runs, and the next round begins on a new table.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T
from ..plans.registry import query
from ..sources.shared import discard, stored, written
from ..sources.tables import documents

#: The mark of a word's end, the tokens that every vocabulary begins with (the pieces of citation markers among them), and the pattern of a pre-token.
END = "</w>"
BASE = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", "<SEP>", "[E", "]", "0", "1", "2", "3", "4", "5", "6", "7", "8", "9"]
UNKNOWN = 1
SPECIAL = 5
PRETOKEN = r"\[[eE][0-9]+\]|[\p{L}\p{Nl}\p{No}]+|\p{Nd}+|[^\p{L}\p{N}\p{Z}_\s\x0B\x1C-\x1F\x85]"
MARKER = r"^\[E[0-9]+\]$"
#: Tokens of a production vocabulary.
VOCABULARY = 8_000
#: Distinct runs that a round may bring to the driver, and about how many candidates are tried.
RUNS = 30_000
#: Tokens of a training row.
ROW = 512
LEVELS = (16, 64, 256, 1024, 4096, 16_384, 65_536)
#: Symbols of word types that a task handles at a time, but for a batch that alone has more; each takes about 150 bytes while runs are told.
HELD = 250_000
#: Pre-tokens of documents that are encoded at a time.
AT_ONCE = 200_000
#: Distinct pre-tokens whose ids a task keeps from one lot to the next.
KEPT = 200_000


def pretokens(text: Column) -> Column:
    """Citation markers, runs of letters, runs of digits and single marks, in lower case; a marker keeps its E."""
    found = F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))
    # most texts have no marker, whose tokens need not be looked at one by one
    return F.when(F.rlike(text, F.lit(r"\[[eE][0-9]+\]")), F.transform(found, lambda t: F.when(marked(t), F.upper(t)).otherwise(F.lower(t)))).otherwise(F.transform(found, F.lower))


def marked(token: Column) -> Column:
    """Whether a pre-token is a citation marker: no other one begins with a bracket and goes on."""
    return token.startswith("[") & (F.length(token) > 1)


def word_types(docs: DataFrame) -> DataFrame:
    """(word, freq): every distinct pre-token of the corpus, markers left out, with its count."""
    words = T.each(docs, [], pretokens(F.col("text")), "word").where(~marked(F.col("word")))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def symbols(word: Column) -> Column:
    """A word's characters, then the mark of its end."""
    return F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit(END)))


def pair_counts(types: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring symbols over word types, weighed by frequency."""
    pairs = F.arrays_zip(F.slice("symbols", F.lit(1), F.size("symbols") - 1).alias("left"), F.slice("symbols", F.lit(2), F.size("symbols") - 1).alias("right"))
    return types.where(F.size("symbols") > 1).select("freq", F.explode(pairs).alias("p")).groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("freq").alias("n"))


class Types:
    """Word types side by side: the symbols of all of them as numbers, how many each has, and how often each stands in the corpus."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.sizes, self.freq = symbols, sizes, freq
        self.word = np.repeat(np.arange(len(sizes)), sizes)
        self.inside = self.word[1:] == self.word[:-1]
        self.pairs = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]

    def pair_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct neighbours inside words, and their frequencies."""
        return sums(self.pairs[self.inside], self.freq[self.word[:-1][self.inside]])

    def runs(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, symbols, hash) of every run: the longest stretches whose neighbours are all joined."""
        left = np.concatenate([[False], joined])
        right = np.concatenate([joined, [False]])
        start = np.flatnonzero(right & ~left)
        if not len(start):
            return start, start, start
        size = np.flatnonzero(left & ~right) - start + 1
        at = spread(start, size)
        place = at - np.repeat(start, size)
        value = mixed(self.symbols[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return start, size, mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64)).view(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of stretches of these sizes, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of n over each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))


def joined(flat: pa.StringArray, size: np.ndarray) -> pa.StringArray:
    """Strings put together, so many of them to each text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat), "")


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[Types]:
    """The word types of a task, about HELD symbols at a time, however many it has."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        kept.append(b)
        size += len(b.column("symbols").flatten())
        if size >= HELD:
            yield types_of(kept)
            kept, size = [], 0
    if sum(x.num_rows for x in kept):
        yield types_of(kept)


def types_of(kept: list[pa.RecordBatch]) -> Types:
    parts = [b.column("symbols") for b in kept]
    return Types(np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]), np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts]), np.concatenate([b.column("freq").to_numpy() for b in kept]))


def numbered(types: DataFrame, alphabet: list[str]) -> DataFrame:
    """(symbols, freq): words as the numbers of their characters in the sorted alphabet, then that of the end of a word, which comes behind the alphabet."""
    code = np.array([ord(c) for c in alphabet], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            flat = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
            size = np.array([len(w) + 1 for w in words], np.int64)
            ids = np.searchsorted(code, flat)
            ids[np.cumsum(size) - 1] = len(code)
            yield pa.RecordBatch.from_arrays([lists(ids, size), b.column("freq").cast(pa.int64())], names=["symbols", "freq"])

    return types.select("word", "freq").mapInArrow(cut, "symbols array<int>, freq bigint")


def numbered_pairs(types: DataFrame) -> DataFrame:
    """(pair, n): the neighbours of numbered() types, left and right in one number, summed in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in held(batches):
            pair, n = t.pair_sums()
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return types.mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def counted_runs(types: DataFrame, pairs: np.ndarray, ranks: np.ndarray, levels: tuple[int, ...]) -> DataFrame:
    """(level, run, n): the runs of every level, whose candidates are the pairs of a lower rank; pairs are sorted, and at most LEVELS[-1]."""
    sent = types.sparkSession.sparkContext.broadcast((pairs, ranks))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in held(batches):
            rank = rank_of(t, *sent.value)
            for level in levels:
                start, size, key = t.runs(rank < level)
                if not len(start):
                    continue
                _, first, which = np.unique(key, return_index=True, return_inverse=True)
                n = np.bincount(which, minlength=len(first)) * 0
                np.add.at(n, which, t.freq[t.word[start]])
                run = lists(t.symbols[spread(start[first], size[first])], size[first])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), level), pa.int32()), run, pa.array(n, pa.int64())], names=["level", "run", "n"])

    return types.mapInArrow(counted, "level int, run array<int>, n bigint").groupBy("level", "run").agg(F.sum("n").alias("n"))


def rank_of(t: Types, pairs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of every pair of neighbours; of those that are no candidate, or not of one word, a number above all."""
    found = np.minimum(np.searchsorted(pairs, t.pairs), len(pairs) - 1)
    return np.where((pairs[found] == t.pairs) & t.inside, ranks[found], np.iinfo(np.int64).max)


def replaced(types: DataFrame, pairs: np.ndarray, ranks: np.ndarray, level: int, before: list[list[int]], after: list[list[int]]) -> DataFrame:
    """types with the outcome of every run in its place (at most RUNS of them); types of one symbol have nothing to merge and go."""
    size, new = (np.array([len(x) for x in runs], np.int64) for runs in (before, after))
    flat = np.array([y for x in before for y in x], np.int32)
    own = Types(flat, size, size)
    key = own.runs(own.inside)[2]
    order = np.argsort(key)
    if len(np.unique(key)) < len(key):
        raise ArithmeticError("two runs have one hash")
    sent = types.sparkSession.sparkContext.broadcast((pairs, ranks, key[order], new[order], (np.cumsum(new) - new)[order], np.array([y for x in after for y in x], np.int32)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ranks, keys, sizes, places, outcome = sent.value
        for t in held(batches):
            start, size, key = t.runs(rank_of(t, pairs, ranks) < level)
            symbols, keep = t.symbols.copy(), np.ones(len(t.symbols), bool)
            if len(start):
                at = np.searchsorted(keys, key)  # every run of the table is among the keys
                keep[spread(start, size)] = False
                put_at = spread(start, sizes[at])
                keep[put_at] = True
                symbols[put_at] = outcome[spread(places[at], sizes[at])]
            left = np.add.reduceat(keep.astype(np.int64), np.cumsum(t.sizes) - t.sizes)
            more = left > 1
            yield pa.RecordBatch.from_arrays([lists(symbols[keep & more[t.word]], left[more]), pa.array(t.freq[more])], names=["symbols", "freq"])

    return types.mapInArrow(put, "symbols array<int>, freq bigint")


#: Pre-tokens and pairs in DuckDB.
PAIRS_SQL = rf"""
wt AS MATERIALIZED (SELECT word, count(*) AS freq, string_split(word, '') || ['{END}'] AS sy FROM (
  SELECT CASE WHEN regexp_matches(upper(t), '{MARKER}') THEN upper(t) ELSE lower(t) END AS word FROM (SELECT unnest(regexp_extract_all(text, '{PRETOKEN}')) AS t FROM documents))
  WHERE NOT regexp_matches(word, '{MARKER}') GROUP BY word),
pr AS MATERIALIZED (SELECT sy[i] AS "left", sy[i + 1] AS "right", sum(freq)::BIGINT AS n FROM (SELECT sy, freq, unnest(range(1, len(sy))) AS i FROM wt) GROUP BY ALL)"""


class _Larger:
    """A pair in a heap: the larger stands first."""

    __slots__ = ("pair",)

    def __init__(self, pair: tuple[str, str]) -> None:
        self.pair = pair

    def __lt__(self, other: _Larger) -> bool:
        return self.pair > other.pair


def _joined(parts: list[str], pair: tuple[str, str]) -> list[str]:
    out, k = [], 0
    while k < len(parts):
        step = 2 if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair else 1
        out.append("".join(parts[k : k + step]))
        k += step
    return out


def steps(runs: list[tuple[tuple[str, ...], int]], least: int, known: set[str], room: int) -> tuple[list[tuple[str, str, int]], list[list[str]]]:
    """The merges (left, right, n) that counted runs tell exactly, and the runs after them.

    A merge needs more than least occurrences, but for the first, which is the best of all pairs. At most room new tokens are made. A
    merge that gives a token of known ends the round: runs do not show all places of such a token.
    """
    now = [list(r) for r, _ in runs]
    count: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, (parts, (_, n)) in enumerate(zip(now, runs)):
        for p in zip(parts, parts[1:]):
            count[p] += n
            where[p].add(k)
    heap = [(-n, _Larger(p)) for p, n in count.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str, int]] = []
    while heap and room > 0:
        n, best = -heap[0][0], heapq.heappop(heap)[1].pair
        if count.get(best, 0) != n or n <= 0:
            continue
        if merges and n <= least:
            break
        merges.append((*best, n))
        changed = set()
        for k in where.pop(best):
            new, freq = _joined(now[k], best), runs[k][1]
            if len(new) == len(now[k]):
                continue
            for p in zip(now[k], now[k][1:]):
                count[p] -= freq
                changed.add(p)
            for p in zip(new, new[1:]):
                count[p] += freq
                where[p].add(k)
                changed.add(p)
            now[k] = new
        for p in changed:
            if count[p] > 0:
                heapq.heappush(heap, (-count[p], _Larger(p)))
        if best[0] + best[1] in known:
            break
        known.add(best[0] + best[1])
        room -= 1
    return merges, now


def _levels(pairs: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of candidates, each with the count of the first pair that is none: pairs of one count are candidates together."""
    # the first LEVELS[-1] counts, each of one pair at least
    counts = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("n")).limit(LEVELS[-1] + 1).collect()
    upto, ends = 0, []
    for k, c in enumerate(counts):
        upto += c["size"]
        ends.append((upto, counts[k + 1].n if k + 1 < len(counts) else 0))
    out = dict(found[-1] for most in LEVELS if (found := [e for e in ends if e[0] <= most]))
    return sorted(out), [out[k] for k in sorted(out)]


def _single(pairs: DataFrame, names: list[str]) -> tuple[int, int]:
    """The best pair of all and its count, where no level can be taken: the largest of those that are most frequent."""
    table = F.broadcast(pairs.sparkSession.createDataFrame(list(enumerate(names)), "id int, name string"))  # as many as symbols
    most = pairs.where(F.col("n") == pairs.agg(F.max("n").alias("n")).first()["n"])
    sides = most.withColumns({"l": F.shiftright("pair", 32).cast("int"), "r": F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")})
    named = sides.join(table.select(F.col("id").alias("l"), F.col("name").alias("left")), "l").join(table.select(F.col("id").alias("r"), F.col("name").alias("right")), "r")
    best = named.orderBy(F.desc("left"), F.desc("right")).first()
    return best.pair, best.n


def learn(types: DataFrame, vocabulary: int = VOCABULARY) -> tuple[list[str], list[tuple[str, str, int]]]:
    """The tokens of a vocabulary in the order of their ids, and the merges (left, right, n) in the order in which they are made.

    types has word and freq, each word once. First come the base tokens, then the characters in order, then what the merges give; the
    vocabulary ends when it is full or no pair is left. Characters beyond a full vocabulary are unknown. An empty table gives the base tokens.
    """
    if vocabulary < len(BASE):
        raise ValueError(f"a vocabulary of {vocabulary} tokens has no room for the base tokens")
    types = types.where("word <> ''")
    # every character once: as many as Unicode has at most
    alphabet = sorted(r.c for r in types.select(F.explode(F.array_distinct(F.filter(F.split("word", ""), lambda c: c != ""))).alias("c")).distinct().collect())
    if not alphabet:
        return list(BASE), []
    names = [*alphabet, END]
    numbers = {c: k for k, c in enumerate(names)}
    tokens = [*BASE, *[c for c in sorted(names) if c not in BASE]][: max(vocabulary, len(BASE))]
    known, merges = {*tokens, *names}, []
    now, path = stored(numbered(types, alphabet), "words")
    reach = 1
    while len(tokens) < vocabulary:
        pairs, counts = stored(numbered_pairs(now), "pairs")
        levels, leasts = _levels(pairs)
        # three levels about the one that the last round took
        levels, leasts = (x[max(reach - 1, 0) : reach + 2] for x in (levels, leasts))
        first = pairs.where(F.col("n") > leasts[-1]).collect() if levels else []  # as many as the last of these levels
        order = sorted(first, key=lambda r: -r.n)
        rank = {r.pair: k for k, r in enumerate(order)}
        used = [counts]
        if levels:
            key = np.array(sorted(rank), np.int64)
            ranks = np.array([rank[k] for k in key.tolist()], np.int64)
            counted, at = stored(counted_runs(now, key, ranks, tuple(levels)), "runs")
            used.append(at)
            sizes = {r.level: r.n for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
            fit = [k for k, level in enumerate(levels) if sizes.get(level, 0) <= RUNS]
        if not levels or not fit:
            if not pairs.limit(1).count():
                discard(counts)
                break
            if reach > 1:
                reach = max(reach - 2, 1)
                for u in used:
                    discard(u)
                continue
            best, n = _single(pairs, names)
            key, ranks, level, least = np.array([best], np.int64), np.zeros(1, np.int64), 1, n
            counted, at = stored(counted_runs(now, key, ranks, (1,)), "runs")
            used.append(at)
        else:
            level, least = levels[fit[-1]], leasts[fit[-1]]
            reach = max(reach - 1, 0) + fit[-1]
            reach = max(reach, 1)
        runs = [(r.run, r.n) for r in counted.where(F.col("level") == level).collect()]
        made, after = steps([(tuple(names[i] for i in r), n) for r, n in runs], least, known, vocabulary - len(tokens))
        merges += made
        for a, b, _ in made:
            if a + b not in numbers:
                numbers[a + b] = len(names)
                names.append(a + b)
        tokens += dict.fromkeys(c for a, b, _ in made if (c := a + b) not in set(tokens))
        now, old = replaced(now, key, ranks, level, [r for r, _ in runs], [[numbers[x] for x in a] for a in after]), path
        now, path = stored(now, "words")
        for u in (old, *used):
            discard(u)
    discard(path)
    return tokens, merges


def vocabulary_table(spark: SparkSession, tokens: list[str], merges: list[tuple[str, str, int]]) -> DataFrame:
    """(kind, place, token, left, right, n): the tokens by id and the merges by rank, as a table."""
    rows = [("token", k, t, None, None, None) for k, t in enumerate(tokens)] + [("merge", k, a + b, a, b, n) for k, (a, b, n) in enumerate(merges)]
    return spark.createDataFrame(rows, "kind string, place int, token string, left string, right string, n bigint")


class Encoder:
    """Words as token ids, many at a time: in every word the neighbours of the lowest rank become one, until none is left."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str, int]]) -> None:
        self.ids = {t: k for k, t in enumerate(tokens)}
        self.size = len(tokens)
        self.of = np.full(0x110000, UNKNOWN, np.int32)  # the id of every character
        for t, k in self.ids.items():
            if len(t) == 1:
                self.of[ord(t)] = k
        rank: dict[int, tuple[int, int]] = {}
        for k, (a, b, _) in enumerate(merges):
            rank[self.ids[a] * self.size + self.ids[b]] = (k, self.ids[a + b])  # a pair that is learned twice counts by its last rank
        self.keys = np.array(sorted(rank), np.int64)
        self.ranks = np.array([rank[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([rank[k][1] for k in self.keys.tolist()], np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        long = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = self.of[np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4")].astype(np.int64)
        at[np.cumsum(long) - 1] = self.ids.get(END, UNKNOWN)
        word = np.repeat(np.arange(len(words)), long)
        open_ = np.ones(len(words), bool)
        never = len(self.keys)
        while len(at) > 1 and never and open_.any():
            pair = at[:-1] * self.size + at[1:]
            found = np.minimum(np.searchsorted(self.keys, pair), never - 1)
            hit = (self.keys[found] == pair) & (word[:-1] == word[1:]) & open_[word[:-1]]
            least = np.full(len(words), np.iinfo(np.int64).max)
            np.minimum.at(least, word[:-1][hit], self.ranks[found][hit])
            take = hit & (self.ranks[found] == least[word[:-1]])
            open_ &= least < np.iinfo(np.int64).max
            if not take.any():
                break
            # of neighbours that overlap (three alike in a row) every other one, from the left
            begin = take & ~np.concatenate([[False], take[:-1]])
            place = np.arange(len(take))
            take &= (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
            at[:-1][take] = self.made[found][take]
            keep = np.concatenate([[True], ~take])
            at, word = at[keep], word[keep]
        return at.astype(np.int32), np.bincount(word, minlength=len(words))

    def encode_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): encode() of many pre-tokens, a few at a time so that one long word does not hold up the others, and where the ids of each lie; markers in their fixed pieces."""
        start, size, upto = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        marks = [k for k, w in enumerate(words) if w[:1] == "[" and re.match(MARKER, w)]
        apart = set(marks)
        plain = sorted((k for k in range(len(words)) if k not in apart), key=lambda k: len(words[k]))
        out = []
        for lo in range(0, len(plain), 20_000):
            own = plain[lo : lo + 20_000]
            ids, n = self.encode([words[k] for k in own])
            start[own], size[own] = upto + np.cumsum(n) - n, n
            upto += len(ids)
            out.append(ids)
        for k in marks:
            ids = [self.ids[p] for p in ("[E", *words[k][2:-1], "]")]
            start[k], size[k] = upto, len(ids)
            upto += len(ids)
            out.append(np.array(ids, np.int32))
        return np.concatenate([np.zeros(0, np.int32), *out]), start, size


def encoded(types: DataFrame, tokens: list[str], merges: list[tuple[str, str, int]]) -> DataFrame:
    """types with ids: the tokens of every word, each distinct word encoded once; the vocabulary goes to every task, its size is the caller's bound."""
    model = types.sparkSession.sparkContext.broadcast((tokens, merges))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*model.value)
        for b in batches:
            ids, start, size = encoder.encode_all(b.column("word").to_pylist())
            yield b.append_column("ids", lists(ids[spread(start, size)], size))

    return types.mapInArrow(cut, StructType([*types.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decoded(ids: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(key, text) of ids(key, ids): tokens in order without the special ones, an end of word as a space, none at the ends."""
    each = ids.select(key, F.posexplode("ids").alias("place", "id")).where(F.col("id") >= SPECIAL)
    # a vocabulary is bounded by its size
    named = each.join(F.broadcast(tokens.where("kind = 'token'").select(F.col("place").alias("id"), "token")), "id")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda s: s["token"]), "")
    return named.groupBy(key).agg(F.trim(F.replace(whole, F.lit(END), F.lit(" "))).alias("text"))


def encoded_documents(docs: DataFrame, tokens: list[str], merges: list[tuple[str, str, int]]) -> DataFrame:
    """(doc_id, ids, text, intact): the ids of whole texts, what is read back from the ids alone, and whether that is the text's pre-tokens.

    A task encodes a distinct pre-token once, of KEPT at most, and puts the ids of a few texts together, about AT_ONCE pre-tokens at a time. A marker
    is its beginning, its digits and its end. Pre-tokens are joined by spaces, but for a marker, which has none behind it. A null text has no ids.
    """
    model = docs.sparkSession.sparkContext.broadcast((tokens, merges))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*model.value)
        table = pa.array(["" if k < SPECIAL else t.replace(END, " ") for k, t in enumerate(model.value[0])], pa.string())
        known: dict[str, int] = {}
        held_ids, start, many = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64))
        for b in batches:
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("words")).to_numpy())])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1)
                part = b.slice(lo, hi - lo)
                words = part.column("words").flatten().dictionary_encode()
                types, which = words.dictionary.to_pylist(), words.indices.to_numpy()
                new = [t for t in types if t not in known]
                if len(known) + len(new) > KEPT:
                    known, new = {}, types
                    held_ids, start, many = held_ids[:0], start[:0], many[:0]
                ids, begin, n = encoder.encode_all(new)
                known |= zip(new, range(len(known), len(known) + len(new)))
                held_ids, start, many = (np.concatenate(x) for x in ((held_ids, ids), (start, begin + len(held_ids)), (many, n)))
                own = np.fromiter((known[t] for t in types), np.int64, len(types))[which]
                ids = held_ids[spread(start[own], many[own])]
                ends = upto[lo : hi + 1] - upto[lo]
                size = np.diff(np.concatenate([[0], np.cumsum(many[own])])[ends])
                back = pc.utf8_trim(joined(table.take(pa.array(ids)), size), " ")
                spoken = pa.array([t if len(t) > 1 and t[0] == "[" else t + " " for t in types], pa.string())
                said = pc.utf8_rtrim(joined(spoken.take(words.indices), np.diff(ends)), " ")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(ids, size), back, pc.equal(back, said)], names=["doc_id", "ids", "text", "intact"])
                lo = hi

    words = docs.select("doc_id", F.coalesce(pretokens(F.col("text")), F.expr("cast(array() AS array<string>)")).alias("words"))
    return words.mapInArrow(cut, "doc_id bigint, ids array<int>, text string, intact boolean")


def trained(spark: SparkSession, sf_dir: str, vocabulary: int = VOCABULARY) -> tuple[DataFrame, list[str], list[tuple[str, str, int]]]:
    """The word types of documents as a table, and the vocabulary that they give."""
    types = written(word_types(documents(spark, sf_dir)), "types")
    return types, *learn(types, vocabulary)


@query(f'WITH {PAIRS_SQL} SELECT "left", "right", n FROM pr')
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of neighbouring characters before the first merge."""
    return pair_counts(word_types(documents(spark, sf_dir)).select("freq", symbols(F.col("word")).alias("symbols")))


@query(f'WITH {PAIRS_SQL} SELECT "left", "right", n FROM pr ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1')
def bpe_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of the corpus."""
    return bpe_pair_counts(spark, sf_dir).orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(1)


@query()
def bpe_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of 8,000 tokens and its merges with their counts, learned from all documents."""
    _, tokens, merges = trained(spark, sf_dir)
    return vocabulary_table(spark, tokens, merges)


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, freq, n_tokens, ids, decoded): every distinct pre-token with its ids under that vocabulary, and what is read back from the ids."""
    types, tokens, merges = trained(spark, sf_dir)
    rows = written(encoded(types, tokens, merges), "encoded")
    back = decoded(rows.select("word", "ids"), vocabulary_table(spark, tokens, merges), "word")
    return rows.join(back, "word", "left").select("word", "freq", F.size("ids").alias("n_tokens"), F.array_join("ids", " ").alias("ids"), F.coalesce("text", F.lit("")).alias("decoded"))


@query()
def bpe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under that vocabulary: its tokens, the row of 512 that it is padded or cut to, the power of two that it is padded to in a batch, and whether its ids give its pre-tokens back.

    n_unknown counts characters outside the vocabulary; where it is 0, intact is true.
    """
    _, tokens, merges = trained(spark, sf_dir)
    n = F.size("ids")
    row = F.concat(F.slice("ids", 1, ROW), F.array_repeat(F.lit(0), F.greatest(F.lit(ROW) - n, F.lit(0))))
    bucket = F.least(F.lit(ROW), F.greatest(F.lit(16), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))))).cast("int")
    rows = encoded_documents(documents(spark, sf_dir), tokens, merges)
    return rows.select("doc_id", n.alias("n_tokens"), (n - F.size(F.array_remove("ids", UNKNOWN))).alias("n_unknown"), F.md5(F.array_join(row, " ")).alias("row_digest"), (n > ROW).alias("cut"), bucket.alias("bucket"), "intact")
