"""Spelling variants: Aho-Corasick shards of word parts; all words are scanned, matches verified at one edit.

One edit leaves one half of a word as it is: its first half still begins the other word, or its second half still ends
it. Parts that too many words share are cut again, by the half of the rest where the edit may be, so no group of
words is larger than LARGEST whatever the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep, load, ragged, texts_only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: A part that more words have, or ask for, is cut again. With one open letter at most 90 words have it and 8100 ask.
LARGEST = 8192
#: Parts in one automaton, on average.
SHARD = 4096
#: Pairs that are verified at once.
PAIRS = 1 << 20


def run_counts(docs: DataFrame, every: int = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of all whole texts, A-Z lower-cased, long and frequent enough.

    A run loses one letter where `every` divides the crc32 of its document's id and itself (a null id counts as
    empty), which plants slips of the pen. Null texts have no runs.
    """
    lower = F.translate("text", UPPER, LOWER)
    runs = texts_only(docs).select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("k"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("k", "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def part_key(n: int, a: int, b: int, head: str, tail: str) -> int:
    """A signed 64-bit name of the part of words of n letters that has all but letters a to b."""
    return xxhash.xxh3_64_intdigest(f"{n}:{a}:{b}:{head}\0{tail}".encode()) - (1 << 63)


def parts(word: str, n: int, hot: frozenset[int]) -> Iterator[tuple[int, int, int]]:
    """(key, a, b) of the parts that `word` has or, if of another length than n, asks of words of n letters."""
    todo = [(n // 2, n), (0, n // 2)]
    while todo:
        a, b = todo.pop()
        key = part_key(n, a, b, word[:a], word[len(word) - (n - b) :])
        if key in hot and b - a > 1:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        else:
            yield key, a, b


def _routes(vocabulary: DataFrame, hot: frozenset[int], shards: int, least: int) -> DataFrame:
    """A row for each part of each word (scan false), and one for each shard where a word must be scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                size = len(word)
                out += [(key % shards, False, word, n, a, b) for key, a, b in parts(word, size, hot)]
                asked = {key % shards for m in (size - 1, size, size + 1) if m >= least for key, _, _ in parts(word, m, hot)}
                out += [(s, True, word, n, None, None) for s in asked]
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 50_000]), (pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["shard", "scan", "word", "n", "a", "b"])

    return vocabulary.mapInArrow(run, "shard int, scan boolean, word string, n long, a int, b int")


def _key_counts(vocabulary: DataFrame, hot: frozenset[int], least: int) -> DataFrame:
    """key, words, asked: how many words have each part and how many ask for it; only parts that can be cut again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for word in batch["word"].to_pylist():
                size = len(word)
                for m in (size - 1, size, size + 1):
                    if m >= least:
                        for key, a, b in parts(word, m, hot):
                            if b - a > 1:
                                keys[key][0] += m == size
                                keys[key][1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int64()), pa.array([x for x, _ in keys.values()], pa.int64()), pa.array([x for _, x in keys.values()], pa.int64())], names=["key", "words", "asked"])

    counts = vocabulary.select("word").mapInArrow(run, "key long, words long, asked long")
    return counts.groupBy("key").agg(F.sum("words").alias("words"), F.sum("asked").alias("asked")).where("words > 0")


def hot_parts(vocabulary: DataFrame, largest: int = LARGEST, least: int = LEAST_LENGTH) -> frozenset[int]:
    """Parts to cut again. Each has over `largest` words that ask for it, so there are at most 6 * words / largest a level."""
    hot: set[int] = set()
    while True:
        new = {r.key for r in _key_counts(vocabulary, frozenset(hot), least).where(F.col("asked") > largest).select("key").collect()}
        if not new:
            return frozenset(hot)
        hot |= new


def columns(words: list[str], size: int) -> np.ndarray:
    """Letter j of all words of one length in row j; all letters are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size).T.copy()


def one_edit(p: np.ndarray, pi: np.ndarray, v: np.ndarray, vi: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which pairs of words p (letters before a and from b on are known to be the other's) and v differ by one edit whose
    first place is from a to b. p and v: letters in rows, as columns() gives them."""
    n, m = len(p), len(v)
    same = np.ones(len(pi), bool)  # no edit so far
    done = np.zeros(len(pi), bool)  # one edit so far
    for j in range(a, b):
        x = p[j][pi]
        if n == m:
            equal = x == v[j][vi]
            done, same = (done & equal) | (same & ~equal), same & equal
        elif m > n:  # v has one letter more, before p's j-th or after its last
            done = (done | same) & (x == v[j + 1][vi])
            same &= x == v[j][vi]
        else:  # p has one letter more: the j-th or an earlier one
            done = same if j == a else (done & (x == v[j - 1][vi])) | same
            same = same & (x == v[j][vi]) if j < m else np.zeros(len(pi), bool)
    # Equal letters may stand beside an inserted or missing one; the first place where the words part decides.
    return done | same if m > n and b == n else done & ~same


class Shard:
    """An automaton over the parts of some words, and the words in groups of equal part."""

    def __init__(self, rows: list[tuple[str, int, int, int]]) -> None:
        """rows: word, count, a, b."""
        self.groups: list[tuple[int, int, int, int, int, str, str]] = []  # length, a, b, first row, rows, head, tail
        by: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for word, n, a, b in rows:
            by[len(word), a, b, word[:a], word[b:]].append((word, n))
        self.words: list[str] = []
        self.counts: list[int] = []
        self.letters: dict[int, np.ndarray] = {}
        self.base: dict[int, int] = {}
        self.lengths: dict[int, list[str]] = defaultdict(list)
        found: dict[str, list[int]] = defaultdict(list)
        for (size, a, b, head, tail), members in sorted(by.items(), key=lambda x: x[0]):
            if size not in self.base:
                self.base[size] = len(self.words)
            found[head if len(head) >= len(tail) else tail].append(len(self.groups))
            self.groups.append((size, a, b, len(self.words), len(members), head, tail))
            self.words += [w for w, _ in members]
            self.counts += [n for _, n in members]
            self.lengths[size] += [w for w, _ in members]
        self.letters = {size: columns(ws, size) for size, ws in self.lengths.items()}
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        self.n = np.array(self.counts, np.int64)
        self.automaton = ahocorasick.Automaton()
        for text, groups in found.items():
            self.automaton.add_word(text, (len(text), groups))
        self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[tuple[int, int, int, int], tuple[list[int], list[int]]]:
        """By length of the shard's word, a, b and length of the scanned one: scanned words and groups that go with them."""
        out: dict[tuple[int, int, int, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        groups = self.groups
        for i, word in enumerate(words):
            last, size = len(word) - 1, len(word)
            for end, (length, numbers) in self.automaton.iter(word):
                first = end + 1 == length
                if first or end == last:
                    for g in numbers:
                        n, a, b, _, _, head, tail = groups[g]
                        # The offset of the part, the lengths, and the shorter part on the other side.
                        if -1 <= n - size <= 1 and (first and word.endswith(tail) if len(head) >= len(tail) else end == last and word.startswith(head)):
                            x = out[n, a, b, size]
                            x[0].append(i)
                            x[1].append(g)
        return out

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (number of the scanned word, row of the shard) that differ by one edit within the row's open letters."""
        number = np.empty(len(words), np.int64)
        of: dict[int, list[str]] = defaultdict(list)
        for i, w in enumerate(words):
            number[i] = len(of[len(w)])
            of[len(w)].append(w)
        letters = {size: columns(ws, size) for size, ws in of.items()}
        scanned, found = [], []
        for (n, a, b, size), (who, which) in self.hits(words).items():
            who, count = np.array(who, np.int64), np.array([self.groups[g][4] for g in which], np.int64)
            first, upto = np.array([self.groups[g][3] for g in which], np.int64), np.cumsum(count)
            at = 0
            while at < len(who):  # a group has LARGEST rows at most
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + max(1, PAIRS), "right")))
                rows, v = ragged(first[at:to], count[at:to]), np.repeat(who[at:to], count[at:to])
                good = one_edit(self.letters[n], rows - self.base[n], letters[size], number[v], a, b)
                scanned.append(v[good])
                found.append(rows[good])
                at = to
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *scanned]), np.concatenate([none, *found])


def _partials(shard: Shard, words: list[str], counts: list[int]) -> pa.RecordBatch:
    """word, n, n_near, form_n, form: for each scanned word its near ones in this shard, and the most frequent of them."""
    v, rows = shard.near(words)
    order = np.lexsort((shard.rank[rows], -shard.n[rows], v))
    v, rows = v[order], rows[order]
    first = np.flatnonzero(np.diff(v, prepend=-1))
    who = v[first].tolist()
    best = rows[first]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in who], pa.string()), pa.array([counts[i] for i in who], pa.int64()), pa.array(np.diff(np.append(first, len(v)))), pa.array(shard.n[best]), pa.array([shard.words[i] for i in best.tolist()], pa.string())],
        names=["word", "n", "n_near", "form_n", "form"],
    )


def near_words(vocabulary: DataFrame, largest: int = LARGEST, shard: int = SHARD, least: int = LEAST_LENGTH) -> DataFrame:
    """vocabulary (word, n; letters below U+0100, each word once) with n_near, and form_n and form: the near word with the
    largest n, the first in code-point order among equals (null if none). No pairs leave a task.

    Words shorter than `least` letters may not come in. An empty table gives an empty one.
    """
    hot = hot_parts(vocabulary, largest, least)
    spark = vocabulary.sparkSession
    shards = max(1, -(-2 * vocabulary.count() // shard))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, built = None, [], None
        for batch in batches:
            shard_of, scan = np.asarray(batch["shard"]), np.asarray(batch["scan"].cast(pa.uint8()))
            cuts = [0, *(np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(scan.astype(int)) != 0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if shard_of[i] != at:
                    at, rows, built = shard_of[i], [], None
                some = batch.slice(i, j - i)
                if not scan[i]:
                    rows += zip(*(some[c].to_pylist() for c in ("word", "n", "a", "b")))
                elif rows:
                    built = built or Shard(rows)
                    yield _partials(built, some["word"].to_pylist(), some["n"].to_pylist())

    routed = _routes(vocabulary, hot, shards, least).repartition(tasks, "shard").sortWithinPartitions("shard", "scan")
    found = routed.mapInArrow(run, "word string, n long, n_near long, form_n long, form string")
    alone = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))))
    of = found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return of.select("word", "n", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.word").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with root: where following forms ends. Chains get shorter by half with each join."""
    ways, moved, old = forms.where("form is not null").select("word", F.col("form").alias("root")), 1, None
    while moved:
        ways = keep(ways, "roots")
        if old is not None:
            discard(old)
        old = ways
        next_ = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = ways.join(next_, "root", "left_semi").count()
        ways = ways.join(next_, "root", "left").select("word", F.coalesce("_next", "root").alias("root")) if moved else ways
    return forms.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, every: int = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root string; n, n_near, form_n long: frequent words of all texts and the words they are variants of.

    Two words are near if one inserted, deleted or replaced letter makes one of the other. A word's form is its near
    word with the largest n (ties: the first by code point) if that is at least `times` its own, else null; root is where
    forms lead in the end. Null and empty texts have no words, repeated rows count as often as they occur, an empty
    table gives no rows; extra columns are not read. Texts and words may have any length.
    """
    vocabulary = keep(run_counts(docs, every, least_length, least_count), "vocabulary")
    enough = F.col("form_n") >= times * F.col("n")
    forms = near_words(vocabulary, least=least_length).withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))})
    return roots(keep(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling_variants(load(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS k, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
u AS (SELECT k, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM d WHERE length(r) >= 5 GROUP BY 1, 2),
b AS (SELECT r, c, hex(encode(k || r)) AS x FROM u),
h AS (SELECT r, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1 AS BIGINT))),
  lambda y, z: list_reduce(list_prepend(xor(y, z), range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) AS h FROM b),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(c) AS n FROM h GROUP BY 1),
v AS (SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 5 AND n >= 3),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
m AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word),
t AS (SELECT p.word, min(p.other COLLATE "binary") AS form FROM p JOIN m ON p.word = m.word AND p.n = m.top GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 2 * v.n THEN t.form END AS form, CASE WHEN m.top >= 2 * v.n THEN m.top END AS form_n FROM v LEFT JOIN m ON v.word = m.word LEFT JOIN t ON v.word = t.word),
c AS (SELECT word, word AS here, 0 AS i FROM f UNION ALL SELECT c.word, f.form, i + 1 FROM c JOIN f ON c.here = f.word WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(here, i) AS root FROM c GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON f.word = e.word
"""
