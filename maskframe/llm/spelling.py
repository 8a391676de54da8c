"""Spelling variants: words one edit apart, found in a trie of letter-group counts."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import ascii_lower, table, text_of, written
from maskframe.llm.registry import query

#: Shortest word, fewest occurrences, and how many times as frequent a word's form is.
MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
#: One run in so many loses a letter before counting; the divisor is part of the task.
SLIP = 199
#: The letters of each level of the trie, the most telling ones alone; the last level counts all others.
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "h", "r", "d", "l", "u", "c", "mwfgypb", "vkjxqz")
LEVELS = len(GROUPS) + 1
#: Words of a subtree, and queries put to it, that meet in one task.
MAX_WORDS = 20_000
#: Pairs of words that are verified at a time.
_PAIRS = 1 << 21


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """``(word, n)``: runs of letters, some of them with one letter less, and how often they stand.

    A run is a maximal ``[A-Za-z\\u00C0-\\u00FF]+``, A to Z lower-cased. Where the CRC-32 of
    ``key:run`` is divisible by 199 the letter at that number modulo the length is left out.
    Null texts have no runs, a null key is written as nothing, repeated rows count each; tasks add
    up their own words before anything is shuffled.
    """
    # A longer run cannot begin inside of this match, so every match is a whole run.
    runs = F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    name = F.coalesce(quoted(key).cast("string"), F.lit(""))
    hashed = docs.select(name.alias("key"), F.explode(runs).alias("run")).select(
        "run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h")
    )
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def group_counts(word: Column) -> Column:
    """How many letters of each group a word has, one number for each level of the trie."""
    rest = F.length(F.translate(word, "".join(GROUPS), ""))
    each = [F.length(word) - F.length(F.translate(word, g, "")) for g in GROUPS]
    return F.array(*[c.cast("int") for c in [*each, rest]])


def _depth(classes: DataFrame, max_words: int) -> int:
    """The least number of levels that leaves no subtree with more than ``max_words`` words."""
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    each = classes.select("vec", "words", level).groupBy("level", F.slice("vec", F.lit(1), F.col("level")).alias("top")).agg(
        F.sum("words").alias("words")
    )
    most = {r["level"]: r["most"] for r in each.groupBy("level").agg(F.max("words").alias("most")).collect()}
    return next((t for t in range(LEVELS + 1) if most.get(t, 0) <= max_words), LEVELS)


def _moves(depth: int) -> list[list[int]]:
    """What one surplus and one deficit can change in the counts of the first levels."""
    moves = [[0] * depth]
    for up, down in itertools.product([None, *range(depth)], repeat=2):
        if up != down:
            move = [0] * depth
            if up is not None:
                move[up] = 1
            if down is not None:
                move[down] = -1
            moves.append(move)
    return moves


def _reached(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` once for every subtree ``of`` that their vector can reach within the budget."""
    moves = F.lit(_moves(depth)) if depth else F.array(F.array().cast("array<int>"))
    moved = rows.withColumn("move", F.explode(moves.cast("array<array<int>>")))
    target = F.zip_with(F.slice("vec", 1, depth), "move", lambda a, b: a + b)
    return moved.withColumn("target", target).where(~F.exists("target", lambda x: x < 0)).withColumn(
        "of", F.array_join(F.col("target").cast("array<string>"), ",")
    ).drop("move", "target")


class _Trie:
    """Words by successive counts: a node is its children in order of their count, a leaf a number."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.lexsort(vectors.T[::-1])
        placed = vectors[self.order]
        new = np.append(True, (placed[1:] != placed[:-1]).any(1)) if len(placed) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(placed)))
        self.leaves = placed[self.starts]
        self.root = self._node(0, len(self.leaves), 0)

    def _node(self, lo: int, hi: int, level: int) -> object:
        if level == self.leaves.shape[1]:
            return lo
        column = self.leaves[lo:hi, level]
        cuts = [*(np.flatnonzero(np.append(True, column[1:] != column[:-1])) + lo).tolist(), hi] if hi > lo else []
        return [
            (int(self.leaves[a, level]), self._node(a, b, level + 1)) for a, b in zip(cuts, cuts[1:], strict=False)
        ]


def _leaf_pairs(asked: object, stored: object, levels: int) -> list[tuple[int, int]]:
    """Pairs of leaves within a surplus of one and a deficit of one, by depth-first search.

    Both tries are descended together, so queries with the same counts share their way.
    """
    found = []

    def search(a: object, b: object, left: int, surplus: int, deficit: int) -> None:
        if not left:
            found.append((a, b))
            return
        for have, below in a:
            for want, under in b:
                step = want - have
                if step > 1:
                    break
                if step == 0:
                    search(below, under, left - 1, surplus, deficit)
                elif step == 1 and surplus:
                    search(below, under, left - 1, 0, deficit)
                elif step == -1 and deficit:
                    search(below, under, left - 1, surplus, 0)

    search(asked, stored, levels, 1, 1)
    return found


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _halves(words: list[str], shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first half and the rest as seen by a word of ``shorter`` letters less."""
    heads, tails = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        n = len(w) - shorter
        heads[i], tails[i] = hash(w[: n // 2]), hash(w[len(w) - (n - n // 2):])
    return heads, tails


class _Words:
    """Words with the hashes that tell which pairs may be one edit apart: either half stays whole."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.same, self.longer = _halves(words, 0), _halves(words, 1)


def _may_be_near(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    gap = a.length[i] - b.length[j]
    out = np.zeros(len(i), bool)
    for step, mine, theirs in ((0, a.same, b.same), (1, a.longer, b.same), (-1, a.same, b.longer)):
        at = np.flatnonzero(gap == step)
        x, y = i[at], j[at]
        out[at] = (mine[0][x] == theirs[0][y]) | (mine[1][x] == theirs[1][y])
    return out


def near_words(asked: list[str], asked_vec: np.ndarray, stored: list[str], stored_vec: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked word the number of stored ones an edit apart, and the least rank among them."""
    count, best = np.zeros(len(asked), np.int64), np.full(len(asked), np.iinfo(np.int64).max)
    if not len(asked) or not len(stored):
        return count, best
    ask, keep = _Trie(asked_vec), _Trie(stored_vec)
    pairs = np.array(_leaf_pairs(ask.root, keep.root, asked_vec.shape[1]), np.int64).reshape(-1, 2)
    left, right = _Words(asked), _Words(stored)
    sizes = ask.sizes[pairs[:, 0]] * keep.sizes[pairs[:, 1]]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, _PAIRS):  # the word pairs of all leaf pairs, numbered through
        number = np.arange(lo, min(lo + _PAIRS, total))
        which = np.searchsorted(ends, number, side="right")
        inner = number - (ends[which] - sizes[which])
        u, v = pairs[which, 0], pairs[which, 1]
        i = ask.order[ask.starts[u] + inner // keep.sizes[v]]
        j = keep.order[keep.starts[v] + inner % keep.sizes[v]]
        likely = np.flatnonzero(_may_be_near(left, i, right, j))
        for x, y in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
            if one_edit(asked[x], stored[y]):
                count[x] += 1
                best[x] = min(best[x], rank[y])
    return count, best


def _search(batch: pa.Table) -> pa.Table:
    """The near words of the queries of one task among the stored words it got."""
    stored = batch.filter(batch.column("stored"))
    asked = batch.filter(pc.invert(batch.column("stored")))

    def vectors(part: pa.Table) -> np.ndarray:
        flat = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, LEVELS).astype(np.int64)

    words, n = stored.column("word").to_pylist(), stored.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    questions = asked.column("word").to_pylist()
    count, best = near_words(questions, vectors(asked), words, vectors(stored), rank)
    hit = np.flatnonzero(count).tolist()
    chosen = [order[best[i]] for i in hit]
    return pa.table({
        "word": pa.array([questions[i] for i in hit], pa.string()),
        "n_near": pa.array([int(count[i]) for i in hit], pa.int64()),
        "form": pa.array([words[i] for i in chosen], pa.string()),
        "form_n": pa.array([n[i] for i in chosen], pa.int64()),
    })


def near_forms(words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``(word, n_near, form, form_n)`` for each of the distinct ``words (word, n)`` with a near word.

    ``form`` is the near word of the largest ``n``, of equals the least in code-point order. The
    trie is cut below as many levels as leave no subtree with more than ``max_words`` words, and
    a word is put as a query to the subtrees within its budget. Larger subtrees, as equal
    counts on all levels can leave, are dealt into blocks, and so are the queries: every
    query of a subtree meets every block once.
    """
    placed = written(words.select("word", "n", group_counts(F.col("word")).alias("vec")), "spelling-words")
    classes = placed.groupBy("vec").agg(F.count(F.lit(1)).alias("words"))
    depth = _depth(classes, max_words)
    top = F.array_join(F.slice("vec", 1, depth).cast("array<string>"), ",")
    trees = placed.groupBy(F.slice("vec", 1, depth).alias("vec")).agg(F.count(F.lit(1)).alias("words"))
    asked = _reached(trees, depth).groupBy("of").agg(F.sum("words").alias("queries"))
    sizes = written(
        trees.select(top.alias("tree"), "words").join(asked, F.col("tree") == F.col("of")).select(
            "tree", F.ceil(F.col("words") / max_words).cast("int").alias("blocks"),
            F.ceil(F.col("queries") / (4 * max_words)).cast("int").alias("shares"),
        ), "spelling-trees",
    )
    drawn = F.xxhash64("word")
    stored = placed.withColumn("of", top).join(sizes, F.col("of") == F.col("tree")).select(
        "tree", F.pmod(drawn, F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "word", "n", "vec", F.lit(True).alias("stored"),
    )
    queries = _reached(placed, depth).join(sizes, F.col("of") == F.col("tree")).select(
        "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(drawn, F.col("shares")).cast("int").alias("share"), "word", "n", "vec", F.lit(False).alias("stored"),
    )
    found = stored.unionByName(queries).groupBy("tree", "block", "share").applyInArrow(
        _search, "word string, n_near long, form string, form_n long"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", "best.form", (-F.col("best.least")).alias("form_n")
    )


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO, max_words: int = MAX_WORDS) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of ``words (word, n)``.

    Words must be distinct and not null. Two are near if one inserted, deleted or replaced code
    point makes one the other. ``form`` is null unless it has ``ratio`` times the word's ``n``;
    ``root`` is the end of the chain of forms, the word itself without one. No word gives no rows.
    """
    words = written(words.select("word", "n"), "spelling-counts")
    near = near_forms(words, max_words).withColumnRenamed("word", "of")
    often = F.col("form_n") >= F.col("n") * ratio
    joined = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n"),
    )
    settled = written(joined, "spelling-forms")
    steps = settled.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # Every form is at least ``ratio`` times as frequent, which bounds the chains; each round doubles the steps.
    most = settled.agg(F.max("n")).first()[0] or 1
    longest = 0
    while ratio ** (longest + 1) <= most:
        longest += 1
    reach = 1
    while reach < longest:
        onward = steps.select(F.col("word").alias("via"), F.col("root").alias("end"))
        steps = written(
            steps.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root")),
            "spelling-roots",
        )
        reach *= 2
    ends = steps.select(F.col("word").alias("via"), F.col("root").alias("end"))
    return settled.join(ends, F.col("word") == F.col("via"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root")
    )


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    """Every frequent word of ``documents`` with its form and root."""
    counts = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")

