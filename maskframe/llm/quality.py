"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import SPACE_PATTERN, SPACES, fresh, let, space_words, table, text_of, without
from maskframe.llm.registry import query

SYMBOLS = "#*$%&|<>"
#: Words in a window that is looked for again in the same text; built by doubling three times.
WINDOW = 8
#: The commonest function words of the four languages that are expected.
STOP_WORDS = (
    "the of and to in a is that it with for "
    "de la le les et des en un une du que est "
    "el los las una con por "
    "der die das und ist von den ein eine mit"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when ``measure * scale`` lies below ``low`` or above ``high`` times ``per``.

    Without ``per`` the bounds are absolute. ``least_words`` exempts shorter texts.
    ``base`` marks the rules that every table of rules must keep.
    """

    name: str
    measure: str
    low: int | None = None
    high: int | None = None
    per: str | None = None
    scale: int = 1
    least_words: int = 0
    base: bool = False

    def failed(self, of: dict[str, Column]) -> Column:
        value = of[self.measure] * self.scale
        unit = of[self.per] if self.per else F.lit(1)
        tests = [F.lit(False)]
        if self.low is not None:
            tests.append(value < unit * self.low)
        if self.high is not None:
            tests.append(value > unit * self.high)
        bad = reduce(lambda a, b: a | b, tests)
        return bad & (of["n_words"] >= self.least_words) if self.least_words else bad


#: Whole numbers throughout, so that every engine gives the same verdict.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words", low=20, base=True),
    Rule("repeated_words", "n_repeat_words", high=30, per="n_words", scale=100, base=True),
    Rule("symbols_per_word", "n_symbols", high=25, per="n_words", scale=100),
    Rule("short_words", "word_chars", low=2, per="n_words"),
    Rule("long_words", "word_chars", high=15, per="n_words"),
    Rule("repeated_lines", "n_dup_lines", high=50, per="n_lines", scale=100),
    Rule("no_stop_words", "n_stop_words", low=1, least_words=100),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def measure(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with one struct column of measures and verdicts; returns the frame and its name.

    The struct holds :data:`MEASURES` (long), ``failed`` (array of rule names),
    ``base_failed`` and ``kept`` (boolean). A null or empty text has no words and fails
    ``too_few_words``. Repeated rows are judged each for itself, an empty table gives an empty
    one, and columns of ``docs`` keep their names and values whatever they are called.
    Work and memory follow the length of the single text; there is no shuffle.
    """
    (out,) = fresh(docs.columns, "quality")
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def measures(words: Column, lines: Column) -> Column:
        of = {
            "n_words": F.size(words),
            "word_chars": F.length(without(body, SPACES)),
            "n_symbols": F.length(body) - F.length(without(body, SYMBOLS)),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in of.items()])

    def verdict(m: Column) -> Column:
        of = {k: m[k] for k in MEASURES}
        return F.struct(
            *[of[k].alias(k) for k in MEASURES],
            F.array_compact(F.array(*[F.when(r.failed(of), F.lit(r.name)) for r in rules])).alias("failed"),
            reduce(lambda a, b: a | b, [r.failed(of) for r in rules if r.base], F.lit(False)).alias("base_failed"),
            (~reduce(lambda a, b: a | b, [r.failed(of) for r in rules], F.lit(False))).alias("kept"),
        )

    found = let(space_words(body), lambda w: let(lines, lambda x: let(measures(w, x), verdict)))
    return docs.withColumn(out, found), out


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of :data:`WINDOW` words that occur again in the array.

    Windows are compared by 64-bit hashes. Only arrays with a repeated window are sorted.
    """

    def doubled(runs: Column, step: int) -> Column:
        """Hash of each item with the one ``step`` later: runs of n words become runs of 2n."""
        return F.transform(runs, lambda x, i: F.xxhash64(x, F.get(runs, i + step)))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(pairs: Column) -> Column:
            same = F.filter(
                pairs,
                lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]),
            )
            return F.sort_array(F.transform(same, lambda p: p["i"]))

        def length(starts: Column) -> Column:
            step = F.transform(
                starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
            )
            return F.aggregate(step, F.lit(0), lambda total, x: total + x)

        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            let(ordered, lambda pairs: let(again(pairs), length)),
        ).otherwise(0)

    # The last hashes of the third doubling reach beyond the text and are no windows.
    hashes = let(doubled(words, 1), lambda twos: let(
        doubled(twos, 2), lambda fours: F.slice(doubled(fours, 4), F.lit(1), F.size(words) - (WINDOW - 1))
    ))
    return F.when(F.size(words) > WINDOW, let(hashes, covered)).otherwise(0)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    judged, name = measure(docs, text, rules)
    return judged.where(quoted(name)["kept"]).select(*[quoted(c) for c in docs.columns])


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
MEASURES_SQL = rf"""
q_words AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_PATTERN}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM {{docs}}),
q_starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM q_words),
q_twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + {WINDOW - 1}]) AS n FROM q_starts)
  WHERE n > 1),
q_repeats AS (
  SELECT doc_id, sum(step)::BIGINT AS n_repeat_words FROM (
    SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS step
    FROM q_twice) GROUP BY doc_id),
q_measures AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '{SPACE_PATTERN}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM q_words w LEFT JOIN q_repeats r ON w.doc_id = r.doc_id),
q_verdicts AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 25 * n_words
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines
         OR (n_words >= 100 AND n_stop_words < 1)) AS kept
  FROM q_measures)"""

OP3_SQL = f"""WITH {MEASURES_SQL.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
  n_lines, n_stop_words FROM q_verdicts"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark, sf_dir):
    """Measures and verdict of every document."""
    judged, name = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
              "n_lines", "n_stop_words")
    return judged.select("doc_id", *[F.col(name)[f].alias(f) for f in fields])
