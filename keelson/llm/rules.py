"""Quality rules: a decision list learned by sequential covering, applied as Spark expressions.

A whole text is reduced to integer statistics (:func:`measure`), by DataFrame functions alone. From
labelled statistics :func:`learn` covers the wanted label rule after rule:

1. grow: starting from a rule that covers everything left, add the threshold condition with the
   highest information gain (FOIL's), until the rule covers no row of another label or no condition
   gains;
2. prune: on rows kept apart, drop last conditions as long as (right - wrong) / (right + wrong) of
   the rule does not fall; a rule that is not precise enough there ends the list;
3. remove the rows that the rule covers and go on with the rest.

Each step is one aggregation over all labelled rows, into counts by statistic and value. Values count
by their first two digits, so at most 90 levels a decade reach the driver however many rows there
are; a condition compares with such a level and so reads like ``symbols_per_1000_words >= 120``.
The list itself (:class:`DecisionList`) is one ordered ``CASE WHEN``. No Python runs in any task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import WORD, Scratch

#: Words of a window whose repeats count, and the base rules: fewest words, largest percentage of
#: words in repeated windows.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 3, 50, 50
SYMBOLS = "#*$%&|<>"
#: Bounds of a list: rules, conditions of a rule, rows of the wanted label that a rule must cover
#: while it grows, least (right - wrong) / (right + wrong) on the rows kept apart.
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_VALUE = 12, 4, 3, 0.8
#: One row in so many is kept apart for pruning.
PRUNE_SHARE = 3

#: The statistics that rules may compare, as SQL over the counts of a text.
RATES = {
    "words": "n_words",
    "chars_per_10_words": "10 * word_chars div greatest(n_words, 1)",
    "symbols_per_1000_words": "1000 * n_symbols div greatest(n_words, 1)",
    "repeat_words_per_1000": "1000 * n_repeat_words div greatest(n_words, 1)",
    "distinct_words_per_1000": "1000 * n_distinct_words div greatest(n_words, 1)",
    "dup_lines_per_1000": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "words_per_10_lines": "10 * n_words div greatest(n_lines, 1)",
    "capitals_per_1000_chars": "1000 * n_capitals div greatest(word_chars, 1)",
    "digits_per_1000_chars": "1000 * n_digits div greatest(word_chars, 1)",
    "calls_per_1000_words": "1000 * n_calls div greatest(n_words, 1)",
}

_COUNT = re.compile(r"\b(?=(n_|word_chars))")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _only(text: Column, kind: str) -> Column:
    """Number of code points of ``text`` that are in the character class ``kind``."""
    return F.char_length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def _with_neighbour(rows: Column, same) -> Column:
    """Entries of the sorted array ``rows`` that are the ``same`` as the entry before or after."""
    def near(s: Column, x: Column, j: Column) -> Column:
        at = lambda k: F.coalesce(same(F.get(s, k), x), F.lit(False))
        return at(j - 1) | at(j + 1)

    return _let(F.sort_array(rows), lambda s: F.filter(s, lambda x, j: near(s, x, j)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` consecutive words found twice or more, the first included.

    Where the hashes of all windows differ, nothing repeats. Otherwise each window becomes one
    number, its hash with its place in the low bits. Sorted, windows that share the hash bits are
    neighbours: only these can repeat. They are sorted by their words, and equal neighbours are the
    repeats, so that no hash decides. The union of their words is counted along the text.
    """
    n, none = F.size(words) - (WINDOW - 1), F.lit(0).cast("long")

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(WINDOW)]

    def count(hashes: Column, low: Column) -> Column:
        """``low`` has the bits of a place set."""
        high = lambda x: x.bitwiseOR(low)
        mixed = F.transform(hashes, lambda h, i: h.bitwiseOR(low) - low + i)
        near = F.transform(_with_neighbour(mixed, lambda x, y: high(x) == high(y)), lambda x: x.bitwiseAND(low).cast("int"))
        texts = F.transform(near, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("i")))
        hits = F.sort_array(F.transform(_with_neighbour(texts, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))
        start = F.struct(none.alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"),
                                       (i + WINDOW).alias("end"))
        return F.aggregate(hits, start, step, lambda acc: acc["n"])

    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*window(i)))
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
    return F.when(n < 2, none).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == n, none).otherwise(
        _let(bits, lambda low: count(h, low)))))


def counts(text: Column) -> Column:
    """The counts of a whole text as one struct; a null text has none of anything."""
    t = F.coalesce(text, F.lit(""))
    parts = F.struct(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"),
                     F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))

    def all_counts(p: Column) -> Column:
        words, lines = p["words"], p["lines"]
        long = lambda c: c.cast("long")
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.char_length(F.array_join(words, ""))).alias("word_chars"),
            _only(t, SYMBOLS).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            _let(words, repeated_words).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(F.array_distinct(words))).alias("n_distinct_words"),
            _only(t, r"\p{Lu}").alias("n_capitals"),
            _only(t, r"\p{Nd}").alias("n_digits"),
            _only(t, "!?").alias("n_calls"),
        )

    return _let(parts, all_counts)


def measure(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with the struct ``out``: counts, ``base_failed`` and the statistics of :data:`RATES`.

    A null or empty text has zeros everywhere and fails the base rules. All other columns stay as
    they are whatever their names, except one named ``out``, which is replaced; repeated rows and
    null ids keep one row each, and an empty table stays empty. A text of any length is one row's
    work: time grows as n log n of its words. No shuffle.
    """
    held = "`" + out.replace("`", "``") + "`"
    base = docs.withColumn(out, counts(F.col(f"`{text}`")))
    failed = f"c.n_words < {MIN_WORDS} or 100 * c.n_repeat_words > {MAX_REPEAT_PERCENT} * c.n_words"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
             "n_capitals", "n_digits", "n_calls"]
    rates = [f"'{name}', {_COUNT.sub('c.', sql)}" for name, sql in RATES.items()]
    body = ", ".join([*[f"'{c}', c.{c}" for c in names], f"'base_failed', {failed}", *rates])
    return base.withColumn(out, F.expr(f"transform(array({held}), c -> named_struct({body}))[0]"))


@dataclass(frozen=True)
class Condition:
    """``stat >= value``, or ``stat < value`` if ``below``."""

    stat: str
    below: bool
    value: int

    def sql(self, held: str) -> str:
        return f"{held}.{self.stat} {'<' if self.below else '>='} {self.value}"

    def __str__(self) -> str:
        return f"{self.stat} {'<' if self.below else '>='} {self.value}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: ``label``. ``right`` and ``wrong`` count the rows kept apart that it covers."""

    conditions: tuple[Condition, ...]
    label: int
    right: int
    wrong: int

    def sql(self, held: str) -> str:
        return " and ".join(c.sql(held) for c in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules: the first that holds decides, ``default`` where none does."""

    rules: tuple[Rule, ...] = ()
    default: int = 1
    steps: int = field(default=0, compare=False)

    def label(self, stats: str = "stats") -> Column:
        """The decided label as one conditional expression over the struct ``stats``."""
        held = "`" + stats.replace("`", "``") + "`"
        if not self.rules:
            return F.lit(self.default)
        chain = F
        for rule in self.rules:
            chain = chain.when(F.expr(rule.sql(held)), F.lit(rule.label))
        return chain.otherwise(F.lit(self.default))

    def __str__(self) -> str:
        lines = [f"{' and '.join(map(str, r.conditions))} -> {r.label}  ({r.right} right, {r.wrong} wrong)" for r in self.rules]
        return "\n".join([*lines, f"else -> {self.default}"])


def _level(value: str) -> str:
    """SQL: a non-negative whole number cut to its first two digits."""
    power = f"cast(rpad('1', greatest(length(cast({value} as string)) - 1, 1), '0') as bigint)"
    return f"{value} - {value} % {power}"


def _gain(right: int, wrong: int, all_right: int, all_wrong: int) -> float:
    return right * (log2(right / (right + wrong)) - log2(all_right / (all_right + all_wrong)))


def _best(table, target: int, all_right: int, all_wrong: int) -> tuple[float, Condition, int, int] | None:
    """The condition of highest gain from rows (stat, level, label, n); equal gains go by name and value."""
    found: dict[str, dict[int, list[int]]] = {}
    for r in table:
        found.setdefault(r["stat"], {}).setdefault(r["level"], [0, 0])[r["label"] != target] += r["n"]
    best = None
    for stat in sorted(found):
        right = wrong = 0
        for level in sorted(found[stat]):
            # below: what lies under this level; not below: the rest
            for below, p, n in ((True, right, wrong), (False, all_right - right, all_wrong - wrong)):
                if p >= MIN_COVER and (p, n) != (all_right, all_wrong):
                    gain = _gain(p, n, all_right, all_wrong)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, Condition(stat, below, level), p, n)
            right += found[stat][level][0]
            wrong += found[stat][level][1]
    return best


def learn(measured: DataFrame, label: str = "label", stats: str = "stats", target: int = 0, default: int = 1,
          order: str = "doc_id") -> DecisionList:
    """A decision list for ``target`` against all other labels, from rows that pass the base rules.

    ``measured`` comes from :func:`measure` and carries ``label``; rows without one are not used. The
    rows kept apart for pruning follow from a hash of ``order``, so reruns agree. Null and repeated
    ids count as they come. With no labelled rows, or none of ``target``, the list is empty and gives
    ``default`` for all. At most ``MAX_RULES * (MAX_CONDITIONS + 1)`` aggregations run, each over one
    staged table of whole numbers.
    """
    held = "`" + stats.replace("`", "``") + "`"
    scratch = Scratch(measured.sparkSession, "rules")
    names = list(RATES)
    # repeats of a row are one row with a count, so that a hot group is one row from here on
    rows = scratch.stage(
        measured.where(F.col(label).isNotNull() & ~F.expr(f"{held}.base_failed"))
        .select(F.expr(f"cast(`{label}` as int)").alias("label"), (F.pmod(F.xxhash64(order), F.lit(PRUNE_SHARE)) == 0).alias("apart"),
                *[F.expr(_level(f"{held}.{n}")).alias(n) for n in names])
        .groupBy("label", "apart", *names).agg(F.count("*").alias("n")))
    rows = rows.select("*", F.struct(*names).alias("s"))
    rules, left, steps = [], F.lit(True), 0
    while len(rules) < MAX_RULES:
        growing = rows.where(left & ~F.col("apart"))
        conditions: list[Condition] = []
        while len(conditions) < MAX_CONDITIONS:
            covered = growing.where(" and ".join(c.sql("s") for c in conditions)) if conditions else growing
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("level")) for n in names]))
            table = (covered.select("label", "n", pairs.alias("p")).groupBy("p.stat", "p.level", "label")
                     .agg(F.sum("n").alias("n")).collect())
            steps += 1
            one = [r for r in table if r["stat"] == names[0]]
            all_right = sum(r["n"] for r in one if r["label"] == target)
            all_wrong = sum(r["n"] for r in one if r["label"] != target)
            if all_right < MIN_COVER or not all_wrong:
                break
            best = _best(table, target, all_right, all_wrong)
            if best is None:
                break
            conditions.append(best[1])
        if not conditions:
            break
        # every shorter form of the rule in one pass over the rows kept apart
        forms = [" and ".join(c.sql("s") for c in conditions[:k]) for k in range(1, len(conditions) + 1)]
        held_out = rows.where(left & F.col("apart")).select(
            *[F.sum(F.expr(f"if({f} and label {is_} {target}, n, 0)")).alias(f"{name}{k}")
              for k, f in enumerate(forms) for name, is_ in (("r", "="), ("w", "<>"))]).first()
        steps += 1
        scored = []
        for k in range(len(forms)):
            right, wrong = held_out[f"r{k}"] or 0, held_out[f"w{k}"] or 0
            scored.append(((right - wrong) / (right + wrong) if right + wrong else -1.0, -k, right, wrong))
        value, k, right, wrong = max(scored)
        if value < MIN_VALUE:
            break
        rule = Rule(tuple(conditions[:1 - k]), target, right, wrong)
        rules.append(rule)
        left = left & ~F.expr(rule.sql("s"))
    scratch.clear()
    return DecisionList(tuple(rules), default, steps)


def label_rows(measured: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", out: str = "label") -> DataFrame:
    """``measured`` with the label of its id, where it has one. An id that repeats in ``labels`` has its least label."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(doc_id)).agg(F.min(label).alias(out))
    return measured.join(known, doc_id)


def judge(measured: DataFrame, chosen: DecisionList, stats: str = "stats", out: str = "kept") -> DataFrame:
    """``measured`` with the boolean ``out``: false if the base rules fail, else whether the list says 1."""
    held = "`" + stats.replace("`", "``") + "`"
    return measured.withColumn(out, ~F.expr(f"{held}.base_failed") & (chosen.label(stats) == 1))
