"""Quality rules as a learned decision list, in Spark expressions only.

Statistics of whole texts are plain column expressions. From labelled rows a
list of rules is learned by sequential covering: a rule is a conjunction of
thresholds, grown condition by condition on two thirds of the rows, pruned from its end on the other third, and kept while it is
precise there; rows it covers are taken out and the next rule is learned. The
list becomes one ordered Spark conditional expression.

Only the fit sees a sample: ``MAX_LABELLED`` labelled rows, those with the
smallest hash of their id. Statistics and verdicts cover every row.

Nulls, ties and edge cases: a null text counts as one without words; a null
label is no label; ids that are null or repeated keep their rows; with no
labelled rows, or one kind of label only, the list is empty and the base
rules decide alone; an empty table gives no rows; other columns pass through
``filter_quality`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit reads at most.
MAX_LABELLED = 12_000
#: Rules and conditions of a rule at most; precision a kept rule must have.
MAX_RULES, MAX_CONDITIONS, PRECISION = 12, 4, 0.99

_SPACE = r"[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words under 3-word windows that start at these places."""
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def repeated_words(w: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``w``. Windows are
    compared by 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def twice(s: Column) -> Column:  # s is sorted
        pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a == b, a))
        return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))

    def few(h: Column, again: Column) -> Column:  # a short list of repeated windows: look each window up in it
        return _covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull()))

    def many(h: Column) -> Column:  # else sort the windows with their places, and take those beside an equal one
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda p: _covered(F.sort_array(F.filter(F.transform(p, lambda x, j: F.when(
            (x["h"] == F.get(p, j + 1)["h"]) | (x["h"] == F.get(p, j - 1)["h"]), x["i"])), lambda i: i.isNotNull()))))

    counted = let(hashes, lambda h: let(twice(F.sort_array(h)), lambda again: F.when(F.size(again) == 0, 0).when(F.size(again) <= 24, few(h, again)).otherwise(many(h))))
    return F.when(n < 3, 0).otherwise(counted)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_q`` of text statistics: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and n_lines,
    n_distinct, n_upper, n_digits, n_marks for the rules."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gone = lambda t, chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def stats(t: Column) -> Column:
        return let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), lambda w: let(F.size(w), lambda n: let(lines(t), lambda ls: F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            gone(t, r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w, n).cast("long").alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            gone(t, "[A-Z]+").cast("long").alias("n_upper"),
            gone(t, "[0-9]+").cast("long").alias("n_digits"),
            gone(t, "[!?]+").cast("long").alias("n_marks")))))

    return docs.withColumn("_q", let(text, stats))


def features(q: str = "_q") -> dict[str, Column]:
    """What rules may test, by name; a share of nothing is 0."""
    f = lambda name: F.col(f"{q}.{name}")
    share = lambda a, b: F.coalesce(F.try_divide(f(a), f(b)), F.lit(0.0))
    return {
        "words": f("n_words").cast("double"), "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"), "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"), "distinct_words": share("n_distinct", "n_words"),
        "upper_case": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"),
        "marks": share("n_marks", "n_words"),
    }


Condition = tuple[str, str, float]  # feature, "<=" or ">=", threshold


def _holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] >= t for f, op, t in rule)


def _best_condition(rows: list[dict], names: list[str], precision: float) -> Condition | None:
    """Of the thresholds that leave bad rows with ``precision``, the one that
    leaves most; without any, the one with the largest FOIL gain. Ties go to
    the earlier feature, then to the lower threshold."""
    p0, n0 = sum(r["bad"] for r in rows), len(rows)
    pure, best, base = (0, None), (1e-9, None), math.log2(p0 / n0) if p0 else 0.0
    for name in names:
        values = sorted((r[name], r["bad"]) for r in rows)
        p = n = 0
        for i in range(n0 - 1):
            p, n = p + values[i][1], n + 1
            a, b = values[i][0], values[i + 1][0]
            if a == b:
                continue
            for op, q, m in (("<=", p, n), (">=", p0 - p, n0 - n)):
                if q >= precision * m and q > pure[0]:
                    pure = (q, (name, op, (a + b) / 2))
                elif q and (gain := q * (math.log2(q / m) - base)) > best[0] + 1e-9:
                    best = (gain, (name, op, (a + b) / 2))
    return pure[1] or best[1]


def learn(rows: list[dict], names: list[str], max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
          precision: float = PRECISION) -> list[list[Condition]]:
    """Ordered rules for ``bad`` rows (each row: features and ``bad`` 0 or 1;
    every third row, in the given order, prunes). A rule must be as precise
    on the rows that prune, and cover some."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        rule, inside = [], grow
        while len(rule) < max_conditions and sum(r["bad"] for r in inside) < precision * len(inside):
            found = _best_condition(inside, names, precision)
            if found is None:
                break
            rule.append(found)
            inside = [r for r in inside if _holds(r, rule[-1:])]
        if not rule:
            break

        def worth(k: int) -> tuple[float, int]:
            got = [r["bad"] for r in prune if _holds(r, rule[:k])]
            return ((2 * sum(got) - len(got)) / len(got) if got else -1.0, -k)

        rule = rule[:max(range(1, len(rule) + 1), key=worth)]
        tested = [r["bad"] for r in prune if _holds(r, rule)]
        if not tested or sum(tested) < precision * len(tested):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _holds(r, rule)] for part in (grow, prune))
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """Rules that reject, learned from ``labels`` (id and 0 or 1)."""
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = (labelled.select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).cast("int").alias("bad"))
              .orderBy(F.xxhash64("_id"), "_id", "bad").limit(max_labelled))
    named = features()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    got = (with_statistics(texts.join(F.broadcast(sample), "_id"))  # max_labelled rows of two numbers
           .select("_id", "bad", *[c.alias(n) for n, c in named.items()])
           .orderBy(F.xxhash64("_id"), "_id", "bad", *named).limit(max_labelled).collect())
    return learn([r.asDict() for r in got], list(named))


def rejected(rules: list[list[Condition]], q: str = "_q") -> Column:
    """The list as one conditional expression: the number (from 1) of the
    first rule that holds, else null."""
    named, out = features(q), None
    for i, rule in enumerate(rules):
        holds = F.lit(True)
        for f, op, t in rule:
            holds = holds & (named[f] <= F.lit(t) if op == "<=" else named[f] >= F.lit(t))
        out = F.when(holds, i + 1) if out is None else out.when(holds, i + 1)
    return out if out is not None else F.lit(None).cast("int")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Per row: row (all columns of ``docs`` as one struct, so that no name
    can clash), _q (statistics), _base_failed, _rule (number of the rejecting
    rule or null) and _kept."""
    rules = fit_rules(docs, labels, text_col=text_col, **options)
    out = with_statistics(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))).drop("text")
    return out.withColumns({"_base_failed": base_failed(), "_rule": rejected(rules)}).withColumn(
        "_kept", ~F.col("_base_failed") & F.col("_rule").isNull())


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    return judge_quality(docs, labels, **options).where("_kept").select("row.*")
