"""Quality rules: text statistics and a learned decision list, in DataFrame and SQL functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .base import stored

BLANK = " \t\n\x0b\f\r"
#: Labelled rows that are learned from, at most; thresholds tried for a statistic.
SAMPLE, THRESHOLDS = 50_000, 40
RULES, CONDITIONS = 12, 3
#: A rule needs this precision on the rows held for pruning, and must cover so many of the rejected in either part.
PRECISION, COVER = 0.99, 5
STATISTICS = ["n_words", "word_mean", "symbol_share", "upper_share", "dup_line_share", "repeat_share", "mark_share", "digit_share"]


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeat_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that the text has twice or more.

    Windows are compared by 64-bit hashes. Sorting is by (hash, place), so equal windows are neighbours,
    and the work is n log n however often a window repeats.
    """
    none = F.lit(0)

    def covered(prints: Column) -> Column:
        pairs = F.sort_array(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            n = F.size(p)
            twice = F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(p, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def count(at: Column) -> Column:
            gap = F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))))
            return F.aggregate(gap, none, lambda a, g: a + g)

        return bound(bound(pairs, places), count)

    def several(ws: Column) -> Column:
        own = F.transform(ws, lambda w: F.xxhash64(w))  # a word is hashed once, not once for each of its windows
        runs = bound(own, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(width)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))
        return bound(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))

    return F.when(F.size(words) < width, none).otherwise(several(words))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_digits) of whole texts.

    Null has no words, lines or characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    dup = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    words = bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    # most characters are small letters: a pass drops them, and the counts are of what is left
    small = bound(F.translate(text, "abcdefghijklmnopqrstuvwxyz", ""), lambda r: F.struct((F.length(text) - F.length(r)).alias("n"), F.translate(r, BLANK, "").alias("rest")))

    def counts(x: Column) -> Column:
        of = lambda chars: (F.length(x["rest"]) - F.length(F.translate(x["rest"], chars, ""))).cast("long")
        chars = (x["n"] + F.length(x["rest"])).cast("long")
        return F.struct(chars.alias("word_chars"), of("#*$%&|<>").alias("n_symbols"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), of("!?.,;:").alias("n_marks"), of("0123456789").alias("n_digits"))

    made = docs.select("doc_id", words.alias("_w"), bound(small, counts).alias("_c"), dup.cast("long").alias("n_dup_lines"))
    return made.select("doc_id", "_w.n_words", "_c.word_chars", "_c.n_symbols", "n_dup_lines", "_w.n_repeat_words", "_c.n_upper", "_c.n_marks", "_c.n_digits")


def shares(stats: DataFrame) -> dict[str, Column]:
    """The statistics that conditions are on."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_mean": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("n_upper") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "mark_share": F.col("n_marks") / chars,
        "digit_share": F.col("n_digits") / chars,
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def on(self, columns: dict[str, Column]) -> Column:
        c = columns[self.statistic]
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def all_of(rule: list[Condition], columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.on(columns)
    return out


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]).cast("array<double>"), lambda t: t <= value))


def _tallies(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each statistic, how many rejected and other rows lie in each bin between thresholds: one small aggregate."""
    cells = [F.struct(F.lit(s).alias("s"), _bin(F.col(s), cuts[s]).alias("bin")) for s in STATISTICS]
    out = {s: [(0, 0)] * (len(cuts[s]) + 1) for s in STATISTICS}
    for s, b, p, n in rows.select("reject", F.explode(F.array(*cells)).alias("x")).groupBy("x.s", "x.bin").agg(F.sum("reject"), F.sum(1 - F.col("reject"))).collect():
        out[s][b] = (p, n)
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    """Add the condition with the best gain in information until only rejected rows are covered."""
    import math

    rule: list[Condition] = []
    columns = {s: F.col(s) for s in STATISTICS}
    while len(rule) < CONDITIONS:
        bins = _tallies(rows.where(all_of(rule, columns)), cuts)
        p0, n0 = (sum(x[i] for x in bins["n_words"]) for i in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for s, cells in bins.items():
            for k in range(1, len(cells)):
                below = [sum(c[i] for c in cells[:k]) for i in (0, 1)]
                for at_least, (p, n) in ((True, (p0 - below[0], n0 - below[1])), (False, below)):
                    if p >= COVER and (p, n) != (p0, n0):
                        g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(s, at_least, cuts[s][k - 1]), g
        if not best:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The beginning of the rule that is worth most on the pruning rows: (p - n) / (p + n); shorter wins ties."""
    columns = {s: F.col(s) for s in STATISTICS}
    parts = [rule[: k + 1] for k in range(len(rule))]
    sums = [F.coalesce(F.sum(F.when(all_of(r, columns), x).otherwise(0)), F.lit(0)) for r in parts for x in (F.col("reject"), 1 - F.col("reject"))]
    row = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
    best = max(range(len(parts)), key=lambda k: ((row[2 * k] - row[2 * k + 1]) / max(1, row[2 * k] + row[2 * k + 1]), -k))
    return parts[best], row[2 * best], row[2 * best + 1]


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[list[Condition]]:
    """Rules that reject, in order, by sequential covering on at most ``SAMPLE`` labelled training rows.

    Two thirds of the rows grow a rule, the rest prunes it; a rule that is too imprecise ends the list.
    Of several labels of a document the least counts; null labels and ids teach nothing.
    """
    from .langid import training_fold

    known = labels.where(training_fold() & F.col(label).isNotNull()).groupBy("doc_id").agg((1 - F.min(label)).cast("int").alias("reject"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = stats.join(known, "doc_id").select("doc_id", "reject", *[c.alias(s) for s, c in shares(stats).items()])
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3))), "rules-sample")
    at = [(k + 0.5) / THRESHOLDS for k in range(THRESHOLDS)]
    quantiles = rows.where("reject = 1").agg(*[F.percentile_approx(s, at, 10_000).alias(s) for s in STATISTICS]).first()
    others = rows.where("reject = 0").agg(*[F.percentile_approx(s, at, 10_000).alias(s) for s in STATISTICS]).first()
    cuts = {s: sorted({float(x) for q in (quantiles, others) for x in (q[s] or [])}) for s in STATISTICS}
    found: list[list[Condition]] = []
    left, columns = rows, {s: F.col(s) for s in STATISTICS}
    while len(found) < RULES:
        rule = _grow(left.where("part > 0"), cuts)
        if not rule:
            break
        rule, p, n = _prune(left.where("part = 0"), rule)
        if p < COVER or p < PRECISION * (p + n):
            break
        found.append(rule)
        left = left.where(~all_of(rule, columns))
    return found


def decision_list(rules: list[list[Condition]], columns: dict[str, Column]) -> Column:
    """The ordered conditional: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(all_of(rule, columns), F.lit(False)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    base_failed: fewer than 10 words, or over a fifth of them in repeated five-word windows. kept: not
    base_failed and not rejected by the learned list; rule is the list as text, the same in all rows.

    A null or empty text fails the base. Without labels the list is empty and the base alone decides.
    Repeated rows get equal values; a null doc_id is only not learned from. Extra columns are not read.
    """
    stats = stored(statistics(docs), "rules-statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = learn(stats.where(~failed), labels)  # for what the base leaves to decide
    said = "; ".join(" and ".join(map(str, r)) for r in rules)
    verdict = decision_list(rules, shares(stats))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"), F.lit(said).alias("rule"))
