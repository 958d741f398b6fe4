"""Quality rules: text statistics as Spark expressions and a learned decision list over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a Java pattern and as one for its complement.
_GAPS, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: The characters that count as symbols, and the words in a window.
SYMBOLS, WINDOW = r"[#*$%&|<>]", 5
#: Statistics that rules may test; all are defined (0 for a text without words).
FEATURES = ("n_words", "mean_word_chars", "longest_word", "symbols_per_word", "dup_line_share", "repeat_word_share", "distinct_word_share", "upper_share", "digit_share", "exclaim_per_word")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and ``FEATURES``), one for each row.

    carry: the row itself goes along as the struct ``row``. Null texts count as empty. Everything is a row's own expression, without a shuffle.
    Windows are found by hashes of their words' hashes: sorted with their places, equal
    neighbours are repeats; the words they cover are summed from the gaps between places.
    Each step's array is a column of its own, so that no lambda computes it again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *row)
    row = ["row"] if carry else []
    x = x.select(
        "doc_id", "text", *row,
        F.filter(F.split("text", _GAPS, -1), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda s: s.rlike(_WORD)).alias("lines"),
    )
    x = x.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    wide = F.size("hashes") >= WINDOW
    window = F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    x = x.withColumn("windows", F.when(wide, window).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    x = x.withColumn("placed", F.when(some, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda v, i: F.coalesce(F.get("placed", i)["h"] == v["h"], F.lit(False))
    repeats = F.filter("placed", lambda v, i: same(v, i - 1) | same(v, i + 1))
    x = x.withColumn("starts", F.sort_array(F.transform(repeats, lambda v: v["i"])))
    covered = F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW))))
    x = x.select(
        "doc_id", *row,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda s, v: s + v).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
        F.coalesce(F.aggregate("words", F.lit(0), lambda m, w: F.greatest(m, F.length(w))), F.lit(0)).alias("longest"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit("!")).alias("n_exclaims"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return x.select(
        "doc_id", *row, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_chars"),
        F.col("longest").cast("double").alias("longest_word"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("n_distinct", "n_words").alias("distinct_word_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_exclaims", "n_words").alias("exclaim_per_word"),
    )


@dataclass(frozen=True)
class Threshold:
    """One threshold: feature <= cut, or feature > cut."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.cut if self.above else x <= self.cut

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Threshold, ...]


def learn_rules(rows: list[dict], label: str = "quality", max_tests: int = 4, max_rules: int = 16, cuts: int = 48, least_precision: float = 0.97, least_support: int = 3) -> list[Rule]:
    """An ordered list of conjunctions that reject (label 0), by sequential covering.

    Two rows of three, by turns in doc_id order, grow a rule test by test for the highest
    information gain until it covers no good row; the third row prunes it, dropping last
    tests while that raises (bad - good) / (bad + good). A rule stays if it is right for
    ``least_precision`` of the rows it covers in both parts, and ``least_support`` of the
    bad rows not covered before; its rows then go. Sets of rows are bits of an integer.
    No labelled or no bad row gives an empty list.
    """
    from math import log2

    rows = sorted((r for r in rows if r[label] in (0, 1)), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, [r[f] for f in FEATURES]))
    bits = lambda keep: sum(1 << i for i, r in enumerate(rows) if keep(i, r))
    bad, prune = bits(lambda i, r: r[label] == 0), bits(lambda i, r: i % 3 == 2)
    everything = (1 << len(rows)) - 1
    masks: dict[Threshold, int] = {}
    for f in FEATURES:
        values = sorted({float(r[f]) for r in rows})
        middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
        for cut in middles if len(middles) <= cuts else {middles[int(k * len(middles) / cuts)] for k in range(cuts)}:
            below = bits(lambda i, r, f=f, cut=cut: r[f] <= cut)
            masks[Threshold(f, False, cut)], masks[Threshold(f, True, cut)] = below, everything & ~below
    order = sorted(masks, key=lambda t: (t.feature, t.above, t.cut))
    count = lambda m: ((m & bad).bit_count(), (m & ~bad & everything).bit_count())

    found: list[Rule] = []
    left = everything
    while len(found) < max_rules:
        rule: list[Threshold] = []
        at = left & ~prune
        while len(rule) < max_tests:
            p0, n0 = count(at)
            if not p0 or not n0:
                break
            base = log2(p0 / (p0 + n0))
            best, gain = None, 1e-9
            for t in order:
                p, n = count(at & masks[t])
                if p and (g := p * (log2(p / (p + n)) - base)) > gain:
                    best, gain = t, g
            if best is None:
                break
            rule.append(best)
            at &= masks[best]
        if not rule:
            break

        def cover(tests, among):
            for t in tests:
                among &= masks[t]
            return among

        def worth(tests):
            p, n = count(cover(tests, left & prune))
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule.pop()
        p, n = count(cover(rule, left))
        p2, n2 = count(cover(rule, left & prune))
        if p < least_support or p < least_precision * (p + n) or p2 < least_precision * (p2 + n2):
            break
        found.append(tuple(rule))
        left &= ~cover(rule, left)
    return found


def keeps(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the first rule that holds rejects, else the row is kept."""
    verdict = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        verdict = F.when(test, F.lit(False)) if verdict is None else verdict.when(test, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000) -> list[dict]:
    """Statistics and labels of at most ``sample`` labelled rows, those with the smallest hashed doc_id.

    The bound holds for the labels that are broadcast and, after the join, for the rows
    that reach the driver, however often an id repeats. Null ids and labels are left out.
    """
    marks = labels.where(f"doc_id is not null and {label} in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = statistics(texts).join(F.broadcast(marks), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample)
    return [r.asDict() for r in rows.collect()]


def judged(docs: DataFrame, rules: list[Rule], carry: bool = False) -> DataFrame:
    """``statistics`` with base_failed and kept (false if base_failed, else the list's verdict)."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs, carry=carry).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & keeps(rules))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are.

    The row number keeps the optimizer from pushing the filter below the statistics,
    which would write out each of their steps again for every use of it.
    """
    marked = judged(docs, rules, carry=True).withColumn("number", F.monotonically_increasing_id())
    return marked.where("kept and number >= 0").select("row.*")
