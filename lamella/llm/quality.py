"""Quality rules: a learned decision list, native throughout.

Statistics of whole texts are DataFrame expressions. The list is learned from labelled
documents by sequential covering: a rule, a conjunction of thresholds, is grown on one part
of the labelled rows by FOIL's gain, pruned from its end on the other, and kept while it is
precise there; what it covers is set aside and the next rule begins. Every step is one
Spark aggregate over binned statistics, whose histogram (statistics x bins) is all that the
driver sees. The list is emitted as an ordered CASE expression.

Word stems that mark toxic documents are learned from the same rows and enter as one statistic.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.bind import bind
from lamella.llm.rows import hold

SPACE = r"[ \t-\r]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["length", "mean_word", "symbols", "repeats", "dup_lines", "upper", "exclaims", "bars", "digits", "variety", "marked"]


MARKS = [1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0]  # thresholds on ``marked``


@dataclass(frozen=True)
class Covering:
    """How the list is learned.

    ``sample`` bounds the labelled documents, taken by hash of their id; a rule has ``precision`` on the part
    that prunes. A marked stem is in at least ``least`` toxic texts, whatever their share, and
    ``purity`` of its texts are toxic, where ``weight`` texts of the usual mixture are added to
    them. It goes on letter by letter as long as the longer one has ``share`` of its toxic texts.
    """

    sample: int = 10_000
    rules: int = 8
    conditions: int = 3
    precision: float = 0.95
    least: int = 4
    purity: float = 0.7
    weight: float = 2.0
    share: float = 0.9


DEFAULT = Covering()


@dataclass(frozen=True)
class Condition:
    """``measure`` at least (or below) ``value``."""

    measure: str
    at_least: bool
    value: float

    def column(self) -> Column:
        return F.col(self.measure) >= self.value if self.at_least else F.col(self.measure) < self.value

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that one of them covers is rejected. A stem that ends in a blank is a whole word."""

    rules: tuple[tuple[Condition, ...], ...] = ()
    marked: tuple[str, ...] = ()

    def column(self) -> Column:
        """The first rule that covers the row, as text, or null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            covers = F.lit(True)
            for condition in rule:
                covers = covers & condition.column()
            out = F.when(covers, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def with_statistics(df: DataFrame) -> DataFrame:
    """``df`` with ``_text``, the base statistics and ``_words``, ``_lines`` of its column ``text``. Null texts have none."""
    df = bind(df, _text=F.coalesce("text", F.lit("")))
    df = bind(
        df,
        _words=F.array_remove(F.split("_text", SPACE), ""),
        _lines=F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")),
    )
    df = bind(
        df,
        _three=F.when(
            F.size("_words") > 2,
            F.transform(
                F.slice("_words", 1, F.size("_words") - 2),
                lambda word, k: F.xxhash64(word, F.get("_words", k + 1), F.get("_words", k + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # only texts with a repeated window are looked at window by window
    placed = F.sort_array(F.transform("_three", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    df = bind(
        df,
        _placed=F.when(F.size(F.array_distinct("_three")) < F.size("_three"), placed).otherwise(
            F.array().cast("array<struct<h:bigint,k:int>>")
        ),
    )
    again = F.filter(
        "_placed", lambda x, at: (F.get("_placed", at - 1)["h"] == x["h"]) | (F.get("_placed", at + 1)["h"] == x["h"])
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["k"], x["k"] + 1, x["k"] + 2)))
    df = bind(
        df,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_symbols=F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=F.when(F.size("_placed") > 0, F.size(F.array_distinct(covered))).otherwise(0).cast("long"),
    )
    return df.drop("_three", "_placed")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_measures(df: DataFrame, marked: tuple[str, ...]) -> DataFrame:
    """The statistics relative to the text's size, as the rules see them."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern))

    hits = F.lit(0)
    if marked:
        hits = F.regexp_count(F.lower("_text"), F.lit(r"(?<!\p{L})" + _either(sorted(marked))))
    df = bind(
        df,
        length=F.col("n_words").cast("double"),
        mean_word=F.col("word_chars") / words,
        symbols=100.0 * F.col("n_symbols") / words,
        repeats=F.col("n_repeat_words") / words,
        dup_lines=F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        upper=count(r"\p{Lu}") / chars,
        exclaims=100.0 * count("!") / words,
        bars=100.0 * count(r"\|") / words,
        digits=count("[0-9]") / chars,
        variety=F.size(F.array_distinct("_words")) / words,
        marked=hits / F.greatest(F.lit(1.0), words / 1000),
    )
    return df.drop("_text", "_words", "_lines")


def _either(stems: list[str], at: int = 0) -> str:
    """Pattern of any of the sorted stems, from letter ``at`` on: beginnings in common are tried once."""
    if any(len(stem) == at for stem in stems):
        return ""
    parts = []
    for letter, own in groupby(stems, key=lambda stem: stem[at]):
        parts.append(r"(?!\p{L})" if letter == " " else re.escape(letter) + _either(list(own), at + 1))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def labelled(docs: DataFrame, labels: DataFrame, how: Covering = DEFAULT) -> DataFrame:
    """doc_id, text, toxic, bad of at most ``how.sample`` labelled documents; nulls are no labels."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
        F.coalesce(F.min(F.col("quality")) == 0, F.lit(False)).alias("_poor"),
    )
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", F.col("_toxic").alias("toxic"), (F.col("_toxic") | F.col("_poor")).alias("bad"))


def marked_stems(rows: DataFrame, how: Covering = DEFAULT) -> tuple[str, ...]:
    """Beginnings of words, and whole words, that mark toxic texts.

    Words are lower-cased. Their first four to nine letters count, and the whole word, which
    ends in a blank here. Copies of a text count once. Of nested stems that qualify the
    shortest is taken, and made as long as its texts allow, so that what its words share with
    harmless ones does not count.
    """
    texts = rows.groupBy(F.xxhash64("text").alias("copy")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 3))
    parts = F.transform(words, lambda w: F.array(*(F.left(w, F.lit(k)) for k in range(4, 10)), F.concat(w, F.lit(" "))))
    usual = texts.agg(F.coalesce(F.avg(F.col("toxic").cast("int")), F.lit(0.0))).first()[0]
    counts = texts.select("toxic", F.explode(F.array_distinct(F.flatten(parts))).alias("stem")).groupBy("stem")
    counts = counts.agg(F.count_if("toxic").alias("bad"), F.count("*").alias("n"))
    pure = F.col("bad") + how.weight * usual >= how.purity * (F.col("n") + how.weight)
    found = {r.stem: r.bad for r in counts.where((F.col("bad") >= how.least) & pure).collect()}  # stems of at most ``sample`` texts
    longer: dict[str, list[str]] = {}
    for stem in found:
        longer.setdefault(stem[:-1], []).append(stem)
    out = []
    for stem in sorted(found):
        if any(stem[:k] in found for k in range(4, len(stem))):
            continue
        most, enough = stem, how.share * found[stem]
        while following := [x for x in longer.get(most, ()) if found[x] >= enough]:
            most = max(following, key=lambda x: (found[x], x))
        out.append(most)
    return tuple(out)


def learn(docs: DataFrame, labels: DataFrame, how: Covering = DEFAULT) -> DecisionList:
    """The decision list of the labelled documents; empty where there are none of either class."""
    rows = hold(labelled(docs, labels, how), "labelled")
    marked = marked_stems(rows.where(_growing()), how)
    rows = with_measures(with_statistics(rows), marked).where(~base_failed())
    measured = hold(rows.select("doc_id", "bad", *MEASURES), "measured")
    shares = [0.01, 0.02, 0.05, *(k / 10 for k in range(1, 10)), 0.95, 0.98, 0.99]
    cuts = measured.agg(
        F.count_if("bad").alias("bad"), F.count("*").alias("n"),
        *(F.array_distinct(F.concat(F.percentile(m, F.array(*map(F.lit, shares))),
                                    F.percentile(F.when(F.col("bad"), F.col(m)), F.array(*map(F.lit, shares))))).alias(m) for m in MEASURES),
    ).first()
    if not cuts.bad or cuts.bad == cuts.n:
        return DecisionList((), marked)
    edges = {m: sorted({c for c in cuts[m]} | (set(MARKS) if m == "marked" else set())) for m in MEASURES}
    parted = measured.withColumn("grows", _growing())

    rules: list[tuple[Condition, ...]] = []
    left = parted
    while len(rules) < how.rules:
        rule = _pruned(left, _settled(left, _grown(left, edges, how), how), how)
        if not rule:
            break
        rules.append(rule)
        covers = F.lit(True)
        for condition in rule:
            covers = covers & condition.column()
        left = left.where(~covers)
    return DecisionList(tuple(rules), marked)


def _growing() -> Column:
    """The part of the labelled rows that rules and stems are grown on; the rest prunes."""
    return F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) > 0


def _histogram(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Of each measure the bad and good rows per bin; bin k holds values from edge k - 1 up to edge k."""
    entries = []
    for measure, cuts in edges.items():
        bin_ = sum(((F.col(measure) >= c).cast("int") for c in cuts), F.lit(0))
        entries.append(F.struct(F.lit(measure).alias("measure"), bin_.alias("bin")))
    long = rows.select("bad", F.explode(F.array(*entries)).alias("x")).select("bad", "x.*")
    counts = long.groupBy("measure", "bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    out: dict[str, dict[int, tuple[int, int]]] = {m: {} for m in edges}
    for r in counts:  # at most measures x bins
        out[r.measure][r.bin] = (r.bad, r.good)
    return out


def _grown(left: DataFrame, edges: dict[str, list[float]], how: Covering) -> list[Condition]:
    rule: list[Condition] = []
    rows = left.where("grows")
    while len(rule) < how.conditions:
        histogram = _histogram(rows, edges)
        bad, good = (sum(x[k] for x in histogram["length"].values()) for k in (0, 1))
        if bad < how.least or not good:
            break
        before, best = math.log2(bad / (bad + good)), (0.0, None)
        for measure, cuts in edges.items():
            bins = histogram[measure]
            below_bad = below_good = 0
            for k, cut in enumerate(cuts):
                below_bad += bins.get(k, (0, 0))[0]
                below_good += bins.get(k, (0, 0))[1]
                for at_least, p, n in ((True, bad - below_bad, good - below_good), (False, below_bad, below_good)):
                    if p >= how.least and p + n < bad + good:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(measure, at_least, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows.where(best[1].column())
    return rule


def _settled(left: DataFrame, rule: list[Condition], how: Covering) -> list[Condition]:
    """``marked`` counts per thousand words, begun ones counting whole. The rule with the least threshold on ``marked`` that is precise on the other part, if there is one.

    Stems are learned where the rule was grown and look better there than they are.
    """
    for k, condition in enumerate(rule):
        if condition.measure == "marked" and condition.at_least:
            rows = left.where(~F.col("grows"))
            for other in rule[:k]:
                rows = rows.where(other.column())
            counts = rows.agg(*(F.count_if(F.col("bad") & (F.col("marked") >= m)).alias(f"p{m:g}") for m in MARKS),
                              *(F.count_if(F.col("marked") >= m).alias(f"n{m:g}") for m in MARKS)).first()
            precise = [m for m in MARKS if counts[f"p{m:g}"] >= how.precision * max(1, counts[f"n{m:g}"])]
            if precise:
                return [*rule[:k], replace(condition, value=precise[0]), *rule[k + 1 :]]
    return rule


def _pruned(left: DataFrame, rule: list[Condition], how: Covering) -> tuple[Condition, ...]:
    """The beginning of the rule with the best (bad - good) / (bad + good) on the other part, if precise."""
    if not rule:
        return ()
    sums, covers = [], F.lit(True)
    for k, condition in enumerate(rule):
        covers = covers & condition.column()
        sums += [F.count_if(covers & F.col("bad")).alias(f"p{k}"), F.count_if(covers & ~F.col("bad")).alias(f"n{k}")]
    counts = left.where(~F.col("grows")).agg(*sums).first()
    worth = [((counts[f"p{k}"] - counts[f"n{k}"]) / max(1, counts[f"p{k}"] + counts[f"n{k}"]), -k) for k in range(len(rule))]
    k = -max(worth)[1]
    precise = counts[f"p{k}"] >= how.precision * max(1, counts[f"p{k}"] + counts[f"n{k}"])
    return tuple(rule[: k + 1]) if precise else ()


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rule, one row per row of ``docs``.

    Other columns are ignored. A null or empty text has no words and fails the base rules.
    """
    measured = with_measures(with_statistics(docs.select("doc_id", "text")), rules.marked)
    verdict = bind(measured, base_failed=base_failed(), rule=rules.column())
    return verdict.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def kept_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that neither base rules nor the list reject, unchanged."""
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns))
    rows = docs.select(whole.alias("_row"), "text")
    measured = with_measures(with_statistics(rows), rules.marked)
    return measured.where(~base_failed() & rules.column().isNull()).select("_row.*")
