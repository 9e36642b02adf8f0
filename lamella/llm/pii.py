"""Personal data: candidate spans judged by gradient-boosted trees, native throughout.

The base kinds have strict formats and are always kept. Beyond them, high-recall generators
propose spans: loose e-mail addresses and phone numbers, long numbers, key-like strings.
Format and context of each candidate make a few small integers. Candidates of the whole
corpus are counted per combination of these, with weak labels from strict checks that the
trees do not see (a checksum, an international prefix, an assignment to a secret's name), and
the trees are boosted on that table, whose size the number of combinations bounds. They
become nested CASE expressions; per kind, the threshold is the lowest that is precise on
documents set aside.

Positions come from the lengths of matches and of what lies between them, in code points.
Quantifiers are possessive or bounded and matches begin where a run begins, so that very
long runs cost time in proportion.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.bind import bind

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# kinds in the order of their numbers: the pattern of each
BASE = {
    "email": EMAIL,
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MASK = "\ufdd0-\ufdd7"  # noncharacters, one per kind, stand for what is taken already
LOOSE = {
    "loose_email": rf"""(?<![^\s<>"'{_MASK}])[^\s@<>"'{_MASK}]{{1,64}}+@[^\s@<>"',;{_MASK}]{{3,255}}+""",
    "loose_phone": r"(?<![0-9(])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9])[0-9](?:[ -]?[0-9]){8,18}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+",
}
KINDS = [*BASE, *LOOSE]
PATTERNS = {**BASE, **LOOSE}
MASKS = {kind: chr(0xFDD0 + k) for k, kind in enumerate(KINDS)}
FEATURES = ["kind", "size", "digits", "upper", "separators", "before", "context"]
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class Boosting:
    """Trees, learning rate, precision that a threshold must reach, and candidates it needs for that."""

    trees: int = 24
    rate: float = 0.4
    precision: float = 0.95
    least: int = 8


DEFAULT = Boosting()


@dataclass(frozen=True)
class Judge:
    """Trees of depth two: (feature, value) at the root and below, four leaves; thresholds by kind number."""

    bias: float = 0.0
    trees: tuple = ()
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, of) -> Column:
        total = F.lit(self.bias)
        for root, low, high, leaves in self.trees:
            test = lambda split: of(split[0]) >= split[1]
            total = total + F.when(test(root), F.when(test(high), leaves[3]).otherwise(leaves[2])).otherwise(
                F.when(test(low), leaves[1]).otherwise(leaves[0])
            )
        return total

    def value(self, x: tuple[int, ...]) -> float:
        total, at = self.bias, FEATURES.index
        for root, low, high, leaves in self.trees:
            right = x[at(root[0])] >= root[1]
            below = high if right else low
            total += leaves[2 * right + (x[at(below[0])] >= below[1])]
        return total


def _running(values: str) -> Column:
    """Running totals of an array column, by blocks, so that long arrays are not copied per element."""
    size = 256
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))

    def totals(array: Column, start: Column) -> Column:
        first = F.struct(start.cast("bigint").alias("t"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["out"], F.array(s["t"] + x)).alias("out"))
        return F.aggregate(array, first, step, lambda s: s["out"])

    part = lambda b: F.slice(values, b * size + 1, F.lit(size))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), lambda s, x: s + x))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), totals(sums, F.lit(0)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(starts, F.lit(1), F.size(blocks)).alias("s")), lambda x: totals(part(x["b"]), x["s"])))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    """The checks of the base kinds."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


# what a text must hold for a kind to be looked for
_NEEDS = {"email": "@", "phone": "+", "loose_email": "@"}


def _matched(df: DataFrame, text: str, kind: str, guard: Column | None = None) -> DataFrame:
    """``df`` with ``_m``, the matches, ``_p``, what lies around them, and ``_e``, where they end."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<string>")
    look = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    look = look if guard is None else look & guard
    df = bind(df, _m=F.when(look, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = bind(df, _p=F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = bind(df, _s=F.transform("_m", lambda m, k: (F.length(F.get("_p", k)) + F.length(m)).cast("bigint")))
    return bind(df, _e=F.when(F.size("_s") > 0, _running("_s")).otherwise(F.array().cast("array<bigint>"))).drop("_s")


def _masked(text: str, chosen: str, kind: str) -> Column:
    """The text with each chosen match (an array of flags) replaced by as many marks of its kind."""
    filled = F.transform(
        "_p",
        lambda p, k: F.concat(
            p, F.when(F.get(chosen, k), F.repeat(F.lit(MASKS[kind]), F.length(F.get("_m", k)))).otherwise(F.coalesce(F.get("_m", k), F.lit("")))
        ),
    )
    return F.when(F.exists(chosen, lambda x: x), F.array_join(filled, "")).otherwise(F.col(text))


def _spans(kind: str, chosen: str) -> Column:
    number = KINDS.index(kind)
    all_ = F.transform(
        "_m",
        lambda m, k: F.struct(
            (F.get("_e", k) - F.length(m)).alias("start"), F.lit(number).alias("kind"), F.get("_e", k).alias("end"), F.get(chosen, k).alias("chosen")
        ),
    )
    return F.transform(
        F.filter(all_, lambda x: x["chosen"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    )


def _with_base(df: DataFrame) -> DataFrame:
    """``df`` with ``_base``, the base spans of ``_text``, and ``_open``, the text with them masked."""
    found = []
    for kind in BASE:
        df = _matched(df, "_text", kind)
        df = bind(df, _ok=F.transform("_m", lambda m: _valid(kind, m)))  # noqa: B023
        df = bind(df, **{f"_{kind}": _spans(kind, "_ok"), f"_{kind}_any": F.size("_m") > 0}).drop("_m", "_p", "_e", "_ok")
        found.append(f"_{kind}")
    df = bind(df, _base=F.sort_array(F.concat(*found)), _open=F.col("_text")).drop(*found)
    for kind in BASE:  # a text without a match has none when masked either
        df = _matched(df, "_open", kind, F.col(f"_{kind}_any"))
        df = bind(df, _ok=F.transform("_m", lambda m: _valid(kind, m)))  # noqa: B023
        df = bind(df, _next=_masked("_open", "_ok", kind)).drop("_m", "_p", "_e", "_ok", "_open", f"_{kind}_any").withColumnRenamed("_next", "_open")
    return df


def _features(kind: str, k: Column) -> dict[str, Column]:
    """Format and context of the match numbered ``k``, as small integers."""
    m, before = F.get("_m", k), F.right(F.get("_p", k), F.lit(24))
    size = F.length(m)

    def share(pattern: str) -> Column:
        return F.floor(4 * F.length(F.regexp_replace(m, pattern, "")) / size).cast("int")

    steps = (10, 11, 13, 14, 16, 17, 20, 21, 32, 41)
    return {
        "kind": F.lit(KINDS.index(kind)),
        "size": sum(((size >= s).cast("int") for s in steps), F.lit(0)),
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "separators": F.least(F.lit(3), F.length(F.regexp_replace(m, "[^ ().@/_+-]", ""))),
        "before": F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike(r"[\p{L}0-9]$"), 2).otherwise(3),
        "context": F.when(before.rlike("(?i)card|visa|account|iban"), 3)
        .when(before.rlike("(?i)phone|tel|call|mobile|fax"), 2)
        .when(before.rlike("(?i)mail|contact|write"), 1)
        .otherwise(0),
    }


_ASSIGNED = r"""(?i)(?:token|password|passwd|secret|api_?key|access_?key)\s{0,3}[=:]\s{0,3}["']?$"""
# published beginnings of access keys
_KEYS = r"^(?:AKIA[0-9A-Z]{16}$|ghp_|xox[bp]-|sk-)"


def _strict(kind: str, k: Column) -> Column:
    """Weak label of the match numbered ``k``, from what the features do not hold."""
    m, before = F.get("_m", k), F.right(F.get("_p", k), F.lit(24))
    if kind == "loose_email":
        return m.rlike(EMAIL)
    if kind == "loose_phone":
        return before.rlike(r"\+[0-9]{1,3}[ .-]?$")
    if kind == "number":
        return _valid("card", m)
    return before.rlike(_ASSIGNED) | m.rlike(_KEYS)


def cells(docs: DataFrame) -> DataFrame:
    """The features, strict (weak label), aside (kept for thresholds) and n: candidates of all texts, counted."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    found = []
    for kind in LOOSE:
        df = _matched(df, "_text", kind)
        one = lambda m, k: F.struct(
            *(c.cast("int").alias(n) for n, c in _features(kind, k).items()), F.coalesce(_strict(kind, k), F.lit(False)).alias("strict")  # noqa: B023
        )
        df = bind(df, **{f"_{kind}": F.transform("_m", one)}).drop("_m", "_p", "_e")
        found.append(f"_{kind}")
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(4)) == 0
    each = df.select(aside.alias("aside"), F.explode(F.concat(*found)).alias("c")).select("aside", "c.*")
    return each.groupBy("aside", *FEATURES, "strict").agg(F.count("*").alias("n"))


def boosted(counts: list, how: Boosting = DEFAULT) -> Judge:
    """Trees and thresholds from rows of ``cells``."""
    fit: dict[tuple, Counter] = {}
    aside: dict[tuple, Counter] = {}
    for r in counts:
        x = tuple(int(r[f]) for f in FEATURES)
        (aside if r.aside else fit).setdefault(x, Counter())[bool(r.strict)] += r.n
    positive, total = sum(c[True] for c in fit.values()), sum(sum(c.values()) for c in fit.values())
    if not 0 < positive:
        return Judge()
    bias = math.log((positive + 1) / (total - positive + 1))
    points, scores, trees = sorted(fit), {x: bias for x in fit}, []

    def best(side: list[tuple], slope: dict) -> tuple[tuple[str, int], float]:
        """Split of the largest gain."""
        out, most = (FEATURES[0], 0), 1e-9
        all_g, all_h = (sum(slope[x][k] for x in side) for k in (0, 1))
        for at, name in enumerate(FEATURES):
            by: dict[int, list[float]] = {}
            for x in side:
                sums = by.setdefault(x[at], [0.0, 0.0])
                sums[0] += slope[x][0]
                sums[1] += slope[x][1]
            g = h = 0.0
            for value in sorted(by)[:0:-1]:
                g, h = g + by[value][0], h + by[value][1]
                gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                if gain > most:
                    out, most = (name, value), gain
        return out, most

    for _ in range(how.trees):
        slope = {}
        for x in points:
            p, n = 1 / (1 + math.exp(-scores[x])), sum(fit[x].values())
            slope[x] = (fit[x][True] - n * p, n * p * (1 - p))
        test = lambda x, split: x[FEATURES.index(split[0])] >= split[1]
        root, _ = best(points, slope)
        sides = [[x for x in points if test(x, root) == right] for right in (False, True)]
        below = [best(side, slope)[0] for side in sides]
        leaves = []
        for side, split in zip(sides, below):
            for right in (False, True):
                inside = [x for x in side if test(x, split) == right]
                g, h = (sum(slope[x][k] for x in inside) for k in (0, 1))
                leaves.append(how.rate * g / (h + 1))
        trees.append((root, below[0], below[1], tuple(leaves)))
        for x in points:
            right = test(x, root)
            scores[x] += leaves[2 * right + test(x, below[right])]
    judge = Judge(bias, tuple(trees))
    thresholds = {}
    for number in range(len(BASE), len(KINDS)):
        ranked: dict[float, Counter] = {}
        for x, c in aside.items():
            if x[0] == number:
                ranked.setdefault(round(judge.value(x), 9), Counter()).update(c)
        right = wrong = 0
        for score in sorted(ranked, reverse=True):
            right, wrong = right + ranked[score][True], wrong + ranked[score][False]
            if right + wrong >= how.least and right >= how.precision * (right + wrong):
                thresholds[number] = score - 1e-6
    return Judge(bias, tuple(trees), thresholds)


def learn(docs: DataFrame, how: Boosting = DEFAULT) -> Judge:
    """Trees and thresholds from the candidates of all texts; without any, nothing is added to the base."""
    return boosted(cells(docs).collect(), how)  # as many rows as feature combinations occur


def _with_spans(df: DataFrame, judge: Judge) -> DataFrame:
    """``df``, which has ``_text``, with ``_base``, ``_more`` and ``_open``, the text with all spans masked."""
    df = _with_base(df)
    more = []
    for kind in LOOSE:
        threshold = judge.thresholds.get(KINDS.index(kind))
        if threshold is None:
            continue
        df = _matched(df, "_open", kind)
        df = bind(df, _f=F.transform("_m", lambda m, k: F.struct(*(c.cast("int").alias(n) for n, c in _features(kind, k).items()))))  # noqa: B023
        df = bind(df, _ok=F.transform("_f", lambda f: judge.score(lambda name: f[name]) >= threshold))  # noqa: B023
        df = bind(df, **{f"_{kind}": _spans(kind, "_ok")}, _next=_masked("_open", "_ok", kind))
        df = df.drop("_m", "_p", "_e", "_f", "_ok", "_open").withColumnRenamed("_next", "_open")
        more.append(f"_{kind}")
    return bind(df, _more=F.concat(F.array().cast(SPANS), *more)).drop(*more)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, judge: Judge) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row of ``docs``.

    ``spans`` has kind:start:end in code points, end exclusive, by start and kind; spans that
    the trees add do not overlap those of the base or each other. Null and empty texts have
    none. Other columns are ignored.
    """
    df = _with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), judge)
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(BASE)]  # noqa: B023
    return df.select(
        "doc_id", *counts, F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("_base", "_more"))).alias("spans"),
    )


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, such as [EMAIL].

    All rows and columns stay; ``n_chars``, where there is one, is that of the new text.
    Null texts stay null.
    """
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns))
    df = _with_spans(docs.select(whole.alias("_row"), F.coalesce("text", F.lit("")).alias("_text")), judge)
    text = F.col("_open")
    for kind, mark in MASKS.items():
        text = F.regexp_replace(text, f"{mark}+", f"[{kind.removeprefix('loose_').upper()}]")
    df = bind(df, _new=F.when(F.col("_row.text").isNotNull(), text))
    values = {"text": F.col("_new"), "n_chars": F.length("_new").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return df.select(*(values.get(name, F.col(f"_row.`{name}`")).alias(name) for name in docs.columns))
