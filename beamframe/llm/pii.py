"""Personal data in texts: fixed base patterns, and candidates judged by gradient-boosted trees, in DataFrame functions alone.

Base spans come from the patterns below, checked (part values, Luhn sums, digit counts) without retries; they always
count. Wider generators propose further, overlapping candidates (spaced or "at" addresses, numbers in groups, local
phone numbers). Each candidate has features of its format and of the words around it, with few levels each, so the whole
corpus is summed into one small table of feature cells (at most MOST_CELLS rows), on which trees are boosted.

Labels don't come from what the base patterns match. Positive examples are base matches rewritten into FORMS that the base
patterns miss, each in the surroundings where it was found. Negative ones are the candidates of texts without any base
match, and candidates that overlap base matches of other kinds only. Candidates on a base match of their own kind are not
learned from. The last two forms of each kind, and half of the negative ones (by a hash), take no part in boosting: on
them the threshold of each kind is calibrated, the least score at which PRECISION of the candidates are positive, and
precision and recall are measured (Booster.measured). The trees then are one CASE expression over each candidate;
candidates at or above their kind's threshold are added to the spans.

Offsets are code points, ends exclusive. A null or empty text has no spans; texts of any length are read whole. Rows are
judged one by one: repeated rows, nulls elsewhere and other columns (whatever their names) don't matter; spans of the
same kind and place count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, and base patterns (possessive, begun at the start of a run or where the last match ended: same matches in linear time).
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base patterns.
WIDE = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+){0,8}+"),
    ("ip", r"(?:(?<![0-9.])|\G)[0-9]{1,3}+(?:\x20?[.,:]\x20?[0-9]{1,3}+){3,7}+"),
    ("card", r"(?:(?<![0-9])|\G)[0-9]{2,19}+(?:[\x20./_-]{1,2}+[0-9]{2,19}+){0,6}+"),
    ("phone", r"(?:(?<![0-9+(])|\G)(?:\+|00|\()?[0-9]{1,5}+(?:[\x20()./-]{1,3}+[0-9]{2,8}+){1,5}+"),
]
#: Words that make a kind likely or unlikely before a candidate.
CONTEXT = {"email": "mail|contact|write|@", "ip": "ip|host|server|addr|ping", "card": "card|visa|credit|account|pay", "phone": "phone|call|tel|mobile|fax|cell"}
LEVELS = (4, 4, 4, 2, 3, 3, 2, 2)
MOST_CELLS = 2 * len(KINDS) * math.prod(LEVELS)
PRECISION = 0.98
#: How a base match is rewritten, (pattern, replacement) one after another; two forms to learn from, two to calibrate on.
FORMS = {
    "email": [[("@", " (at) ")], [("@", " [at] "), (r"\.", " [dot] ")], [("@", " @ ")], [("@", "(at)"), (r"\.", "(dot)")]],
    "ip": [[(r"\.", " . ")], [(r"\.", ",")], [(r"\.", ":")], [(r"\.", ". ")]],
    "card": [[("[^0-9]", ""), (f"([0-9]{{4}})(?=[0-9]{{2}})", f"$1{x}")] for x in ("/", "_", "  ", ".")],
    "phone": [[(r"^\+[0-9]{1,3}[^0-9(]*", "")], [(r"^\+", "00")], [(r"^\+[0-9]{1,3}[^0-9(]*", ""), (r"[^0-9]+", "."), (r"^\.", "")], [(r"^\+[0-9]{1,3}[^0-9(]*", ""), (r"[()]", ""), (r"[^0-9]+", "/")]],
}


def _located(text: Column, pattern: str, test: Column) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches; running sums go over blocks of 256, so long texts stay cheap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x: Column) -> Column:
        hits, parts = x["hits"], x["parts"]
        k = F.size(hits)
        gaps = F.zip_with(F.slice(parts, F.lit(1), k), F.concat(F.array(F.lit("")), F.slice(hits, F.lit(1), k - 1)), lambda p, h: F.length(p) + F.length(h))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

        def within(y: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((k - 1) / 256).cast("int")), lambda b: F.slice(y, b * 256 + 1, F.lit(256)))

            def bases(z: Column) -> Column:
                sums = F.transform(z, total)
                heads = F.transform(F.sequence(F.lit(0), F.size(z) - 1), lambda b: total(F.slice(sums, F.lit(1), b)))
                return F.flatten(F.zip_with(z, heads, lambda x, base: F.transform(x, lambda g, i: base + total(F.slice(x, F.lit(1), i + 1)))))

            return _let(blocks, bases)

        starts = _let(gaps, within)
        return F.zip_with(starts, hits, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m")))

    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    some = _let(F.struct(found.alias("hits"), F.split(text, pattern, -1).alias("parts")), lambda x: F.when(F.size(x["hits"]) == 0, empty).otherwise(placed(x)))
    return F.when(test, some).otherwise(empty)


def _let(value: Column, body) -> Column:
    """body(value), value being computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right counts double, less nine above nine."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _let(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda s, v: s + v) % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return _let(_digits(m), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _tests(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {"email": F.instr(text, "@") > 0, "ip": digit, "card": digit, "phone": F.instr(text, "+") > 0}


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind (its place in KINDS)>>"""
    tests = _tests(text)

    def of(i: int, k: str) -> Column:
        good = F.filter(_located(text, BASE[k], tests[k]), lambda x: _valid(k, x["m"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    each = [of(i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _clip(value: Column, levels: int) -> Column:
    return F.greatest(F.lit(0), F.least(value.cast("int"), F.lit(levels - 1)))


def features(name: str, m: Column, before: Column, follow: Column) -> list[Column]:
    """f0..f7 of a candidate: its parts, blanks, punctuation, soundness and letters, what stands before and after it."""
    digits = _digits(m)
    nd = F.length(digits)
    amount = {"email": F.size(F.split(m, r"\.|dot")) - 1, "ip": F.size(F.split(m, "[.,:]")) - 3, "card": F.when(nd < 12, 0).when(nd < 16, 1).when(nd < 20, 2).otherwise(3), "phone": F.when(nd < 9, 0).when(nd < 12, 1).when(nd < 16, 2).otherwise(3)}[name]
    sound = {"email": m.rlike(r"^\S+$"), "ip": ~m.rlike(r"(?:^|[^0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9])"), "card": nd.between(12, 19) & luhn(F.substring(digits, 1, 19)), "phone": m.rlike(r"^\+")}[name]
    values = [amount, F.length(F.regexp_replace(m, r"[^\x20]", "")), F.length(F.regexp_replace(m, r"[^().,:/_-]", "")) / 2, sound.cast("int"), F.when(before.rlike(r"[A-Za-z0-9]$"), 2).when(before.rlike(r"\s$"), 0).otherwise(1), F.when(follow.rlike("[A-Za-z0-9]"), 2).when(follow.rlike(r"^\s?$"), 0).otherwise(1), before.rlike(CONTEXT[name]).cast("int"), m.rlike("[A-Za-z]").cast("int")]
    return [_clip(v, k) for v, k in zip(values, LEVELS, strict=True)]


def _before(text: Column, start: Column) -> Column:
    return F.lower(F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24))))


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, f0..f7, fold>>: what the generators propose, with small features."""
    digit = text.rlike("[0-9]")
    tests = {"email": text.rlike(r"@|[(\[]at[)\]]"), "ip": digit, "card": digit, "phone": digit}

    def featured(kind: int, name: str):
        def make(x: Column) -> Column:
            found = features(name, x["m"], _before(text, x["start"]), F.substring(text, x["end"] + 1, F.lit(1)))
            return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), *[v.alias(f"f{i}") for i, v in enumerate(found)], F.pmod(F.hash(x["m"]), F.lit(2)).alias("fold"))

        return make

    each = [F.transform(_located(text, pattern, tests[name]), featured(KINDS.index(name), name)) for name, pattern in WIDE]
    return F.concat(*each)


def rewritten(name: str, m: Column, form: int) -> Column:
    for pattern, by in FORMS[name][form]:
        m = F.regexp_replace(m, pattern, by)
    return m


@dataclass
class Booster:
    """Depth-two trees over (kind, f0..f7): (feature, level, left leaves, right leaves); start; thresholds by kind (None: adds nothing)."""

    start: float
    trees: list
    thresholds: list
    measured: list = field(default_factory=list)  # by kind, on forms not learned from: (precision, recall, positives, negatives), None without a threshold

    def score(self, value) -> Column:
        total = F.lit(self.start)
        for f, t, (lf, lt, a, b), (rf, rt, c, d) in self.trees:
            total = total + F.when(value(f) <= t, F.when(value(lf) <= lt, a).otherwise(b)).otherwise(F.when(value(rf) <= rt, c).otherwise(d))
        return total


FEATURES = ("kind", *[f"f{i}" for i in range(len(LEVELS))])


def fit_cells(cells: list[tuple], rounds: int = 24, rate: float = 0.4) -> Booster:
    """Boost log-loss on weighted cells (features..., fold, n, positive): at most MOST_CELLS of them, whatever the corpus."""
    import numpy as np

    data = np.array(cells, np.float64).reshape(-1, len(FEATURES) + 3)
    x, fold, n, y = data[:, : len(FEATURES)].astype(int), data[:, -3], data[:, -2], data[:, -1]
    own = fold == 0
    if not own.any() or not 0 < y[own].sum() < n[own].sum():
        return Booster(0.0, [], [None] * len(KINDS))
    start = float(np.log(y[own].sum() / (n[own] - y[own]).sum()))
    score, trees = np.full(len(x), start), []

    def split(mask, g, h):
        best = (0.0, 0, 99, *(2 * [rate * g[mask].sum() / (h[mask].sum() + 1)]))
        for f in range(x.shape[1]):
            for t in range(int(x[:, f].max())):
                left, right = mask & (x[:, f] <= t), mask & (x[:, f] > t)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, t, rate * gl / (hl + 1), rate * gr / (hr + 1))
        return best

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = np.where(own, y - n * p, 0), np.where(own, n * p * (1 - p), 0)
        root = split(own, g, h)
        sides = [split(own & side, g, h) for side in (x[:, root[1]] <= root[2], x[:, root[1]] > root[2])]
        trees.append((FEATURES[root[1]], int(root[2]), *[(FEATURES[s[1]], int(s[2]), round(float(s[3]), 6), round(float(s[4]), 6)) for s in sides]))
        for side, s in zip((x[:, root[1]] <= root[2], x[:, root[1]] > root[2]), sides, strict=True):
            score += np.where(side, np.where(x[:, s[1]] <= s[2], s[3], s[4]), 0)
    thresholds: list = []
    measured: list = []
    for k in range(len(KINDS)):
        held = (fold == 1) & (x[:, 0] == k)
        order = np.argsort(-score[held], kind="stable")
        s, hit, all_ = score[held][order], np.cumsum(y[held][order]), np.cumsum(n[held][order])
        last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
        good = np.flatnonzero(last & (hit >= PRECISION * all_) & (all_ >= 20) & (s > 0)) if len(s) else []
        thresholds.append(float(s[good[-1]]) - 1e-4 if len(good) else None)
        at = good[-1] if len(good) else None
        measured.append((float(hit[at] / all_[at]), float(hit[at] / hit[-1]), int(hit[-1]), int(all_[-1] - hit[-1])) if at is not None else None)
    return Booster(start, trees, thresholds, measured)


def _spans(docs: DataFrame, text: str) -> DataFrame:
    own = ("__text", "__base", "__wide")
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return df.withColumn("__base", base_spans(F.col("__text"))).withColumn("__wide", candidates(F.col("__text")))


def fit(docs: DataFrame, text: str = "text") -> Booster:
    """Sum rewritten base matches and negative candidates of all docs into feature cells and boost trees on them."""
    df = _spans(docs.select(F.col(f"`{text}`").alias("text")), "text").where((F.size("__wide") > 0) | (F.size("__base") > 0))
    names = [f"f{i}" for i in range(len(LEVELS))]
    over = lambda c, same: F.exists("__base", lambda b: ((b["kind"] == c["kind"]) == F.lit(same)) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    negative = F.filter("__wide", lambda c: (F.size("__base") == 0) | (over(c, False) & ~over(c, True)))
    empty = F.lit(None).cast("string")
    no = F.transform(negative, lambda c: F.struct(c["kind"].alias("kind"), c["fold"].alias("fold"), F.lit(-1).alias("form"), empty.alias("m"), empty.alias("before"), empty.alias("follow"), *[c[f].alias(f) for f in names]))
    forms = len(FORMS["email"])

    def seeds(b: Column) -> Column:
        m = F.substring("__text", b["start"] + 1, b["end"] - b["start"])
        around = (m.alias("m"), _before(F.col("__text"), b["start"]).alias("before"), F.substring("__text", b["end"] + 1, F.lit(1)).alias("follow"))
        return F.transform(F.sequence(F.lit(0), F.lit(forms - 1)), lambda i: F.struct(b["kind"].alias("kind"), (2 * i >= forms).cast("int").alias("fold"), i.alias("form"), *around, *[F.lit(None).cast("int").alias(f) for f in names]))

    items = df.select(F.explode(F.concat(no, F.flatten(F.transform("__base", seeds)))).alias("c")).select("c.*")
    written, proposed = F.lit(None).cast("string"), F.lit(False)
    for k, name in enumerate(KINDS):
        own = F.lit(None).cast("string")
        for form in range(forms):
            own = F.when(F.col("form") == form, rewritten(name, F.col("m"), form)).otherwise(own)
        written = F.when(F.col("kind") == k, own).otherwise(written)
        proposed = F.when(F.col("kind") == k, F.col("w").rlike(f"^(?:{dict(WIDE)[name]})$")).otherwise(proposed)
    items = items.withColumn("w", written).where((F.col("form") < 0) | proposed)
    each = [features(name, F.col("w"), F.col("before"), F.col("follow")) for name in KINDS]
    found = []
    for i, f in enumerate(names):
        value = F.col(f)
        for k in range(len(KINDS)):
            value = F.when((F.col("form") >= 0) & (F.col("kind") == k), each[k][i]).otherwise(value)
        found.append(value.alias(f))
    cells = items.select("kind", *found, "fold", (F.col("form") >= 0).cast("int").alias("y")).groupBy(*FEATURES, "fold").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    return fit_cells(sorted(tuple(r) for r in cells.collect()))  # at most MOST_CELLS rows


def find(docs: DataFrame, model: Booster | None = None, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with columns `base` and `spans` (in place of such ones of docs): array<struct<start, kind, end>>, ordered; spans has the base ones and the accepted candidates."""
    model = model or fit(docs, text)
    df = _spans(docs, text)

    def accepted(c: Column) -> Column:
        score, said = model.score(lambda f: c[f]), F.lit(False)
        for k, t in enumerate(model.thresholds):
            if t is not None:
                said = said | ((c["kind"] == k) & (score >= t))
        return said

    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    more = bare(F.filter("__wide", accepted)) if any(t is not None for t in model.thresholds) else F.array().cast("array<struct<start:int,kind:int,end:int>>")
    own = F.array_sort(F.array_distinct(F.concat(bare(F.col("__base")), more)))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (base, spans)], bare(F.col("__base")).alias(base), own.alias(spans))


def as_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    df = find(docs.select(key, "text"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select(key, *counts, F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", model: Booster | None = None) -> DataFrame:
    """docs with each span, merged where they overlap, replaced by its first kind in brackets. A null text stays null."""
    df = find(docs, model, text, "__found", "__spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        cut = F.when(x["start"] >= s["at"], F.array(F.substring(t, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["parts"], cut).alias("parts"))

    done = F.aggregate("__spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(t, s["at"] + 1, F.length(t))))
    return df.select(*[F.when(F.size("__spans") == 0, t).otherwise(done).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
