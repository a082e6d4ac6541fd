"""Quality rules: base counts of each text, then robust multivariate outliers by language and source.

Each text's counts become a vector of transformed statistics. Every (lang, source) group gets the estimate with the
minimum covariance determinant over `share` of its rows: from four deterministic starts (medians and MADs; correlations
of the tanh of standardized values; spatial signs; the half of rows nearest to the medians) concentration steps take
mean and covariance of the rows nearest to the present estimate anew until no determinant falls, the start with the least
determinant wins, and the usual reweighting step follows. Variances are held at `floor` or above; the number of
directions above it is the estimate's rank, which sets the consistency factor and the cutoff (the chi-square quantile of
1 - `tail`). Texts beyond the cutoff are rejected. All of it is DataFrame work: parameters are aggregates, distances come
from the Cholesky factor written out as columns; medians and shares are percentiles within 1/2000 of the ranks.

Nulls: a null text has no words (base_failed); null lang or source form groups of their own. Rows of a group under `least`
usable rows are judged by the estimate of the first wider group that has so many (language, then source), else of all
rows; a wider estimate is taken from all its usable rows, so every usable row gets a distance. In a group whose
statistics don't vary, rows further off than the floor allows are rejected. An empty or very long text is a text like any
other, repeated rows (and ties of distances) count as often as they occur, an empty table gives an empty result, and of
columns with the result's names the result's stay.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm.shared import materialize

#: White space of the word pattern, and the counted symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Above so many groups their parameters are joined by shuffle.
MOST_BROADCAST = 10_000
#: Share of normal rows beyond the cutoff: rejects far outliers only.
TAIL = 1e-6


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], t.alias("__t"))
    df = df.withColumn("__plain", F.btrim(F.regexp_replace("__t", "[\\x20\\x09-\\x0D]+", " "), F.lit(" ")))
    words = F.when(F.col("__plain") == "", F.array().cast("array<string>")).otherwise(F.split("__plain", " "))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = df.withColumns({"__words": words, "__lines": lines})
    n = F.size("__words")
    ids = F.expr("transform(arrays_zip(slice(__words, 1, size(__words) - 2), slice(__words, 2, size(__words) - 2), slice(__words, 3, size(__words) - 2)), w -> xxhash64(w))")
    df = df.withColumn("__ids", F.when(n >= 3, ids).otherwise(F.array().cast("array<bigint>")))
    # windows in order of (hash, place); a window counts if a neighbour has its hash
    repeated = F.expr("""
        CASE WHEN size(array_distinct(__ids)) = size(__ids) THEN array() ELSE
          aggregate(array(sort_array(transform(__ids, (h, i) -> struct(h AS h, i AS i)))), cast(array() AS array<int>), (u, s) ->
            sort_array(transform(filter(arrays_zip(s, slice(s, 2, size(s)), concat(array(element_at(s, 1)), s)), (z, k) -> (k > 0 AND k < size(s) AND z.s.h = z.`2`.h) OR (k < size(s) - 1 AND z.s.h = z.`1`.h)), z -> z.s.i)))
        END""")
    df = df.withColumn("__at", repeated)
    covered = F.expr("CASE WHEN size(__at) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(__at, 1, size(__at) - 1), slice(__at, 2, size(__at)), (a, b) -> least(b - a, 3)), 0L, (s, x) -> s + x) END")
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in own],
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed vector: length and its parts on scales where groups are roughly elliptic."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.asin(F.sqrt(F.least(F.col(c) / n, F.lit(1.0))))
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols"), share("n_repeat_words")]


def _squared(p: int) -> Column:
    """Mahalanobis distance: forward substitution with the Cholesky factor's columns l{i}{j}."""
    y: list[Column] = []
    for i in range(p):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * y[j]
        y.append(value / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(params: DataFrame, p: int, floor: float) -> DataFrame:
    """Columns l{i}{j} of the Cholesky factor of the covariance c{i}{j} (`floor`: least variance left on the diagonal), rank and the logarithm of the determinant."""
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(floor))) if i == j else value / F.col(f"l{j}{j}"))
    diagonal = [F.col(f"l{i}{i}") for i in range(p)]
    rank = sum(((x > floor**0.5 * (1 + 1e-9)).cast("int") for x in diagonal[1:]), (diagonal[0] > floor**0.5 * (1 + 1e-9)).cast("int"))
    return params.withColumns({"rank": rank, "logdet": sum((F.log(x) for x in diagonal[1:]), F.log(diagonal[0]))})


def chi2_below(x: float, p: int) -> float:
    """Distribution function of chi-square with p degrees of freedom, by the recurrence over p."""
    if p <= 2:
        return math.erf(math.sqrt(x / 2)) if p == 1 else -math.expm1(-x / 2)
    return chi2_below(x, p - 2) - (x / 2) ** (p / 2 - 1) * math.exp(-x / 2) / math.gamma(p / 2)


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, p) < q else (low, mid)
    return low


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest `share` of normal rows has to be multiplied by."""
    return share / chi2_below(chi2_quantile(share, p), p + 2)


def _by_rank(p: int, f) -> Column:
    """f(rank) as a column; an estimate without a direction above the floor counts as one of rank 1."""
    return F.element_at(F.array(*[F.lit(float(f(r))) for r in range(1, p + 1)]), F.greatest(F.col("rank"), F.lit(1)))


def _moments(rows: DataFrame, by: tuple[str, ...], p: int) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in product(range(p), range(p)) if j <= i])


def robust_outliers(stats: DataFrame, p: int, share: float = 0.75, steps: int = 12, floor: float = 0.01) -> DataFrame:
    """(unit, m*, l*, rank, scale): the reweighted minimum-covariance-determinant estimate of each unit's rows x0..x{p-1}."""
    spread = (lambda df: df) if stats.select("unit").distinct().count() > MOST_BROADCAST else F.broadcast
    met = lambda params: stats.join(spread(params), "unit")
    middle = lambda of, name: F.percentile_approx(of, 0.5, 2000).alias(name)
    centre = materialize(stats.groupBy("unit").agg(*[middle(F.col(f"x{i}"), f"m{i}") for i in range(p)]), "centres")
    mad = met(centre).groupBy("unit").agg(*[middle(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), f"s{i}") for i in range(p)])
    mad = mad.select("unit", *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(floor**0.5)).alias(f"s{i}") for i in range(p)])
    scaled = materialize(centre.join(mad, "unit"), "scales")
    standard = met(scaled).select("unit", *[f"x{i}" for i in range(p)], *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(p)])
    standard = standard.withColumn("norm", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")))
    half = standard.groupBy("unit").agg(middle(F.col("norm"), "half"))
    lower = [(i, j) for i in range(p) for j in range(i + 1)]
    size = F.sqrt(F.greatest(F.col("norm"), F.lit(1e-12)))
    near = F.col("norm") <= F.col("half")
    shape = standard.join(spread(half), "unit").groupBy("unit").agg(
        *[F.coalesce(F.try_divide(F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")), F.stddev_pop(F.tanh(f"z{i}")) * F.stddev_pop(F.tanh(f"z{j}"))), F.lit(0.0)).alias(f"t{i}{j}") for i, j in lower if i != j],
        *[F.avg(F.col(f"z{i}") / size * F.col(f"z{j}") / size).alias(f"k{i}{j}") for i, j in lower],
        *[F.avg(F.when(near, F.col(f"x{i}"))).alias(f"h{i}") for i in range(p)],
        *[F.covar_pop(F.when(near, F.col(f"x{i}")), F.when(near, F.col(f"x{j}"))).alias(f"b{i}{j}") for i, j in lower],
    )
    shape = materialize(scaled.join(shape, "unit"), "shapes")
    both = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    covariances = [
        lambda i, j: both(i, j) if i == j else F.lit(0.0),
        lambda i, j: both(i, j) * (F.lit(1.0) if i == j else F.col(f"t{i}{j}")),
        lambda i, j: both(i, j) * p * F.col(f"k{i}{j}"),
        lambda i, j: F.col(f"b{i}{j}"),
    ]
    starts = [shape.select("unit", F.lit(k).alias("start"), *[F.col(f"h{i}" if k == 3 else f"m{i}").alias(f"m{i}") for i in range(p)], *[c(i, j).alias(f"c{i}{j}") for i, j in lower]) for k, c in enumerate(covariances)]
    params = materialize(_factor(reduce(DataFrame.unionByName, starts), p, floor), "mcd")
    for step in range(steps):
        cut = met(params).groupBy("unit", "start").agg(F.percentile_approx(_squared(p), share, 2000).alias("cut"))
        kept = met(params.join(cut, ["unit", "start"])).where(_squared(p) <= F.col("cut"))
        after = materialize(_factor(_moments(kept, ("unit", "start"), p), p, floor), "mcd")
        fell = after.join(params.select("unit", "start", F.col("logdet").alias("was")), ["unit", "start"]).where(F.col("was") - F.col("logdet") > 1e-4)
        done = step > 0 and fell.isEmpty()  # the starts themselves are no estimates of a subset
        params = after
        if done:
            break
    names = [c for c in params.columns if c not in ("unit", "start")]
    best = params.groupBy("unit").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("best")).select("unit", "best.*")
    best = materialize(best.withColumn("scale", _by_rank(p, lambda r: consistency(share, r))), "best")
    inner = met(best).where(_squared(p) / F.col("scale") <= _by_rank(p, lambda r: chi2_quantile(0.975, r)))
    final = _factor(_moments(inner, ("unit",), p), p, floor)
    return materialize(final.withColumn("scale", _by_rank(p, lambda r: consistency(0.975, r))), "estimates")


def widened_outliers(stats: DataFrame, keys: list[str], p: int, least: int = 50, **options) -> DataFrame:
    """(keys, m*, l*, rank, scale) for each group of keys: of its own rows if `least`, else of the first wider group with so many, else of all rows."""
    groups = materialize(stats.groupBy(*keys).agg(F.count("*").alias("rows")), "sizes")
    spread = F.broadcast if groups.count() <= MOST_BROADCAST else (lambda df: df)
    levels = [c for r in range(len(keys), -1, -1) for c in combinations(keys, r)]
    unit = lambda k: F.to_json(F.struct(F.lit(k).alias("_"), *[F.col(c).alias(f"{c}_") for c in levels[k]]))  # noqa: E731  null fields are left out
    each = groups.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), unit(k).alias("unit")) for k in range(len(levels))])).alias("u")).select(*keys, "rows", "u.level", "u.unit")
    enough = each.groupBy("unit").agg(F.sum("rows").alias("all")).where((F.col("all") >= least) | (F.col("unit") == F.lit(f'{{"_":{len(levels) - 1}}}')))
    own = each.join(spread(enough), "unit").groupBy(*keys).agg(F.min(F.struct("level", "unit")).alias("u")).select(*keys, "u.unit")
    own = materialize(own, "units")
    cover = each.join(spread(own.select("unit").distinct()), "unit", "left_semi").select("unit", *keys)

    def matched(df: DataFrame, other: DataFrame) -> DataFrame:
        other = other.select(*[F.col(k).alias(f"w_{k}") for k in keys], *[c for c in other.columns if c not in keys])
        return df.join(spread(other), [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]).drop(*[f"w_{k}" for k in keys])

    rows = matched(stats, cover).select("unit", *[f"x{i}" for i in range(p)])
    return own.join(robust_outliers(rows, p, **options), "unit").drop("unit")


def judge_quality(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), tail: float = TAIL, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """keep columns with the base counts, base_failed, distance (null: only base_failed rows in the whole table) and kept."""
    base = base_counts(docs.select(*keep, *[k for k in keys if k not in keep], "text")).drop("text")
    vector = statistics()
    p = len(vector)
    stats = materialize(base.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector)]), "stats")
    params = materialize(widened_outliers(stats.where(~F.col("base_failed")).select(*keys, *[f"x{i}" for i in range(p)]), list(keys), p, **options), "params")
    small = params.count() <= MOST_BROADCAST
    params = params.select(*[F.col(k).alias(f"g_{k}") for k in keys], "scale", "rank", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])
    joined = stats.join(F.broadcast(params) if small else params, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys], "left")
    far = F.col("distance") > _by_rank(p, lambda r: chi2_quantile(1 - tail, r))
    judged = joined.withColumn("distance", _squared(p) / F.col("scale")).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return judged.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
