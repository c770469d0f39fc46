"""Quality rules: counted statistics and robust multivariate outliers.

Every text gets a vector of transformed statistics. For each language and source the
location and scatter of these vectors are estimated by minimum covariance determinant over half
of the texts (concentration steps from several starts until the determinant stops falling, then
one reweighting), so nearly half of a group can be junk, and texts
whose squared Mahalanobis distance lies beyond `cut` are rejected. Groups with fewer than
`least` texts are judged by their language's estimate, or by the whole table's.

All of it is DataFrame expressions; the estimates are tables with a row for each group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, dropped, without, written

SYMBOLS = "#*$%&|<>"
#: Least standard deviations, in units of the features: below them a difference says nothing
#: about quality, and statistics that are constant in a group stay invertible.
FLOORS = (0.08, 0.12, 0.30, 0.12, 0.20)
#: Squared distance beyond which a text is rejected: the 0.999 quantile of chi-square with five
#: degrees of freedom. The floors widen the scatter, so that clean texts stay far within it.
CUT = 20.5
MIN_WORDS = 50
#: Groups whose estimates (seven rows of about 300 bytes at most) are broadcast, and parts of a group beyond that.
GROUPS = 20_000
SALT = 64
#: Concentration steps from all starts, and the starts that go on after them.
TRIED = 2
BEST = 2
#: What makes the covariance of the nearer half consistent for normal features: a half over the
#: chance that chi-square with seven degrees of freedom is under its median with five.
HALF = 1.9121


def _times(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(without(c, characters))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (long).

    A null text counts as empty: all are 0. Words are runs without white space; word_chars are
    code points within words. n_dup_lines are lines (ended by a line feed) with a word that
    equal an earlier line. n_repeat_words are words within a window of three that occurs twice
    or more in the text, its first occurrence included. The text column is kept.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    windows = F.when(
        F.size("_w") >= 3,
        F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.struct(F.xxhash64(w, F.col("_w")[i + 1], F.col("_w")[i + 2]).alias("h"), i.alias("i"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    same = lambda a, b: F.coalesce(F.get(F.col("_s"), a)["h"] == F.get(F.col("_s"), b)["h"], F.lit(False))
    # The windows are sorted by hash, so equal ones are neighbours; what is left are their places, sorted again.
    places = F.sort_array(F.transform(F.filter(F.col("_s"), lambda x, j: same(j, j - 1) | same(j, j + 1)), lambda x: x["i"]))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    # Each step is a projection of its own, so that the arrays are built once.
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), SPACES[1:], whole)
    out = docs.withColumn("_w", F.array_remove(F.split(plain, " ", -1), ""))
    out = out.withColumn("_s", F.sort_array(windows)).withColumn("_l", lines)
    out = out.withColumn("_p", places)
    covered = F.aggregate(
        F.col("_p"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return out.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(without(whole, SPACES)).cast("long").alias("word_chars"),
        _times(whole, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count(whole, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
    )


def features() -> Column:
    """The transformed statistics as an array; of a text without words those of an empty one."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    share = lambda c, of: F.log1p(10 * F.col(c) / of)
    return F.array(
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),  # mean length of words
        share("n_symbols", chars),
        share("n_upper", chars),
        F.col("n_repeat_words") / words,
        F.col("n_dup_lines") / lines,
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


D = len(FLOORS)
_each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(D - 1)), f)
_unit = lambda i, k: F.when(i == k, F.lit(1.0)).otherwise(F.lit(0.0))


def _inverse(matrix: Column) -> Column:
    """The inverse of a positive definite array of arrays: Gauss-Jordan steps folded over its columns."""
    wide = F.transform(matrix, lambda row, i: F.concat(row, _each(lambda k: _unit(i, k))))

    def step(rows: Column, j: Column) -> Column:
        pivot = F.transform(rows[j], lambda x: x / rows[j][j])
        return F.transform(rows, lambda row, i: F.when(i == j, pivot).otherwise(F.transform(row, lambda x, k: x - row[j] * pivot[k])))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), wide, step)
    return F.transform(solved, lambda row: F.slice(row, D + 1, D))


def _log_det(matrix: Column) -> Column:
    """The logarithm of a positive definite matrix's determinant: that of its pivots, summed."""

    def step(acc: Column, j: Column) -> Column:
        rows = acc["rows"]
        rest = F.transform(rows, lambda row, i: F.when(i > j, F.transform(row, lambda x, k: x - row[j] / rows[j][j] * rows[j][k])).otherwise(row))
        return F.struct(rest.alias("rows"), (acc["s"] + F.log(rows[j][j])).alias("s"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), F.struct(matrix.alias("rows"), F.lit(0.0).alias("s")), step, lambda acc: acc["s"])


def _moments(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    """By group and start k: m, the mean of f, inv, the inverse of its covariance times `factor` with the floors added, and that matrix's log_det."""
    f = F.col("f")
    aggs = [F.avg(f[i]).alias(f"m{i}") for i in range(D)]
    aggs += [F.covar_pop(f[i], f[j]).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)]
    cell = lambda i, j: factor * F.col(f"c{max(i, j)}{min(i, j)}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
    cov = F.array(*[F.array(*[cell(i, j) for j in range(D)]) for i in range(D)])
    out = rows.groupBy("grp", "k").agg(*aggs).select("grp", "k", F.array(*[F.col(f"m{i}") for i in range(D)]).alias("m"), cov.alias("cov"))
    return out.select("grp", "k", "m", _inverse(F.col("cov")).alias("inv"), _log_det(F.col("cov")).alias("log_det"))


def _with(rows: DataFrame, params: DataFrame, small: bool, keys: tuple[str, ...] = ("grp",), how: str = "inner") -> DataFrame:
    """`rows` joined with the table `params`, which has few rows for each group and was written before.

    Rows are not dealt by group: params are broadcast if they are known to be `small`, or else
    repeated for each of `SALT` parts of a group.
    """
    if small:
        return rows.join(F.broadcast(params), list(keys), how)
    spread = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALT).cast("int"))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def _distance() -> Column:
    """The squared Mahalanobis distance of f to m by inv."""
    f, m, inv = F.col("f"), F.col("m"), F.col("inv")
    return reduce(lambda x, y: x + y, [inv[i][j] * (f[i] - m[i]) * (f[j] - m[j]) for i in range(D) for j in range(D)])


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """(grp, k, m, inv): medians with absolute deviations, the mean and covariance of all, and those of the half nearest to the median in each of the features."""
    f = F.col("f")
    middle = written(rows.groupBy("grp").agg(F.array(*[F.percentile_approx(f[i], 0.5) for i in range(D)]).alias("m")), "mcd")
    away = _with(rows, middle, small).select("grp", "m", F.zip_with("f", "m", lambda x, m: F.abs(x - m)).alias("f"))
    spread = away.groupBy("grp").agg(F.first("m").alias("m"), F.array(*[F.percentile_approx(f[i], 0.5) for i in range(D)]).alias("mad"))
    spread = written(spread, "mcd")
    inv = F.array(*[F.array(*[1 / ((1.4826 * F.col("mad")[i]) ** 2 + FLOORS[i] ** 2) if i == k else F.lit(0.0) for k in range(D)]) for i in range(D)])
    near = [F.when(F.abs(f[i] - F.col("m")[i]) <= F.col("mad")[i], F.lit(i + 2)) for i in range(D)]
    parts = _with(rows, spread, small).select("grp", "f", F.explode(F.array_compact(F.array(F.lit(1), *near))).alias("k"))
    return spread.select("grp", F.lit(0).alias("k"), "m", inv.alias("inv")).unionByName(_moments(parts).drop("log_det"))


def minimum_covariance(rows: DataFrame, small: bool | None = None) -> DataFrame:
    """Robust mean m and inverse scatter inv for each `grp` of `rows` (grp and the array f); `small`: there are at most `GROUPS` groups (by default they are counted).

    Each of several starts takes concentration steps: the half of a group that lies nearest to the
    last estimate gives the next. After `TRIED` steps the `BEST` starts with the least determinants
    go on until their determinants stop falling, and the least one counts. Its reweighting keeps
    what lies within the 0.975 quantile of chi-square, on the scale that the median distance sets.
    Medians are within a ten-thousandth of a group's rows.
    """
    rows = written(rows, "features")
    if small is None:
        small = rows.select("grp").distinct().count() <= GROUPS
    state = written(_starts(rows, small).select("*", F.lit(float("inf")).alias("log_det"), F.lit(True).alias("falls")), "mcd")
    step = 0
    while not state.where("falls").isEmpty():
        before = state
        now = written(state.where("falls").select("grp", "k", "m", "inv"), "mcd")
        far = _with(rows, now, small).select("grp", "k", "f", _distance().alias("d2"))
        edge = written(far.groupBy("grp", "k").agg(F.percentile_approx("d2", 0.5).alias("edge")), "mcd")
        new = _moments(_with(far, edge, small, ("grp", "k")).where("d2 <= edge"), HALF)
        both = state.join(new.withColumnsRenamed({c: f"new_{c}" for c in ("m", "inv", "log_det")}), ["grp", "k"], "left")
        falls = F.coalesce(F.col("new_log_det") < F.col("log_det") - 1e-6, F.lit(False))
        state = both.select("grp", "k", *[F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("m", "inv", "log_det")], falls.alias("falls"))
        step += 1
        if step == TRIED:
            state = state.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("log_det", "k"))).where(F.col("_n") <= BEST).drop("_n")
        state = written(state, "mcd")
        for table in (before, now, edge):
            dropped(table)
    best = state.groupBy("grp").agg(F.min_by(F.struct("m", "inv"), F.struct("log_det", "k")).alias("b")).select("grp", "b.m", "b.inv")
    far = _with(rows, written(best, "mcd"), small).select("grp", F.lit(0).alias("k"), "f", _distance().alias("d2"))
    # 4.35 is the median and 12.83 the 0.975 quantile of chi-square with five degrees of freedom.
    edge = written(far.groupBy("grp").agg(F.percentile_approx("d2", 0.5).alias("edge")), "mcd")
    near = _with(far, edge, small).where(F.col("d2") <= F.greatest(F.col("edge") / 4.35, F.lit(1.0)) * 12.83)
    out = written(_moments(near).drop("log_det", "k"), "mcd")
    dropped(rows)
    return out


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "base_failed", "d2", "kept")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT, least: int = 60, keep_text: bool = True) -> DataFrame:
    """`docs` with its statistics, base_failed, d2 (squared robust distance) and kept.

    Kept are texts that pass the base rules and lie within `cut`. Null languages and sources
    form groups of their own; null and empty texts have no words and fail the base rules, and
    rows that repeat are judged each. A column of `docs` that is named like an added one is
    replaced. Texts that fail the base rules don't take part in the estimates. An empty table
    gives an empty result. Texts are read once; their statistics are kept in the shared folder,
    with the texts only if `keep_text`.
    """
    kept = [c for c in docs.columns if c not in ADDED and (keep_text or c != text)]
    # The columns travel as one struct, so that none of their names can clash with those in here.
    row = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (lang, source)]
    grouped = docs.select(row.alias("_row"), F.col(text).alias("_text"), F.concat(F.lit("l:"), key[0]).alias("_gl"), F.concat(F.lit("s:"), key[0], F.lit("\x01"), key[1]).alias("grp"))
    stats = text_statistics(grouped, "_text").drop("_text").withColumn("base_failed", base_failed()).withColumn("f", features())
    stats = written(stats, "stats")
    rows = stats.where(~F.col("base_failed")).select("_gl", "grp", "f")
    sizes = written(rows.groupBy("_gl", "grp").agg(F.count("*").alias("n_s")), "sizes")
    # Each group is judged by its own estimate, its language's or the whole table's, so no table below has more groups.
    small = 2 * sizes.count() + 1 <= GROUPS
    sizes = sizes.join(sizes.groupBy("_gl").agg(F.sum("n_s").alias("n_l")), "_gl")
    level = F.when(F.col("n_s") >= least, F.col("grp")).when(F.col("n_l") >= least, F.col("_gl")).otherwise(F.lit("a:"))
    sizes = written(sizes.select(F.col("grp").alias("key"), level.alias("grp")), "sizes")
    # Estimates are made only for what some group is judged by.
    used = written(sizes.select("grp").distinct(), "sizes")
    params = minimum_covariance(_with(rows.select(F.explode(F.array("grp", "_gl", F.lit("a:"))).alias("grp"), "f"), used, small), small)
    estimates = written(sizes.join(params, "grp").select(F.col("key").alias("grp"), "m", "inv"), "mcd")
    judged = _with(stats, estimates, small, how="left").withColumn("d2", _distance())
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True))
    return judged.select(*[F.col("_row")[c].alias(c) for c in kept], *ADDED[:-1], verdict.alias("kept"))
